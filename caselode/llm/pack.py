"""Packing: concatenate and cut.

Pass 1 tokenises every document once and writes, per partition, the ids with
each document's offset inside its partition. The partition totals (one row per
partition) are summed into bases; base + local offset is the document's place
in the one long sequence of all tokens. Pass 2 cuts that sequence into fixed
windows. Pieces of windows that take tokens from more than one partition are
boundary records (`boundary`); `assemble` joins those alone and puts all other
windows together where they lie.

Only the last window may be short, so padding is below one window in total.
No document is moved: neither pass shuffles texts or ids.

Defined cases: a null text is empty and packs its end token alone; ids are
whole numbers or null; repeated rows and ids pack as separate documents; columns other than the id and the
text are ignored, so none can clash; an empty table gives no pieces. Memory
is bounded by one document's ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .bpe import byte_bpe, default_path
from .common import materialize, table

WINDOW = 2048
END_ID = 1
#: A batch of output rows is sent on at this many ids.
FLUSH = 1 << 20

_TOKENS = "part int, local_start bigint, doc_id bigint, n bigint, ids binary"


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: partition, offset in it, id, count and ids (little-endian 16 or 32 bit)."""

    def run(batches):
        from pyspark import TaskContext

        bpe, part, at = byte_bpe(path), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(bpe.top, end_id) < 65536 else "<u4"
        for batch in batches:
            keys, rows, held = batch.column(0), [], 0
            for i, value in enumerate(batch.column(1)):
                ids = bpe.encode(value.as_py() or "")
                data = np.append(ids, np.uint32(end_id)).astype(kind)
                rows.append((part, at, keys[i].as_py(), len(data), data.tobytes()))
                at += len(data)
                held += len(data)
                if held > FLUSH:
                    yield _batch(rows, _SCHEMA)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _SCHEMA)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text)).mapInArrow(run, _TOKENS)


_SCHEMA = pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def with_bases(tokens: DataFrame, count: str = "n") -> DataFrame:
    """tokens with `base` (ids in all earlier partitions), `part_end`, and `total` of all partitions.

    The prefix sums are a table with one row per partition of the first pass,
    written to the shared folder; its size is bounded by the number of
    partitions, and only it is broadcast.
    """
    totals = tokens.groupBy("part").agg(F.sum(count).cast("bigint").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("part"))  # a row per partition
    whole = F.sum("size").over(Window.partitionBy(F.lit(1)))
    sums = totals.select("part", (upto - F.col("size")).alias("base"), upto.alias("part_end"), whole.alias("total"))
    return tokens.join(F.broadcast(materialize(sums, "bases")), "part")


_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, boundary boolean, ids binary"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("boundary", pa.bool_()), ("ids", pa.binary())])


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, boundary, ids.

    ids are little-endian unsigned 32-bit integers. `boundary` marks pieces of
    windows that take tokens from more than one partition.
    """
    ship(docs.sparkSession)
    tokens = with_bases(materialize(tokenize(docs, path, end_id, id_col, text), "tokens"))

    def cut(batches):
        for batch in batches:
            c = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            rows, held = [], 0
            for i in range(batch.num_rows):
                n, base, end, total = (c[k][i].as_py() for k in ("n", "base", "part_end", "total"))
                raw, doc, at = c["ids"][i].as_py(), c["doc_id"][i].as_py(), base + c["local_start"][i].as_py()
                ids, done = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), 0
                while done < n:
                    seq, offset = divmod(at + done, window)
                    take = min(n - done, window - offset)
                    across = seq * window < base or min((seq + 1) * window, total) > end
                    rows.append((doc, done, take, n, seq, offset, across, ids[done : done + take].tobytes()))
                    done += take
                held += n
                if held > FLUSH:
                    yield _batch(rows, _PIECE_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _PIECE_SCHEMA)

    return tokens.select("local_start", "doc_id", "n", "ids", "base", "part_end", "total").mapInArrow(cut, _PIECES)


_SEQUENCES = "sequence_id bigint, n_tokens bigint, pieces array<struct<offset:bigint,doc_id:bigint,start:bigint,length:bigint,ids:binary>>"


def assemble(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences of a window each: sequence_id, n_tokens, pieces in order with their ids.

    Windows that a task sees whole are put together where they lie; only the
    rest, boundary records and the last window, are shuffled. A group holds at
    most one window of ids, whatever the data.
    """
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    kind = pa.struct([("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    names = ["sequence_id", "n_tokens", "pieces", "edge"]

    def run(batches):
        now, held, out, size = None, [], [], 0

        def done():
            n = sum(x["length"] for x in held)
            out.append((now, n, held, n != window))

        def give(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(kind), pa.bool_()), strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["sequence_id"] != now:
                    if held:
                        done()
                    now, held = r["sequence_id"], []
                del r["sequence_id"]
                held.append(r)
                size += r["length"]
            if size > FLUSH and out:
                yield give(out)
                out, size = [], 0
        if held:
            done()
            yield give(out)

    rows = pieces.select("sequence_id", "offset", "doc_id", "start", "length", "ids").mapInArrow(run, f"{_SEQUENCES}, edge boolean")
    edges = rows.where("edge").select("sequence_id", F.inline("pieces"))
    joined = edges.groupBy("sequence_id").agg(F.sum("length").cast("bigint").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return rows.where("not edge").drop("edge").unionByName(joined)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def op2_pack_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json")))
