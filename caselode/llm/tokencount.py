r"""Token counts by a compiled transducer.

`transducer` compiles the tokenizer file into a deterministic machine whose
transitions carry counts of emitted tokens. Texts up to CHUNK code points are
run whole, many at a time. Longer ones are normalised, cut into chunks at
arbitrary places and dealt over the cluster: a chunk's state map says, for any
state it may start in, which state it ends in and how many tokens it emits. As
white space resets the machine, a map is (head, inner count, tail): what stands
before the first reset, what is counted between, what stands after the last.
Maps compose associatively; rounds over the (document, chunk) rows, each
joining FAN neighbours, are the up-sweep of a parallel prefix scan and leave
one map a document. No task ever holds more than a chunk, or FAN maps.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts with a
special string, or with a code point that the compiled table lacks, are counted
whole by the tokenizers library; a tokenizer file that the compiler does not
know raises Unsupported before any text is read; repeated rows and ids each
give a row, null ids too; ids keep their type; other columns are ignored, so
none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .bpe import default_path
from .common import table
from .transducer import GROUP, transducer

LIMIT = 2048
#: Code points in a chunk; texts up to this run whole.
CHUNK = 1 << 16
#: Maps that one task composes in a round.
FAN = 32

#: A map with the number, id and size of the document that it is of.
_NAMES = ["row", "doc_id", "n_bytes", "chunk", "head", "inner", "tail"]


def _map_type(kind: str) -> str:
    return f"row bigint, doc_id {kind}, n_bytes bigint, chunk bigint, head string, inner bigint, tail string"


def _maps(of: list, chunk: pa.Array, maps: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*maps, strict=True)) or [[]] * 3
    parts = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([*of, chunk, *parts], names=_NAMES)


def _counted(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """id, n_bytes, n_tokens of rows (id, n_bytes, text), whole texts."""

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            n, held, size = [], [], 0
            for x in batch.column(2):
                held.append(x.as_py())
                size += len(held[-1] or "")
                if size >= GROUP:
                    n += machine.tokens(held)
                    held, size = [], 0
            n += machine.tokens(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def chunk_maps(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """The state map of each chunk of rows (row, doc_id, n_bytes, text).

    A text that only the library can count has one map: its count between blanks.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        machine = transducer(path)
        for batch in batches:
            for i, text in enumerate(batch.column(3)):
                text = text.as_py()
                known = not machine.outside(text)
                text = machine.normal(text) if known else str(machine.tokens([text])[0])
                for k in range(0, len(text), chunk):
                    own = [c.slice(i, 1) for c in batch.columns[:3]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([k // chunk]), pa.array([text[k : k + chunk]]), pa.array([known])], names=[*_NAMES[:4], "part", "known"])

    def maps(batches):
        machine = transducer(path)
        for batch in batches:
            parts = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            yield _maps(batch.columns[:3], batch.column(3), [machine.map_of(x) if known else ("", int(x), "") for x, known in parts])

    parts = rows.mapInArrow(cut, f"row bigint, doc_id {kind}, n_bytes bigint, chunk bigint, part string, known boolean")
    return parts.repartition("row", "chunk").mapInArrow(maps, _map_type(kind))


def composed(maps: DataFrame, path: str, longest: int, fan: int = FAN) -> DataFrame:
    """One map a document: rounds of composing `fan` neighbours, until `longest` chunks have become one."""
    kind = maps.schema["doc_id"].dataType.simpleString()

    def join(group: pa.Table) -> pa.Table:
        machine, out = transducer(path), None
        group = group.sort_by("chunk").combine_chunks()
        for m in group.select(["head", "inner", "tail"]).to_pylist():
            m = (m["head"], m["inner"], m["tail"])
            out = m if out is None else machine.compose(out, m)
        own = [group.column(i).chunk(0).slice(0, 1) for i in range(3)]
        return pa.Table.from_batches([_maps(own, pa.array([group["chunk"][0].as_py() // fan]), [out])])

    while longest > 1:
        maps = maps.groupBy("row", F.floor(F.col("chunk") / fan).alias("next")).applyInArrow(join, _map_type(kind))
        longest = -(-longest // fan)
    return maps


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; only chunks of long texts are shuffled."""
    ship(docs.sparkSession)
    transducer(path)  # a file that can't be compiled fails here
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk
    out = _counted(rows.where(~F.coalesce(long, F.lit(False))), path, kind)
    most = rows.where(long).agg(F.max(F.length("text"))).first()[0]
    if most:
        numbered = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
        # normalising may lengthen a text, at most threefold in code points
        one = composed(chunk_maps(numbered, path, chunk), path, 3 * (most // chunk + 1), fan)

        def total(batches):
            machine = transducer(path)
            for batch in batches:
                n = [machine.total(m) for m in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        out = out.unionByName(one.mapInArrow(total, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
