"""Token ids in Arrow files of fixed-size lists.

Documents are dealt into ranges of ascending id and sorted; each task encodes
its range in order and writes one Arrow IPC file whose record batches hold
rows of `width` ids (fixed-size list) and of as many mask bits. All rows have
equal length, so row r of a file lies in batch r // ROWS at a fixed place:
a reader maps the file and slices it without a copy. The last row of a file is
padded; its mask is false there. A manifest has one row per document: file,
first id in it, number of ids.

The mask says which ids count; reading takes the ids under it.

Files are first written under a name of the attempt and then renamed, so a
task that runs again, after a lost executor, replaces its own file by an equal
one. They go to a folder that all executors share, through pyarrow's file
systems: the driver resolves the folder as Spark does (a bare path by the
default file system) and names it so that pyarrow understands it.

Defined cases: a null text is empty (its end id alone); ids are whole numbers
or null, and a null id sorts first; documents of equal id follow each other in
order of their text's hash, then their text, and may lie in several ranges;
columns other than id and text are ignored; an empty table gives no files and
no rows.
"""

from __future__ import annotations

import posixpath
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_bpe, default_path
from .common import materialize, scratch_path, table
from .pack import with_bases

WIDTH = 2048
END_ID = 0
#: Rows in a record batch.
ROWS = 256


def resolved(spark: SparkSession, uri: str) -> str:
    """uri with the file system that Spark takes it to be on, by the name that pyarrow has for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    scheme, _, rest = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().partition(":")
    rest = rest if rest.startswith("//") else f"//{rest}"
    return {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + ":" + rest


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Ids go in; full batches of rows go to the file; memory holds one batch."""

    def __init__(self, sink, width: int, kind: str):
        self.width, self.kind, self.held, self.size, self.n = width, kind, [], 0, 0
        value = pa.uint16() if kind == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, width)), ("mask", pa.list_(pa.bool_(), width))])
        self.value, self.file = value, pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.n += len(ids)
        if self.size >= self.width * ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        step, flat = self.width * ROWS, np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        at = 0
        while len(flat) - at >= step or last and at < len(flat):
            part = flat[at : at + step]
            rows = -(-len(part) // self.width)
            ids, mask = np.zeros(rows * self.width, self.kind), np.zeros(rows * self.width, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.width) for x, t in ((ids, self.value), (mask, pa.bool_()))]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            at += step
        self.held, self.size = [flat[at:]], max(0, len(flat) - at)

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def write_ids(docs: DataFrame, uri: str, path: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below uri; the manifest: part, local_start, doc_id, n, file.

    The manifest is written too, so the files are made once.
    """

    uri = resolved(docs.sparkSession, uri)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        bpe, part = byte_bpe(path), task.partitionId()
        kind = "<u2" if max(bpe.top, end_id) < 65536 else "<u4"
        writer = sink = None
        store, root = _open(uri)
        name = f"ids-{part:06d}.arrow"
        draft = posixpath.join(root, f"_{name}.{task.taskAttemptId()}-{uuid.uuid4().hex}")
        for batch in batches:
            docs_in, starts, counts = batch.column(0), [], []
            for value in batch.column(1):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(draft)
                    writer = _Writer(sink, width, kind)
                ids = np.append(bpe.encode(value.as_py() or ""), np.uint32(end_id)).astype(kind)
                starts.append(writer.n)
                counts.append(len(ids))
                writer.add(ids)
            k = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array(starts, pa.int64()), docs_in, pa.array(counts, pa.int64()), pa.array([name] * k, pa.string())],
                names=["part", "local_start", "doc_id", "n", "file"],
            )
        if writer is not None:
            writer.close()
            sink.close()
            store.move(draft, posixpath.join(root, name))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # equal ids may be many: their texts' hashes, and of equal texts the rows' numbers, cut them into ranges too
    rows = rows.withColumn("mix", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, "doc_id", "mix", "row").sortWithinPartitions("doc_id", "mix", "text")
    return materialize(ordered.mapInArrow(run, "part int, local_start bigint, doc_id bigint, n bigint, file string"), "manifest")


class IdFile:
    """Random access to a file of ids; local files are mapped, not read."""

    def __init__(self, uri: str, name: str):
        store, root = _open(uri)
        at = posixpath.join(root, name)
        source = pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at)
        self.file, self.key, self.held, self.mask = pa.ipc.open_file(source), -1, None, None
        self.width = self.file.schema.field("ids").type.list_size

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file's stream."""
        step, out = self.width * ROWS, []
        while n > 0:
            key, offset = divmod(start, step)
            if key != self.key:
                batch = self.file.get_batch(key)
                self.key, self.held = key, batch.column(0).flatten().to_numpy(zero_copy_only=True)
                self.mask = batch.column(1).flatten()
            take = min(n, step - offset)
            if self.mask.slice(offset, take).true_count != take:
                raise ValueError(f"ids {start} to {start + take} of batch {key} are padding")
            out.append(self.held[offset : offset + take])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if len(out) != 1 else out[0]


@lru_cache(maxsize=2)
def _reader(uri: str, name: str) -> IdFile:
    return IdFile(uri, name)


def read_ids(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start (in the whole stream), n_tokens and ids (32 bit) read from the files.

    An id that the mask calls padding is an error: the manifest and the file disagree.
    """

    uri = resolved(manifest.sparkSession, uri)

    def run(batches):
        for batch in batches:
            c = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            for at in range(0, batch.num_rows, 256):
                rows = range(at, min(at + 256, batch.num_rows))
                ids = [_reader(uri, c["file"][i]).ids(c["local_start"][i], c["n"][i]).astype("<u4") for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["doc_id"][i] for i in rows], pa.int64()), pa.array([c["base"][i] + c["local_start"][i] for i in rows], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    rows = with_bases(manifest).select("doc_id", "local_start", "n", "file", "base")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), uri, default_path("byte_bpe_50k.json"))
    return read_ids(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
