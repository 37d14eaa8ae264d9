"""A log of versions in a folder: numbered JSON files that are made once and never changed."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession

#: After the scheme, paths have one slash or three.
SLASHES = ":/+"


class Conflict(RuntimeError):
    """Another writer published the version first."""


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = fs_of(spark, path)
    return fs.exists(hpath)


def listing(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of each file right in a folder, by name; none if there is no folder."""
    fs, hpath = fs_of(spark, folder)
    if not fs.exists(hpath):
        return {}
    return {posixpath.basename(s.getPath().toString()): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(hpath) if s.isFile()}


def plain(path: str) -> str:
    """A path with one slash after its scheme."""
    return re.sub(SLASHES, ":/", path, count=1)


def snapshot(df: DataFrame) -> dict[str, list[int]]:
    """Size and time of change of each of df's files, in order of their paths; folders are listed once each."""
    files = sorted(df.inputFiles())
    there = {folder: listing(df.sparkSession, folder) for folder in {posixpath.dirname(f) for f in files}}
    return {plain(f): list(there[posixpath.dirname(f)].get(posixpath.basename(f), (-1, -1))) for f in files}


def write_once(spark: SparkSession, path: str, value) -> None:
    """A JSON file that wasn't there before; of several writers one succeeds, the others get Conflict."""
    fs, hpath = fs_of(spark, path)
    try:
        out = fs.create(hpath, False)
    except Exception as e:  # py4j wraps what Java throws
        if fs.exists(hpath):
            raise Conflict(path) from e
        raise
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()


def read_json(spark: SparkSession, path: str):
    fs, hpath = fs_of(spark, path)
    stream = fs.open(hpath)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Log:
    """Versions 1, 2, ... in a folder. A half-written one doesn't parse and counts as not there yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name in listing(self.spark, self.path) if name.endswith(".json"))

    def read(self, version: int):
        return read_json(self.spark, self._file(version))

    def latest(self) -> tuple[int, object | None]:
        """The newest readable version and its value; (0, None) of an empty log."""
        for version in reversed(self.versions()):
            try:
                return version, self.read(version)
            except json.JSONDecodeError:
                continue
        return 0, None

    def append(self, after: int, value) -> int:
        """Publish the version after `after`; Conflict if somebody else did."""
        write_once(self.spark, self._file(after + 1), value)
        return after + 1

    def forget(self, versions: list[int]) -> None:
        for v in versions:
            fs, hpath = fs_of(self.spark, self._file(v))
            fs.delete(hpath, False)
