"""Binary files read in ranges: records of fixed length, and digests in constant memory.

A file is never one row. Fixed-length records are read by ranges of one file, so a large file is many tasks; a digest
needs a file's bytes in order, so a file is one task, which holds one block of it. Small files share tasks. Folders are
listed and read with ``pyarrow.fs``: local paths, ``file://``, and the stores it knows (``s3://``, ``gs://``, ``hdfs://``).
"""

import hashlib
import sys
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import written

# Readers go to their workers whole: those that plan a scan do not see the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a task, of a batch of records, and of a block that is digested.
SPLIT, BATCH, BLOCK = 64 << 20, 4 << 20, 8 << 20
ALGORITHMS = ("sha256", "sha512", "sha1", "md5")


def _algorithms(options) -> list[str]:
    chosen = options.get("algorithms", "sha256").lower().split(",")
    if set(chosen) - set(ALGORITHMS):
        raise ValueError(f"algorithms must be of {', '.join(ALGORITHMS)}")
    return chosen


def _files(uri: str, pattern: str):
    """``(file system, [(path, bytes)])`` of the files below a folder, or the one file, by path."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(
        fs.FileSelector(path, recursive=True, allow_not_found=True))
    return system, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))


@dataclass
class Ranges(InputPartition):
    """What one task reads: ``(path, first byte, bytes)`` each."""

    ranges: list

    def __init__(self, ranges):
        self.ranges = ranges


def _tasks(ranges: list, split: int) -> list[Ranges]:
    """Ranges in order, so many together that a task has about ``split`` bytes."""
    out, held = [[]], 0
    for r in ranges:
        if out[-1] and held + r[2] > split:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r[2]
    return [Ranges(r) for r in out]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.split, self.record = int(options.get("split", SPLIT)), int(options.get("record", 0))

    def open(self, path):
        from pyarrow import fs
        system = fs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri else fs.LocalFileSystem()
        return system.open_input_file(path)


class _RecordReader(_Reader):
    def partitions(self):
        step = max(1, self.split // self.record) * self.record
        ranges = [(path, at, min(step, size - at)) for path, size in _files(self.uri, self.pattern)[1]
                  if size % self.record == 0 for at in range(0, size, step)]
        return _tasks(ranges, step)

    def read(self, partition):
        step = max(1, BATCH // self.record) * self.record
        for path, begin, size in partition.ranges:
            with self.open(path) as file:
                for at in range(begin, begin + size, step):
                    data = file.read_at(min(step, begin + size - at), at)
                    n = len(data) // self.record
                    cells = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(self.record), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array(range(at, at + n * self.record, self.record), pa.int64()),
                         cells], names=["path", "offset", "rec"])


class FixedRecords(DataSource):
    """``(path, offset, rec)``: the records of ``record`` bytes of all files; files of another size are left out."""

    @classmethod
    def name(cls):
        return "fixed_records"

    def schema(self):
        return "path string, offset bigint, rec binary"

    def reader(self, schema):
        return _RecordReader(self.options)


class _DigestReader(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.algorithms = _algorithms(options)

    def partitions(self):
        return _tasks([(path, 0, size) for path, size in _files(self.uri, self.pattern)[1]], self.split)

    def read(self, partition):
        for path, _, _ in partition.ranges:
            states, size = [hashlib.new(a) for a in self.algorithms], 0
            with self.open(path) as file:
                while data := file.read(BLOCK):
                    size += len(data)
                    for state in states:
                        state.update(data)
            yield (path, size, *[state.hexdigest() for state in states])


class FileDigests(DataSource):
    """``(path, bytes)`` and a column per algorithm, of all files, whatever their size."""

    @classmethod
    def name(cls):
        return "file_digests"

    def schema(self):
        return "path string, bytes bigint, " + ", ".join(f"{a} string" for a in _algorithms(self.options))

    def reader(self, schema):
        return _DigestReader(self.options)


def read_fixed_records(spark: SparkSession, path: str, record: int, *, split: int = SPLIT, pattern: str = "*") -> DataFrame:
    """``(path, offset, rec)`` of all records below ``path``, about ``split`` bytes of them in a task."""
    spark.dataSource.register(FixedRecords)
    return (spark.read.format("fixed_records").option("record", record).option("split", split)
            .option("pattern", pattern).load(path))


def read_file_digests(spark: SparkSession, path: str, *, algorithms=("sha256",), split: int = SPLIT,
                      pattern: str = "*") -> DataFrame:
    """``(path, bytes)`` and a column per algorithm, of all files below ``path``, each read once in blocks."""
    spark.dataSource.register(FileDigests)
    return written(spark.read.format("file_digests").option("algorithms", ",".join(algorithms)).option("split", split)
                   .option("pattern", pattern).load(path))
