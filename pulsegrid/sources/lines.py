"""Lines of text files with a stable order: a Python data source over byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.sources.readers import symbols_from_lines

SPLIT_BYTES = 16 << 20


class ByteRange(InputPartition):
    """Lines of one file that begin at or after ``start`` and before ``end``."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class OrderedLines(DataSource):
    """Options: ``path`` of a file or folder, ``splitBytes``. Rows: ``file, position`` (byte offset of the line), ``value``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def reader(self, schema) -> DataSourceReader:
        return OrderedLinesReader(self.options)


class OrderedLinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], max(1, int(options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda name: name.rsplit("/", 1)[-1].startswith(("_", "."))
        kept = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not hidden(f.path))
        return [ByteRange(file, at, min(at + self.split, size)) for file, size in kept for at in range(0, size, self.split)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as raw:
            at, rest = partition.start, b""
            if at:  # a line that began before belongs to the range before
                raw.seek(at - 1)
                before = raw.read(1)
                while before not in (b"\n", b""):
                    before = raw.read(1)
                    at += 1
            raw.seek(at)
            while at < partition.end:
                cut = rest.find(b"\n")
                while cut < 0:
                    more = raw.read(1 << 16)
                    if not more:
                        break
                    rest += more
                    cut = rest.find(b"\n")
                line = rest if cut < 0 else rest[:cut]
                if cut < 0 and not line:
                    return
                yield partition.file, at, line.rstrip(b"\r").decode("utf-8", "replace")
                if cut < 0:
                    return
                at, rest = at + cut + 1, rest[cut + 1 :]


def ordered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a file, or of all files of a folder, with file and byte offset."""
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").option("path", path).option("splitBytes", split_bytes).load()


def ordered_symbols(spark: SparkSession, path: str, exclude=(), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``ticker`` and ``position`` (file and byte offset of its first line), whatever the number of files and splits."""
    lines = ordered_lines(spark, path, split_bytes)
    return symbols_from_lines(lines.select("value", F.struct("file", "position").alias("_pos")), exclude=exclude)
