"""Byte ranges of files, read by any file system that pyarrow knows: reads of four-line records from splits of any size.

A split owns the records that begin inside it. It finds the first one by the form of a record: a line that begins with `@` whose
next but one begins with `+`. No quality line passes for that, as what follows it by two lines is a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READS = "read_name string, mate byte, seq string, qual string"
SPLIT_BYTES, CHUNK, ROWS = 64 << 20, 1 << 20, 8192


def file_system(path: str):
    """The file system of a path or address, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Address and size of a file, or of the files in a folder whose names do not begin with `.` or `_`."""
    from pyarrow import fs

    system, where = file_system(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(where, recursive=True))
    scheme = path[: len(path) - len(where)] if path.endswith(where) else ""
    return [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"]


def lines_from(source, at: int) -> Iterator[tuple[int, bytes]]:
    """(position, line without its end) of the lines that begin at a position or behind it."""
    if at:
        source.seek(at - 1)
    rest, begin, skip = b"", max(at - 1, 0), at > 0
    while raw := source.read(CHUNK):
        *whole, rest = (rest + raw).split(b"\n")
        for line in whole:
            if not skip:
                yield begin, line.rstrip(b"\r")
            skip, begin = False, begin + len(line) + 1
    if rest and not skip:
        yield begin, rest.rstrip(b"\r")


def records_of(lines: Iterator[tuple[int, bytes]], end: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(head without `@`, sequence, qualities) of the records that begin before end."""
    held: list[tuple[int, bytes]] = []
    for line in lines:
        held.append(line)
        if len(held) < 4:
            continue
        if held[0][1][:1] == b"@" and held[2][1][:1] == b"+":
            if end is not None and held[0][0] >= end:
                return
            yield held[0][1][1:], held[1][1], held[3][1]
            held = []
        else:
            held.pop(0)
            if end is not None and held[0][0] >= end:
                return


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class ReadsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mate = options["path"], int(options.get("mate", 1))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        out = []
        for path, size in files_of(self.path):
            if path.endswith(".gz"):  # has no places to begin at
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.path:
            return
        system, where = file_system(partition.path)
        kinds = [pa.string(), pa.int8(), pa.string(), pa.string()]
        names = [c.split()[0] for c in READS.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        source = system.open_input_stream(where, compression="gzip") if partition.end is None else system.open_input_file(where)
        with source:
            rows = []
            for head, seq, qual in records_of(lines_from(source, partition.start), partition.end):
                # a name ends at the first slash, blank or tab
                name = head.replace(b"\t", b"/").replace(b" ", b"/").split(b"/", 1)[0].decode()
                rows.append((name, self.mate, seq.decode(), qual.decode()))
                if len(rows) == ROWS:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)


class ReadsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "junctura_reads"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return ReadsReader(self.options)


def reads(spark: SparkSession, path: str, mate: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """read_name, mate, seq, qual of the four-line records of a file or a folder of files."""
    spark.dataSource.register(ReadsSource)
    return spark.read.format("junctura_reads").option("mate", mate).option("splitBytes", split_bytes).load(path)
