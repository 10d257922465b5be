"""Binary alignment files read by byte ranges, with an index from places of contigs to blocks for fetches by region, and
alignments kept as Parquet clustered by contig.

A file's blocks are gzip members that give their own size in an extra field; its records cross blocks and have no mark. A split
looks for a block header from which a chain of headers follows, and in the blocks from there for a place from which a chain
of plausible records follows. It owns the records that begin in blocks that begin inside it.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import file_system

SCHEMA = "qname string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, tlen long, seq string, tags map<string,string>"
BATCH = 2048
# fixed values: operations of a CIGAR and bases of a four-bit code, by number
_OPERATIONS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


#: Bytes of a split; bytes read at a time; the largest block and record; headers and records in a chain that is believed.
SPLIT_BYTES, CHUNK, LARGEST_BLOCK, LARGEST_RECORD, CHAIN = 64 << 20, 1 << 18, 1 << 16, 1 << 24, 4
WINDOW = 1 << 14  # bases of a place in the index


def block_size(raw: bytes, at: int = 0) -> int:
    """The size that a block header gives, 0 if there is none."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or len(raw) < at + 18:
        return 0
    end = at + 12 + int.from_bytes(raw[at + 10 : at + 12], "little")
    at += 12
    while at + 4 <= min(end, len(raw)):
        n = int.from_bytes(raw[at + 2 : at + 4], "little")
        if raw[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(raw[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def first_block(source, start: int, size: int) -> int:
    """The first place at start or behind it where a chain of blocks begins; the file's size if there is none."""
    at = start
    while at < size:
        source.seek(at)
        raw = source.read(LARGEST_BLOCK + CHUNK)
        hit = raw.find(b"\x1f\x8b\x08\x04")
        if hit < 0:
            at += max(1, len(raw) - 3)
            continue
        at = place = at + hit
        for _ in range(CHAIN):
            if place == size:
                return at
            source.seek(place)
            n = block_size(source.read(1 << 12))
            if not n or place + n > size:
                break
            place += n
        else:
            return at
        at += 1
    return size


class Bytes:
    """Bytes of the blocks of an open file from a block on, in order, and where each of them lies."""

    def __init__(self, source, at: int = 0):
        self.source, self.next = source, at
        self.buffer, self.at = b"", 0
        self.begins: list[tuple[int, int]] = []  # (place in the buffer, place in the file) of its blocks

    def more(self, trim: bool = True) -> bool:
        """Appends a block; with trim what has been taken is given up, and places in the buffer move."""
        self.source.seek(self.next)
        head = self.source.read(LARGEST_BLOCK)
        if not head:
            return False
        n = block_size(head)
        if not n:
            raise ValueError(f"no block at byte {self.next}")
        while len(head) < n and (raw := self.source.read(n - len(head))):
            head += raw
        z = zlib.decompressobj(31)
        data = z.decompress(head[:n])
        if not z.eof:
            raise ValueError("the last block is cut off")
        if trim:
            kept = [(a - self.at, b) for a, b in self.begins]
            alive = max((k for k, (a, _) in enumerate(kept) if a <= 0), default=0)
            self.begins = kept[alive:]
            self.buffer, self.at = self.buffer[self.at :], 0
        self.begins.append((len(self.buffer), self.next))
        self.buffer += data
        self.next += n
        return True

    def fill(self, n: int) -> bool:
        """Whether n bytes lie ahead, once they are read."""
        while len(self.buffer) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            if len(self.buffer) == self.at:
                return b""
            raise ValueError("the last record is cut off")
        self.at += n
        return self.buffer[self.at - n : self.at]

    def where(self) -> tuple[int, int]:
        """The block of the next byte and the place in it; the end of a block counts as the beginning of the next one."""
        own = max((a, b) for a, b in self.begins if a <= self.at)
        return own[1], self.at - own[0]


def _plausible(raw: bytes, at: int, n_refs: int) -> int:
    """The place behind a record that may begin at a place, 0 if none can; -1 if more bytes are needed to tell."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    if not (32 < size < LARGEST_RECORD and -1 <= ref < n_refs and -1 <= mate_ref < n_refs and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0):
        return 0
    if 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size:
        return 0
    if at + 36 + l_name > len(raw):
        return -1
    *name, last = raw[at + 36 : at + 36 + l_name]
    return 0 if last or any(not 33 <= c <= 126 for c in name) else at + 4 + size


def _chain(data: Bytes, at: int, n_refs: int) -> bool:
    """Whether records may follow one another from a place of the buffer on; the end of the file may end the chain."""
    for k in range(CHAIN):
        while at == len(data.buffer):
            if not data.more(False):
                return k > 0
        while (then := _plausible(data.buffer, at, n_refs)) < 0 or then > len(data.buffer):
            if not data.more(False):
                return k > 0
        if not then:
            return False
        at = then
    return True


def first_record(data: Bytes, n_refs: int, end: int) -> bool:
    """Moves to the first record that begins in a block that begins before end; False if there is none."""
    while True:
        while data.at == len(data.buffer):
            if not data.more(False):
                return False
        if data.where()[0] >= end:
            return False
        if _chain(data, data.at, n_refs):
            return True
        data.at += 1


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind == "B":
            code, n = _NUMBERS[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)[0]
            out[name] = ",".join([chr(raw[at]), *map(str, struct.unpack_from(f"<{n}{code}", raw, at + 5))])
            at += 5 + n * struct.calcsize(code)
        else:
            code = _NUMBERS[kind]
            out[name], at = str(struct.unpack_from(f"<{code}", raw, at)[0]), at + struct.calcsize(code)
    return out


def header(source) -> tuple[list[str], tuple[int, int]]:
    """The contigs of an open file, and the place of its first record."""
    data = Bytes(source)
    if data.take(4) != b"BAM\x01":
        raise ValueError("not a binary alignment file")
    number = lambda: struct.unpack("<i", data.take(4))[0]
    data.take(number())
    names = []
    for _ in range(number()):
        names.append(data.take(number())[:-1].decode())
        number()
    return names, data.where() if data.fill(1) else (data.next, 0)


def _row(raw: bytes, names: list[str]) -> tuple:
    name = lambda k: names[k] if k >= 0 else "*"
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or "*"
    tags = _tags(raw[at + len(packed) + l_seq :])
    same = "=" if mate_ref == ref and ref >= 0 else name(mate_ref)
    return raw[32 : 31 + l_name].decode(), flag, name(ref), pos, mapq, "".join(f"{o >> 4}{_OPERATIONS[o & 15]}" for o in ops) or "*", same, mate_pos, tlen, seq, list(tags.items())


def records(source, start: int = 0, end: int | None = None, size: int | None = None):
    """(block, place in it, tuple of SCHEMA) of the records of an open file that begin in blocks from start up to end."""
    names, (block, inner) = header(source)
    if size is None:
        source.seek(0, 2)
        size = source.tell()
    end = size if end is None else end
    if start <= block:
        data = Bytes(source, block)
        data.fill(inner)
        data.at = inner
    else:
        data = Bytes(source, first_block(source, start, size))
        if not first_record(data, len(names), end):
            return
    while data.fill(1):
        at = data.where()
        if at[0] >= end:
            return
        n = data.take(4)
        yield *at, _row(data.take(struct.unpack("<i", n)[0]), names)


def _tables(rows, extra: bool = False):
    """Arrow batches of records, with their blocks and places if asked for."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.int64()] * 2 * extra
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["block", "inner"] * extra
    table = lambda some: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
    some = []
    for block, inner, row in rows:
        some.append((*row, block, inner) if extra else row)
        if len(some) == BATCH:
            yield table(some)
            some = []
    if some:
        yield table(some)


def _splits(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """path, start, size of the byte ranges of a file or a folder of files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    splits = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return splits.repartition(int(max(1, min(tasks, 100_000))), "path", "start")


def bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, places: bool = False) -> DataFrame:
    """Alignments of a file or a folder of them: the columns of SCHEMA, with 0-based positions (-1 if unmapped), and with
    places the file (path), the block a record begins in and its place there."""

    def run(batches):
        for batch in batches:
            for uri, size, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, where = file_system(uri)
                with system.open_input_file(where) as source:
                    for table in _tables(records(source, start, start + split_bytes, size), places):
                        yield _with_path(table, uri) if places else table

    schema = SCHEMA + ", block long, inner long, path string" * places
    return _splits(spark, path, split_bytes).select("path", "size", "start").mapInArrow(run, schema)


def _with_path(table, uri: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*table.columns, pa.array([uri] * len(table), pa.string())], [*table.schema.names, "path"])


def linear_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, ref, window, block and inner: for each window of WINDOW bases of a contig the first record of the file, sorted by
    position, that covers a base of it."""
    from ..functions.columns import reference_length

    rows = bam(spark, path, split_bytes, True).filter("ref <> '*' and pos >= 0")
    last = F.col("pos") + F.greatest(reference_length(F.col("cigar")), F.lit(1)) - 1
    each = rows.select("path", "ref", F.explode(F.sequence(F.floor(F.col("pos") / WINDOW), F.floor(last / WINDOW))).alias("window"), F.struct("block", "inner").alias("at"))
    return each.groupBy("path", "ref", "window").agg(F.min("at").alias("at")).select("path", "ref", "window", "at.*")


def fetch_blocks(index: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """The alignments of the indexed files, sorted by position, that overlap [start, end) of a contig, with the number of the
    block each was read from. A file is read from the first record of the windows on, up to the first one behind the region."""
    from ..functions.columns import reference_length

    near = index.filter((F.col("ref") == contig) & F.col("window").between(start // WINDOW, (end - 1) // WINDOW))
    begins = near.groupBy("path").agg(F.min(F.struct("block", "inner")).alias("at")).select("path", "at.block", "at.inner")

    def run(batches):
        for batch in batches:
            for uri, block, inner in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, where = file_system(uri)
                with system.open_input_file(where) as source:
                    yield from _tables(_until(source, block, inner, contig, end), True)

    found = begins.repartition("path").mapInArrow(run, SCHEMA + ", block long, inner long")
    return found.filter(F.col("pos") + F.greatest(reference_length(F.col("cigar")), F.lit(1)) > start).drop("inner")


def _until(source, block: int, inner: int, contig: str, end: int):
    names, _ = header(source)
    data = Bytes(source, block)
    data.fill(inner)
    data.at = inner
    while data.fill(1):
        at = data.where()
        row = _row(data.take(struct.unpack("<i", data.take(4))[0]), names)
        if row[2] != contig or row[3] >= end:
            return
        yield *at, row


def write_alignments(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Alignments as a table in the order of contig and position, in files of contiguous ranges."""
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "ref", "pos")
    ranged.sortWithinPartitions("ref", "pos").write.mode("overwrite").parquet(path)


def fetch(spark: SparkSession, path: str, contig: str, start: int, end: int, longest: int = 1000) -> DataFrame:
    """The alignments of a written table that overlap [start, end) of a contig; the filter on position, by which row
    groups are skipped, reaches back by the longest stretch of reference that an alignment covers."""
    from ..functions.columns import reference_length

    near = spark.read.parquet(path).filter((F.col("ref") == contig) & (F.col("pos") < end) & (F.col("pos") > start - longest))
    return near.filter(F.col("pos") + F.greatest(reference_length(F.col("cigar")), F.lit(1)) > start)
