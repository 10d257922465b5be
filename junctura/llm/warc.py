"""WARC archives: writer with revisit records, and a splittable reader.

Writer: every page becomes a gzip member of its own in archives of the shared folder; of pages with equal payloads of
at least MIN_REVISIT bytes the one with the largest id is the response and the others refer to it. A task writes its
archives under names of its own attempt and hands them over in a manifest, so a lost or repeated task leaves no
record twice. Reader: tasks take byte ranges of archives, scan for the gzip magic, accept a candidate only if a WARC
header can be decoded there, and own the records that start inside their range (a record may end beyond it). Archives
are gapless: a record that does not decode to its end, one that is not followed by another or by the end of the file,
and an archive that does not begin with one raise ArchiveError, so no record is lost in silence.

Cases: an empty table gives no archive and no rows. Very long payloads are read in chunks. Null html is an empty payload. Payloads below the bound are all responses. Rows that repeat a page's id are
responses if the id is the largest, else revisits; with different html each row goes by its own payload. A null url is written as an empty one, control characters in it as
percent codes. Further columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from hashlib import sha1

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, staged

NAME = "op8_warc"
MIN_REVISIT = 1000
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
#: Bytes of a split: so that each core has a few, within these bounds; and the most tasks, each with as many splits as it takes.
LEAST_SPLIT, LARGEST_SPLIT, MOST_TASKS = 4 << 20, 128 << 20, 100_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class ArchiveError(ValueError):
    pass


def file_system(uri: str):
    """The file system of a shared folder and the path in it; executors and driver call it alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 3) -> bytes:
    """A gzip member with one response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page, "url", body.alias("payload"), F.sha1(body).alias("digest"))
    own = pages.select(page, F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= MIN_REVISIT)
    last = own.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # only ids meet by payload; the pages themselves are dealt out by their ids, however many share one
    again = own.join(last, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of with_revisits()'s rows; the manifest: path, bytes, records."""

    def run(batches):
        import pyarrow as pa

        fs, root = file_system(folder)
        task = TaskContext.get()
        stem = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(root, recursive=True)
        made, out, size, records = [], None, 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path, size, records = f"{stem}-{len(made):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, records))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "bytes", "records"])

    return staged(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "manifest")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _member(source, at: int):
    """The decoded member that starts at a position and the position behind it; None if no WARC record starts there."""
    source.seek(at)
    z, parts, seen = zlib.decompressobj(31), [], 0
    while not z.eof:
        raw = source.read(CHUNK if seen else 1 << 15)
        if not raw:
            if not parts:
                return None
            raise ArchiveError(f"the record at byte {at} is cut off")
        seen += len(raw)
        try:
            parts.append(z.decompress(raw))
        except zlib.error as e:
            if not parts:
                return None
            raise ArchiveError(f"the record at byte {at} is damaged: {e}") from e
        if len(parts) == 1 and not parts[0].startswith(b"WARC/1."):
            return None
    data = b"".join(parts)
    head, gap, block = data.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError(f"the record at byte {at} has no end of its header")
    return _headers(head), block[:-4], at + seen - len(z.unused_data)


def _starts_here(source, at: int) -> bool:
    """Whether a WARC record or the end of the file is at a position."""
    source.seek(at)
    raw = source.read(1 << 15)
    if not raw:
        return True
    try:
        return zlib.decompressobj(31).decompress(raw).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(source, start: int, end: int):
    """(headers, block) of the records that start in [start, end) of an open archive."""
    at, first = start, True
    while at < end:
        found = _member(source, at)
        if found is not None:
            yield found[0], found[1]
            at, first = found[2], False
            continue
        if not first or at == 0:
            if _starts_here(source, at) and at:
                return  # the end of the file
            raise ArchiveError(f"no record at byte {at}")
        # a range that begins within a record: look for the next magic behind this position
        source.seek(at + 1)
        buffer = source.read(CHUNK)
        hit = buffer.find(MAGIC)
        if hit >= 0:
            at += 1 + hit
        elif len(buffer) < CHUNK:
            return
        else:
            at += 1 + len(buffer) - len(MAGIC)
    if not first and not _starts_here(source, at):
        raise ArchiveError(f"no record at byte {at}")


def read_archives(manifest: DataFrame, folder: str, split_bytes: int | None = None, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits)."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    if split_bytes is None:
        split_bytes = min(max(total // (4 * manifest.sparkSession.sparkContext.defaultParallelism), LEAST_SPLIT), LARGEST_SPLIT)
    starts = F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))
    splits = manifest.filter("bytes > 0").select("path", F.explode(starts).alias("start"))
    # dealt to tasks by number: by their own bytes these rows would all be put into one
    splits = splits.repartition(min(max(1, total // split_bytes), MOST_TASKS))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def run(batches):
        import pyarrow as pa

        fs, _ = file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
        page = lambda v: int(v.strip("<>").rpartition(":")[2])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(path) as source:
                    for head, block in records_in(source, start, start + split_bytes):
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        if kind == "response" and (len(body) != size or sha1(body).hexdigest() != digest):
                            raise ArchiveError(f"damaged payload in {path}")
                        refers = page(head["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page(head["warc-record-id"]), head["warc-target-uri"], size, digest, kind, refers, body if kind == "response" else None)[: len(names)])
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return splits.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_archives(manifest, folder, payload=False).drop("url")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::bigint AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN last END AS refers_to
FROM m
"""
