import io
import itertools
import random
import uuid
import zlib
from collections import Counter
from hashlib import sha1

import pytest

from junctura.llm import warc as W
from junctura.llm.common import shared_dir


def rows():
    rnd = random.Random(3)
    big, hot = "<p>ä</p>" * 400, "x" * 1000
    out = [(1, "http://a/\r\nX: y", None, "c"), (2, None, "", "c"), (3, "http://b", "short", "c"), (4, "http://c", "short", None)]
    out += [(10 + i, f"http://d/{i}", hot, "c") for i in range(30)] + [(50, "u", "y" * 999, "c"), (51, "u", "y" * 999, "c"), (60, "u", big, "c"), (59, "u", big, "c"), (70, "u", "z" * 2_000_000, "c")]
    return out + [(100 + i, "http://r", "".join(rnd.choices("abcdefghij \n\r", k=rnd.randrange(3000))), "c") for i in range(60)] + [(300, "u", "WARC/1.1\r\n\r\n" * 3, "c")]


def test_write_and_read_by_splits(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").repartition(3)
    expected, last = {}, {}
    for i, _, h, _ in rows():
        last[h or ""] = max(last.get(h or "", 0), i)
    for i, _, h, _ in rows():
        h = h or ""
        again = len(h.encode()) >= 1000 and last[h] != i
        expected[i] = (len(h.encode()), sha1(h.encode()).hexdigest(), "revisit" if again else "response", last[h] if again else None)
    for split in (300, 5000, 1 << 22):
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        manifest = W.write_archives(W.with_revisits(pages), folder, archive_bytes=20_000)
        assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(rows())
        out = W.read_archives(manifest, folder, split_bytes=split).collect()
        assert len(out) == len(rows())
        html = {i: (h or "").encode() for i, _, h, _ in rows()}
        for r in out:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == expected[r.page_id]
            assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id]


def test_false_magic_is_skipped():
    a, b = W.record(1, "u", b"one", "d", None), W.record(2, "u", b"two", "d", None)
    noise = zlib.compress(W.MAGIC * 5)  # stands within the first record, as its payload
    odd = W.record(1, "u", b"x" + W.MAGIC * 5 + noise, "d", None, level=0)
    ids = lambda raw, x, y: [h["warc-record-id"] for h, _ in W.records_in(io.BytesIO(raw), x, y)]
    assert ids(odd + b, 1, len(odd + b)) == ["<urn:page:2>"] and ids(odd + b, 0, len(odd + b)) == ["<urn:page:1>", "<urn:page:2>"]
    assert len(ids(a + b, 1, len(a) + 1)) == 1 and not ids(a + b, 1, len(a))


def test_damage_is_found():
    parts = [W.record(i, "u", bytes(random.Random(i).randbytes(500)), "d", None) for i in range(4)]
    whole, at = b"".join(parts), [0, *itertools.accumulate(map(len, parts))]

    def read(raw, size):
        return sum(len(list(W.records_in(io.BytesIO(raw), k, k + size))) for k in range(0, len(raw), size))

    for size in (100, 700, 10_000):
        assert read(whole, size) == 4
        cut_off = whole[:-40]
        broken = whole[: at[1] + 300] + bytes(60) + whole[at[1] + 360 :]
        lost_head = whole[: at[2]] + bytes(30) + whole[at[2] + 30 :]
        between, before, behind = whole[: at[1]] + b"junk" + whole[at[1] :], b"junk" + whole, whole + b"junk"
        for bad in (cut_off, broken, lost_head, between, before, behind):
            with pytest.raises(W.ArchiveError):
                read(bad, size)


def test_repeated_ids_with_different_html_and_a_hot_payload(spark):
    hot = "h" * 2000
    rows = [(1, "u", "a" * 1500), (1, "u", "b" * 1500), (2, "u", "a" * 1500), (1, "u", "b" * 1500), *((10 + i, "u", hot) for i in range(500))]
    made = W.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = Counter((r.page_id, bytes(r.payload[:1]), r.refers_to) for r in made)
    want = Counter({(1, b"a", 2): 1, (1, b"b", None): 2, (2, b"a", None): 1, (509, b"h", None): 1}) + Counter((10 + i, b"h", 509) for i in range(499))
    assert got == want


def test_empty_table(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(W.with_revisits(pages), folder), folder).count() == 0
