import random
import zlib
from hashlib import sha256

import pytest

from junctura.llm import transport_stream as T


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 168, 169, 170, 320, 352, 353, 354, 16384, 16385, 16448, 200_000])
def test_round_trip(size):
    text = "".join(random.Random(size).choices("abcä \n", k=size))
    n, payload = T.padded(text)
    stream = T.mux(payload)
    s = T.demux(stream)
    assert n == len(text.encode()) and s.payload == payload and len(payload) % 64 == 0 and payload
    assert len(s.pts) == len(s.random_access) == -(-len(payload) // T.UNIT) and s.pts == [T.TICKS * (i + 1) for i in range(len(s.pts))]
    assert s.programs == {1: T.PMT_PID}


def test_damage_is_found():
    stream = T.mux(bytes(range(256)) * 100)
    for bad in (stream[:-188] if False else stream[: 188 * 4] + stream[188 * 5 :], b"\x00" + stream[1:], stream[:20] + b"\x99" + stream[21:], stream[:100], b""):
        with pytest.raises(T.StreamError):
            T.demux(bad)


def test_crc_of_tables():
    assert T._crc32_mpeg(b"123456789") == 0x0376E6E7


def test_operator(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "ä" * 5000, "c"), (4, "x" * 300_000, None), (5, "x" * 300_000, None), (5, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = [r.asDict() for r in T.features(T.store(df)).collect()]
    assert len(out) == 6
    for r in out:
        n, payload = T.padded(rows[r["doc_id"] - 1][1])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == sha256(T.mux(payload)).hexdigest() and r["media_bytes"] == len(T.mux(payload))
    same = [{k: v for k, v in r.items() if k != "doc_id"} for r in out if r["doc_id"] >= 4]
    assert same[0] == same[1] == same[2]
    assert T.features(T.store(df.limit(0))).count() == 0
