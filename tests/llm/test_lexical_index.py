import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from junctura.llm import lexical_index as L

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c), doc))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, doc, score) for r, (score, doc) in enumerate(best)]
    return sorted(out, key=str)


def searched(spark, docs, items, k, block_bytes=L.BLOCK_BYTES):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    return sorted((tuple(r) for r in L.search(L.build(d.select("doc_id", "text", "block"), block_bytes), q, k).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    words = ["the", "of", *[f"w{i}" for i in range(30)], "É", "世界", "Don't", "x-1"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, [9, 6, *[1] * 34], k=n))
    docs = [(i, text(rnd.randrange(0, 40))) for i in range(300)] + [(7, "the the w1"), (7, "the the w1"), (None, "the w2 w3"), (900, None), (901, "--- "), (902, "the " * 3000)]
    docs += [(i, "same words w5 w6") for i in range(1000, 1050)]
    items = [(i, text(rnd.randrange(1, 25))) for i in range(12)] + [(50, "w5 w6 W5 w5"), (51, "absent"), (52, None), (53, "!"), (50, "w5 w6 W5 w5"), (50, "the")]
    want = brute(docs, items, 20)
    assert searched(spark, docs, items, 20) == want and len(want) > 100
    monkeypatch.setattr(L, "GROUP_ITEMS", 4)
    for size in (600, 5000):  # many blocks, and more sets of items than one
        assert searched(spark, docs, items, 20, size) == want
    assert searched(spark, [], items, 20) == searched(spark, docs, [], 20) == searched(spark, [(1, None)], items, 20) == []


def test_sums_of_slices():
    rnd = np.random.default_rng(2)
    sums, want = L.Sums(5, 300, 40), np.zeros((5, 300), np.int64)
    for _ in range(60):
        slots = np.sort(rnd.choice(300, rnd.integers(1, 200), replace=False))
        values = rnd.integers(0, 1 << int(rnd.integers(1, 30)), len(slots))
        values[0] = max(values[0], 1)
        who, shift = np.sort(rnd.choice(5, rnd.integers(1, 5), replace=False)), int(rnd.integers(0, 3))
        sums.add(who, *L.sliced(slots, values), shift)
        want[np.ix_(who, slots)] += values << shift
    bits = sums.slices()
    got = sum(np.unpackbits(b.view(np.uint8), axis=1, bitorder="little")[:, :300].astype(np.int64) << i for i, b in enumerate(bits))
    assert (got == want).all()
    for k in (1, 7, 400):
        item, place, score = sums.top(k)
        for i in range(5):
            best = sorted(((-want[i, p], p) for p in range(300) if want[i, p]))[:k]
            assert sorted((-s, p) for j, p, s in zip(item, place, score, strict=True) if j == i) == best


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 50)
    text = "ab, cd " * 100 + "x" * 300 + " É-y"
    assert [t.decode() for part in L._terms(text.encode()) for t in part] == terms(text)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    res = con.execute(L.ORACLE_SQL)
    names = [c[0] for c in res.description]
    assert sorted(tuple(r) for r in L.query(spark, SF).select(*names).collect()) == sorted(res.fetchall())
