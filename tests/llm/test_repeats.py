import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline as C
from junctura.llm import repeats as R


def brute(rows):
    n = R.LEAST
    seen = Counter(raw[i : i + n] for _, raw in rows for i in range(len(raw) - n + 1))
    out = []
    for i, raw in rows:
        hit = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                hit[k : k + n] = True
        rest = bytes(b for b, h in zip(raw, hit, strict=False) if not h)
        out.append((i, len(raw), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), sha256(rest).hexdigest()))
    return sorted(out)


def corpus(seed=1):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choices("abcdefgh é\n", k=n))
    passage, edge, under = make(450), make(395), make(360)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "y" * 1500, "ab" * 700, "abc " * 300, make(399), "\x00" * 500]
    texts += [make(rnd.randrange(600)) + passage + make(rnd.randrange(600)) for _ in range(40)]
    texts += [make(rnd.randrange(300)) + edge + make(rnd.randrange(300)) for _ in range(12)]
    texts += [make(50) + under + make(300) for _ in range(6)]
    for _ in range(6):
        base = make(rnd.randrange(300, 2500))
        texts += [base] * rnd.randrange(1, 4)
        for _ in range(5):
            k = rnd.randrange(len(base))
            texts.append(base[:k] + rnd.choice("XYZ") + base[k + 1 :])
    twice = make(700)
    texts.append(make(100) + twice + make(30) + twice + make(10))
    return texts


def test_suffix_order_and_classes():
    rnd = random.Random(3)
    for k in range(12):
        text = bytes(rnd.choices(range(0, 2 + 50 * (k % 3)), k=rnd.randrange(1, 300))) * (1 + k % 4)
        least = rnd.choice([1, 2, 5, 17, 60])
        order, group = R.common_prefix_classes(np.frombuffer(text, np.uint8), least)
        heads = [text[i : i + least] for i in order]
        assert heads == sorted(heads)
        assert group.tolist() == np.cumsum([True] + [a != b for a, b in zip(heads, heads[1:], strict=False)]).tolist()


@pytest.mark.parametrize("group", [1024, 3])
def test_query_equals_brute_force(spark, monkeypatch, tmp_path, group):
    monkeypatch.setattr(R, "GROUP", group)
    rows = [(i, t, "clash") for i, t in enumerate(corpus())] + [(1000, "z1 " * 200, "r"), (1000, "z1 " * 200, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in R.query(spark, str(tmp_path)).drop("text").collect())
    assert got == brute([(i, (t or "").encode()) for i, t, _ in rows])


def test_remove_and_empty_table(spark):
    copy = "".join(random.Random(1).choices("abcdef ", k=900))
    rows = [(1, copy, "a"), (2, "left " + copy, "b"), (3, None, "c"), (4, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    assert sorted(tuple(r) for r in R.remove_repeats(df).collect()) == [(2, "left ", "b"), (3, None, "c"), (4, "short", "d")]
    assert R.remove_repeats(df.limit(0)).count() == 0


def brute_words(texts, n=51):
    """Texts without the words covered by n-word strings that start twice or more."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for t in texts]
    words = [[t.encode()[a:b] for a, b in p] for t, p in zip(texts, places, strict=True)]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for t, p, w in zip(texts, places, words, strict=True):
        hit = np.zeros(len(w) + 2, int)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i + 1 : i + 1 + n] = 1
        edge = np.diff(hit)
        raw, rest, at = t.encode(), b"", 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            rest, at = rest + raw[at : p[a][0]], p[b - 1][1]
        rest += raw[at:]
        out.append(rest.decode() if rest.strip() or rest == raw else None)
    return out


@pytest.mark.parametrize("group", [1024, 3])
def test_pipeline_stage_cuts_passages_of_over_50_words(spark, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP", group)
    rnd = random.Random(8)
    make = lambda n, k: " ".join("".join(rnd.choices("abcdéfghij", k=k)) for _ in range(n))
    usual, least, under, long = make(51, 5), make(51, 1), make(50, 9), make(70, 6)
    texts = [f"{make(40, 6)}\n {x} {make(40, 6)}" for x in [usual, least, under, long] * 6]
    texts += [f"{make(5, 6)} {x.replace(' ', '  ')}\t{make(300, 6)}" for x in [usual, under]]
    own = make(60, 4)
    texts += [f"{own} {make(9, 3)} {own}", make(60, 4), "w " * 49, "v " * 52, "u " * 500, "", " \n", make(200, 5)]
    base = make(150, 5)
    texts += [base] * 3 + [base.replace(" ", "\n")] + [" ".join(base.split()[:k] + ["X"] + base.split()[k:]) for k in (20, 75, 99)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in C.drop_repeats(spark, df, "").collect()}
    want = {i: t for i, t in enumerate(brute_words(texts)) if t is not None}
    assert got == want
    assert all((x in got[i]) == (x is under) for i, x in enumerate([usual, least, under, long] * 6))


def test_query_returns_the_text_without_passages(spark, tmp_path):
    rnd = random.Random(4)
    make = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))
    passage = make(55)  # 329 bytes
    rows = [(i, f"{make(30)} {passage} {make(30)}") for i in range(5)] + [(9, make(100)), (10, None), (11, passage), (11, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in R.query(spark, str(tmp_path)).collect()]
    assert len(got) == 9 and all(r.n_removed == 0 and (passage not in (r.text or "")) for r in got)
    assert {r.doc_id: r.text for r in got if r.doc_id in (9, 10, 11)} == {9: rows[5][1], 10: None, 11: ""}


def test_all_anchors_are_dealt_out_once(spark, monkeypatch):
    # each anchor went through a shuffle by text and one by key while the scan's table stood beside them
    plans, staged = {}, R.staged_alone
    monkeypatch.setattr(R, "staged_alone", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and staged(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
        R.repeated_spans(docs, searches=R.SEARCHES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    from_scan = {name: plan.count("Exchange hashpartitioning") for name, plan in plans.items() if "Generate explode(arrays_zip" in plan}
    assert len(from_scan) == 2
    assert max(from_scan.values()) == 2, "all anchors on one side, the keys that occur twice on the other"


def test_places_are_packed_without_loss(spark):
    # offsets of a long least need over eight bits, and two of four equal rows with one id are copies too
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, text), (1, text), (2, "x " + text), (3, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(tuple(r) for r in R.remove_repeats(docs, 2000).collect())
    assert left == [(2, "x "), (3, "y z")]
