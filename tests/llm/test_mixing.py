import random
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from junctura.llm import mixing as M

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {}}


def shares(budget, children):
    """Shares by repeated rounds: children (name, weight, capacity)."""
    out, open_ = {}, list(children)
    while True:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * total <= budget * c[1]]
        if not full:
            break
        for n, _, c in full:
            out[n] = c
            budget -= c
        open_ = [c for c in open_ if c not in full]
        if not open_:
            return out
    return out | {n: budget * w // total for n, w, _ in open_}


def brute(leaves, percent, epochs):
    budgets = {(): sum(leaves.values()) * percent // 100}
    for k, level in enumerate(M.LEVELS):
        nxt = {}
        for node, budget in budgets.items():
            caps = Counter()
            for leaf, t in leaves.items():
                if leaf[:k] == node:
                    caps[leaf[k]] += t * epochs
            nxt |= {(*node, n): b for n, b in shares(budget, [(n, WEIGHTS[level].get(n, 1), c) for n, c in caps.items()]).items()}
        budgets = nxt
    return budgets


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * rnd.randrange(0, 60)), rnd.choice(["en", "en", "en", "de", None]), f"{rnd.choice('aab')}{rnd.randrange(4)}") for i in range(n)]


def test_mix_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent, epochs in ((40, 1), (90, 2), (150, 3), (400, 2)):
        got = defaultdict(list)
        for r in M.mix(df, F.substring("source", 1, 1), WEIGHTS, percent, epochs, seed=5).collect():
            got[r.doc_id].append(r.epoch)
        leaves = Counter()
        members = defaultdict(list)
        for i, t, lang, source in rows:
            leaf = (source[0], lang or "unknown", source)
            leaves[leaf] += len(t.split())
            members[leaf].append((i, len(t.split())))
        expected = defaultdict(list)
        for leaf, budget in brute(leaves, percent, epochs).items():
            if not budget or not leaves[leaf]:
                continue
            whole, rest = divmod(budget, leaves[leaf])
            upto = 0
            for i, n in sorted(members[leaf], key=lambda m: (md5(f"5:{whole}:{m[0]}".encode()).hexdigest(), m[0])):
                upto += n
                chosen = list(range(whole)) + ([whole] if rest and upto <= rest else [])
                if chosen:
                    expected[i] = chosen
        assert {k: sorted(v) for k, v in got.items()} == dict(expected), (percent, epochs)


def test_cases(spark):
    rows = [(1, None, None, None, 9), (2, "", "en", "a1", 9), (3, "a b", "en", "a1", 9), (3, "a b", "en", "a1", 9), (4, "x " * 50_000, "de", "b1", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    out = M.mix(df, F.substring("source", 1, 1), WEIGHTS, 100, 1)
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 3, 4] and "epoch" in out.columns
    assert M.mix(df.limit(0), F.col("source")).count() == 0
