import random
from itertools import combinations

from junctura.llm import components as C
from junctura.llm import minhash_forest as M


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    all_sets = [sets(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(all_sets[a] & all_sets[b])
        if both and 100 * both >= 75 * len(all_sets[a] | all_sets[b]):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(rows, all_sets, strict=True)}


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(2, 7)))
    texts = [None, "", " \t\n", "one", "One", "ONE two", "one  two", "É x", "é x", "a b c d e", "A B C\nD E", "w " * 5000, "w " * 4000]
    hot = [word() for _ in range(120)]
    for _ in range(80):  # a chain of near copies of one text
        hot = hot[:]
        hot[rnd.randrange(len(hot))] = word()
        texts.append(" ".join(hot))
    for _ in range(25):
        base = [word() for _ in range(rnd.randrange(30, 300))]
        texts.append(" ".join(base))
        for n in (0, 1, 2, 3, 5, 8):
            copy = base[:]
            for _ in range(n):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if n == 0 else "\n".join(copy))
    texts.append(" ".join(word() for _ in range(20_000)))
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_pairs_among_texts_that_share_boilerplate(spark):
    rnd = random.Random(7)
    words = lambda n: ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)]
    base = words(120)
    texts = [base + words(21) for _ in range(500)]  # 0.734 alike, no near-duplicates
    for _ in range(20):
        own = words(21)
        texts += [base + own, base + own[:3] + words(18)]  # 0.768 alike
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(rows)
    assert sum(not kept for *_, kept in want.values()) == 20
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in M.near_duplicates(df).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    base = [f"w{i}" for i in range(40)]
    one, two, other = " ".join(base), " ".join([*base[:39], "x"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one), (5, two), (5, other), (7, other), (8, other)]
    got = [sorted(tuple(r) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()) for n in (1, 4)]
    compared = min((two, other), key=lambda t: M.set_hash(M.shingle_sets([t])[0]))
    own = 1 if compared == two else 5
    want = [(1, 36, 1, True), (5, 36, own, own == 5), (5, 36, 5, True), (7, 36, 5, False), (8, 36, 5, False)]
    assert got[0] == got[1] == sorted(want)


def test_recall_in_a_crowded_region_of_short_boilerplate(spark):
    rnd = random.Random(12)
    words = lambda n: ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)]
    base = words(60)
    texts = [base + words(20) for _ in range(300)]  # under the threshold to each other
    for _ in range(30):
        own = words(20)
        k = rnd.randrange(1, 4)
        texts += [base + own, base + own[:-k] + words(k)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(not kept for *_, kept in want.values()) >= 25


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(2000, 2100)] + [(5000, 5000), (7000, 6999), (6999, 7000)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(2000, 2100)) and got[7000] == 6999 and 5000 not in got
