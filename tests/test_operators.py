import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from junctura.operators import alignment, events, graph, greedy, joins, kmers, learning, matching, mechanisms, order, reads, scans, simulation, stats


def test_islands_and_union(spark):
    df = spark.createDataFrame([("a", p) for p in (10, 110, 211, 300)], "g string, p long")
    assert scans.islands(df, ["g"], "p", 100).agg({"cluster": "max"}).first()[0] == 2
    iv = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 2, 3), ("a", 11, 12)], "g string, s long, e long")
    assert sorted(tuple(r) for r in scans.interval_union(iv, ["g"], "s", "e").collect()) == [("a", 1, 9), ("a", 11, 12)]


def test_scans_over_bins(spark):
    rnd = random.Random(11)
    rows = [(g, rnd.randrange(3000), rnd.randrange(0, 90)) for g in "aab" for _ in range(120)] + [("c", 0, 2999), ("c", 5, 6), ("c", 2999, 3100), ("c", 3300, 3301)]
    iv = spark.createDataFrame([(i, g, s, s + n) for i, (g, s, n) in enumerate(rows)], "i long, g string, s long, e long")
    for size, gap in ((1_000_000, 0), (64, 0), (10, 7), (1, 1)):
        union, numbers = [], {}
        for g in "abc":
            last = None
            own = sorted((s, s + n) for k, s, n in rows if k == g)
            for s, e in own:
                if last is not None and s <= union[-1][2] + gap:
                    union[-1][2] = max(union[-1][2], e)
                else:
                    union.append([g, s, e])
                last = s
            for a, (s, _) in zip([None, *own], own, strict=False):
                numbers[g, s] = numbers.get((g, a and a[0]), 0) + (a is None or s - a[0] > gap)
        got = scans.interval_union(iv, ["g"], "s", "e", gap, size)
        assert sorted(map(list, got.collect())) == union
        gaps = [(x[0], x[2], y[1]) for x, y in zip(union, union[1:], strict=False) if x[0] == y[0] and y[1] - x[2] > 20]
        assert sorted(map(tuple, scans.interval_gaps(got, ["g"], "s", "e", 20, size).collect())) == gaps
        assert {(r.g, r.s): r.cluster for r in scans.islands(iv, ["g"], "s", gap, ["i"], bin_size=size).collect()} == numbers
        # no window has a whole contig as its key but those over the table of bins
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert all("__bin" in line for line in plan.split("\n") if "Window [" in line)


def test_ranks_over_ranges(spark):
    rnd = random.Random(12)
    rows = [(g, None if rnd.random() < 0.1 else rnd.randrange(30)) for g in "aaab" for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, v long")
    for by in ([], ["g"]):
        want = []
        for g in "ab" if by else [None]:
            own = [v for k, v in rows if g in (None, k)]
            low = lambda v: -1 if v is None else v
            want += [(low(v), sum(low(x) < low(v) for x in own) + (own.count(v) + 1) / 2) for v in own]
        got = scans.rank_avg(df, by, "v", "rk")
        assert sorted((-1 if r.v is None else r.v, r.rk) for r in got.collect()) == sorted(want)


def test_band_interval_and_asof_joins(spark):
    rnd = random.Random(1)
    a = [(i, rnd.choice("xy"), rnd.randrange(500)) for i in range(80)]
    b = [(i, rnd.choice("xy"), s := rnd.randrange(500), s + rnd.randrange(90)) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, k string, p long"), spark.createDataFrame(b, "j long, k string, s long, e long")
    for tol, strict in ((20, True), (20, False)):
        got = {(r.i, r.j) for r in joins.band_join(left, right, ["k"], "p", "s", tol, strict=strict).collect()}
        assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and (abs(x[2] - y[2]) < tol or not strict and abs(x[2] - y[2]) == tol)}
    got = [(r.i, r.j) for r in joins.interval_join(left, right, ["k"], "p", "s", "e", pad=5, bin_size=16).collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] - 5 <= x[2] <= y[3] + 5}
    assert len(got) == len(want) and set(got) == want
    for size in (1_000_000, 40, 1):
        got = {r.i: r.s for r in joins.asof_join(left, right, ["k"], "p", "s", slack=15, bin_size=size).collect()}
        assert got == {x[0]: max((y[2] for y in b if y[1] == x[1] and y[2] - 15 <= x[2]), default=None) for x in a}


def test_split_reads_and_truth(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randrange(900), rnd.choice("cd"), rnd.randrange(900)) for i in range(60)]
    ends = [(f"k{rnd.randrange(12)}", rnd.choice("ab"), rnd.choice("cd"), rnd.choice("ab"), rnd.randrange(900)) for _ in range(80)]
    r = spark.createDataFrame(rows, "id long, a_ref string, a_pos long, b_ref string, b_pos long")
    e = spark.createDataFrame(ends, "cl string, a_ref string, b_ref string, side string, pos long")
    got = {tuple(x) for x in joins.split_reads_to_clusters(r, e, "id", "cl", 60).collect()}
    hit = lambda x, c, side, p: any(y[:4] == (c, x[1], x[3], side) and abs(y[4] - p) < 60 for y in ends)
    assert got == {(x[0], c) for x in rows for c in {y[0] for y in ends} if hit(x, c, "a", x[2]) and hit(x, c, "b", x[4])}
    t = spark.createDataFrame([(1, "s", "a", 10, "b", 20), (2, "t", "a", 10, "b", 20), (3, "s", "a", 80, "b", 20)], "i long, sample string, ref1 string, pos1 long, ref2 string, pos2 long")
    c = spark.createDataFrame([("s", "b", 60, "a", 30)], "sample string, cref1 string, cpos1 long, cref2 string, cpos2 long")
    assert [x.i for x in joins.matched_truth(t, c, by=["sample"]).collect()] == [1]


def brute_matching(edges):
    best = 0.0
    for n in range(len(edges) + 1):
        for some in itertools.combinations(edges, n):
            ends = [v for a, b, _ in some for v in (a, b)]
            if len(ends) == len(set(ends)):
                best = max(best, sum(w for *_, w in some))
    return best


def test_matching_is_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randrange(2, 8)
        edges = [(a, b, rnd.randrange(1, 9) / 2) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5][:11]
        weight = {(a, b): w for a, b, w in edges}
        assert sum(weight[e] for e in graph.max_weight_matching(n, edges)) == brute_matching(edges)
    assert graph.max_weight_matching(4, [(0, 1, 3), (1, 2, 4), (2, 3, 3)]) == {(0, 1), (2, 3)}
    assert graph.max_weight_matching(0, []) == set()


def test_matching_of_any_size_meets_its_bound():
    rnd = random.Random(4)
    for n, p in ((13, 0.5), (40, 0.2), (90, 0.06), (120, 0.4)):
        edges = [(a, b, rnd.randrange(1, 25) / 2) for a, b in itertools.combinations(range(n), 2) if rnd.random() < p]
        weight, solver = {(a, b): w for a, b, w in edges}, matching.Matcher(n, edges)
        chosen = solver.solve()
        assert len({v for e in chosen for v in e}) == 2 * len(chosen)
        assert abs(sum(weight[e] for e in chosen) - solver.bound()) < 1e-6  # no matching weighs more
    for n in (2, 3, 19, 200):  # paths, by the recursion
        ws = [rnd.randrange(1, 9) / 2 for _ in range(n - 1)]
        best = [0.0, 0.0]
        for w in ws:
            best.append(max(best[-1], best[-2] + w))
        chosen = graph.max_weight_matching(n, [(i, i + 1, w) for i, w in enumerate(ws)])
        assert sum(ws[a] for a, _ in chosen) == best[-1]


def test_matching_per_component(spark):
    rnd = random.Random(5)
    edges = [(100 * c + a, 100 * c + b, rnd.randrange(1, 9) / 2) for c in range(30) for a, b in itertools.combinations(range(1 + c % 9), 2) if rnd.random() < 0.4]
    edges += [(9001, 9000, 2.0), (9002, 9003, 1.0)]
    got = graph.matching_per_component(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    want = sum(brute_matching([e for e in edges if e[0] // 100 == c]) if c > 29 else brute_total([e for e in edges if e[0] // 100 == c]) for c in {e[0] // 100 for e in edges})
    ends = [v for r in got for v in (r.src, r.dst)]
    assert len(ends) == len(set(ends)) and sum(r.weight for r in got) == want


def brute_total(edges):
    """Greatest weight by recursion over the first vertex."""
    if not edges:
        return 0.0
    v = edges[0][0]
    best = brute_total([e for e in edges if v not in e[:2]])
    for a, b, w in edges:
        if v in (a, b):
            best = max(best, w + brute_total([e for e in edges if not {a, b} & set(e[:2])]))
    return best


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100


@pytest.mark.parametrize("quad, p", [((8, 2, 1, 5), 0.034965), ((30, 70, 12, 90), 0.001689)])
def test_fisher(spark, quad, p):
    df = spark.createDataFrame([quad], "a long, b long, c long, d long")
    assert round(stats.fisher_exact(df, "a", "b", "c", "d").first().p_value, 6) == p


def test_local_scores_of_documented_rows():
    x, y = "GTGTCGGGGCTTATGATAATCATATCTTATTTTTC", "GTGTCGGGGCTTATGATAATCATATCTTTTTTTTC"
    assert round(alignment.local_score(x, y) / len(x), 3) == 1.857
    x, y = "TACGCGGAGGGATTATGGGAATGCTCACGGCAATCGAAATGGGAA", "CCCGCGGCGGGATTATGGGAATGCTCACGGCAATCGAAATGGGAA"
    assert alignment.local_score(x, y) / len(x) == 1.8


def naive_local(a, b, match=2, mismatch=-3, opening=5, extending=2):
    low = -(10**6)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)], [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            e[i][j] = max(h[i][j - 1] - opening, e[i][j - 1] - extending)
            f[i][j] = max(h[i - 1][j] - opening, f[i - 1][j] - extending)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if x == y else mismatch), e[i][j], f[i][j])
    return max(map(max, h))


def test_local_scores_against_the_recursion():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choices("ACGT", k=rnd.randrange(1, 30))) for _ in "xx")
        assert alignment.local_score(a, b) == naive_local(a, b)


def test_greedy_orders(spark):
    rows = [(1, "a", 100, "b", 100), (2, "a", 140, "b", 140), (3, "a", 180, "b", 180), (4, "b", 105, "a", 95)]
    df = spark.createDataFrame(rows, "row_id long, from_ref string, from_pos long, to_ref string, to_pos long")
    assert sorted(r.row_id for r in greedy.drop_near_repeats(df).collect()) == [1, 3]
    raw = spark.createDataFrame([(1, "a", 10, "b", 20, "True", 2), (2, "b", 25, "a", 15, "True", 3), (3, "a", 10, "b", 20, "False", 1)], "row_id long, ref1 string, pos1 long, ref2 string, pos2 long, reverse string, support long")
    got = sorted((r.reverse, r.p1, r.p2, r.support) for r in greedy.merge_raw_clusters(raw).collect())
    assert got == [("False", [10], [20], 1), ("True", [10, 15], [20, 25], 5)]
    pos = spark.createDataFrame([("a", p) for p in (0, 100, 350, 5000)], "c string, p long")
    assert sorted((r.p, r.anchor) for r in order.running_mean_merge(pos, "c", "p", 300).collect()) == [(0, 151), (100, 151), (350, 151), (5000, 5000)]


def brute_repeats(rows, near=50):
    kept = []
    for r in sorted(rows):
        spelled = [r[1:], (r[3], r[4], r[1], r[2])]
        if not any(k[1] == a and k[3] == b and abs(k[2] - p) < near and abs(k[4] - q) < near for k in kept for a, p, b, q in spelled):
            kept.append(r)
    return kept


def brute_raw(rows, near=50):
    pairs, out = {}, []
    for i, r1, p1, r2, p2, rev, n in sorted(rows):
        a, clusters = pairs.setdefault(frozenset((r1, r2)), ((r1, r2), []))
        x, y = (p1, p2) if r1 == a[0] else (p2, p1)
        joined = [c for c in clusters if c[0] == rev and abs(c[1] - x) < near and abs(c[2] - y) < near]
        if not joined:
            joined = [[rev, x, y, set(), set(), 0]]
            clusters += joined
        for c in joined:
            c[3].add(x)
            c[4].add(y)
            c[5] += n
    for a, clusters in pairs.values():
        out += [(*a, c[0], sorted(c[3]), sorted(c[4]), c[5]) for c in clusters]
    return sorted(out)


def test_greedy_orders_against_whole_groups(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("ab"), rnd.randrange(600), rnd.choice("ab"), rnd.randrange(600)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, from_ref string, from_pos long, to_ref string, to_pos long").repartition(3)
    assert sorted(tuple(r) for r in greedy.drop_near_repeats(df).collect()) == brute_repeats(rows)
    # a contig pair without gaps, and points that lie on one another: few rounds, whatever the number of rows
    gapless = [(i, "a", p, "b", p + rnd.randrange(3)) for i, p in enumerate(rnd.sample([*range(0, 9000, 6)] * 2, 3000))]
    rounds: list[int] = []
    df = spark.createDataFrame(gapless, "row_id long, from_ref string, from_pos long, to_ref string, to_pos long")
    kept = greedy.drop_near_repeats(df, rounds=rounds)
    assert sorted(tuple(r) for r in kept.collect()) == brute_repeats(gapless) and len(rounds) <= 12
    assert "InPandas" not in kept._jdf.queryExecution().executedPlan().toString()
    raw = [(i, a, p, b, q, rnd.choice(["True", "False"]), rnd.randrange(5)) for i, a, p, b, q in rows]
    df = spark.createDataFrame(raw, "row_id long, ref1 string, pos1 long, ref2 string, pos2 long, reverse string, support long").repartition(3)
    assert sorted(tuple(r) for r in greedy.merge_raw_clusters(df).collect()) == brute_raw(raw)
    points = [(rnd.choice("ab"), rnd.randrange(20_000)) for _ in range(300)]
    want = []
    for c in "ab":
        members, anchor = [], None
        for p in [*sorted(p for k, p in points if k == c), None]:
            if p is not None and anchor is not None and p - anchor < 80:
                members.append(p)
                anchor = sum(members) // len(members) + 1
            else:
                want += [(c, m, anchor) for m in members]
                members, anchor = [p], p
    got = order.running_mean_merge(spark.createDataFrame(points, "c string, p long"), "c", "p", 80).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    segs = [(rnd.choice("ab"), i, rnd.randrange(400), rnd.randrange(400, 800), rnd.choice("xyz")) for i in range(300)]
    want = []
    for g in "ab":
        clusters = []
        for _, i, s, e, x in sorted((r for r in segs if r[0] == g), key=lambda r: r[1]):
            c = next((c for c in clusters if abs(c[0] - s) < 50 and abs(c[1] - e) < 50), None)
            if c is None:
                clusters.append([s, e, 1, {x}])
            else:
                c[2] += 1
                c[3].add(x)
        want += [(g, c[0], c[1], c[2], len(c[3])) for c in clusters]
    got = greedy.merge_segments(spark.createDataFrame(segs, "g string, row_id long, start long, end long, recipient string"), ["g"]).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_corrections(spark):
    rnd = random.Random(7)
    rows = [(g, rnd.choice([0.001, 0.01, 0.02, 0.3, 1.0, rnd.random()])) for g in "ab" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, p double")
    for by in ([], ["g"]):
        want = []
        for g in ["a", "b"] if by else [None]:
            ps = sorted(p for k, p in rows if g in (None, k))
            want += [(p, round(min(1.0, min(x * len(ps) / (i + 1) for i, x in enumerate(ps) if x >= p)), 12)) for p in ps]
        assert sorted((r.p, round(r.q_value, 12)) for r in stats.benjamini_hochberg(df, "p", by).collect()) == sorted(want)
        n = 40 if by else 80
        assert sorted((r.p, r.p_adj) for r in stats.bonferroni(df, "p", by).collect()) == sorted((p, min(1.0, p * n)) for _, p in rows)


def test_crowded_clusters_in_the_plane(spark):
    rnd = random.Random(8)
    pts = [(i, "r", rnd.randrange(900), rnd.randrange(900)) for i in range(250)]
    df = spark.createDataFrame(pts, "point long, k string, pos long, mate_pos long")
    for eps in (1, 37, 60):
        label = {p[0]: p[0] for p in pts}
        changed = True
        while changed:
            changed = False
            for x, y in itertools.combinations(pts, 2):
                if (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 <= eps * eps and label[x[0]] != label[y[0]]:
                    label[x[0]] = label[y[0]] = min(label[x[0]], label[y[0]])
                    changed = True
        assert {r.point: r.cluster for r in alignment.cluster_pairs(df, ["k"], eps).collect()} == label


def test_global_alignments_against_the_recursion():
    rnd, pairs = random.Random(3), []
    for _ in range(300):
        a, b = ("".join(rnd.choices("ACG", k=rnd.randrange(0, 13))) for _ in "xx")
        n, m, low = len(a), len(b), -1e9
        best, up, side = ([[v] * (m + 1) for _ in range(n + 1)] for v in (0.0, low, low))
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                up[i][j] = max(best[i - 1][j] - (0 if j == m else 5), up[i - 1][j] - (0 if j == m else 2))
                side[i][j] = max(best[i][j - 1] - (0 if i == n else 5), side[i][j - 1] - (0 if i == n else 2))
                best[i][j] = max(best[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2), up[i][j], side[i][j])
        pairs.append((a, b))
        score, x, y = alignment.global_alignment(a, b)
        assert score == best[n][m] and (x.replace("-", ""), y.replace("-", "")) == (a, b)
    # many at a time, of all shapes
    pairs += [("".join(rnd.choices("ACG", k=30)), "".join(rnd.choices("ACG", k=30))) for _ in range(200)]
    assert alignment.global_batch(*map(list, zip(*pairs, strict=True))) == [alignment.global_alignment(a, b) for a, b in pairs]
    assert alignment.local_batch(*map(list, zip(*pairs, strict=True))) == [alignment.local_score(a, b) for a, b in pairs]
    assert alignment.homology_run("AC-GTTA", "ACTG-TA") == 2 and alignment.inserted_run("AC--GT-A-") == 2 and alignment.inserted_run("--ACG-") == 0


def test_windows_of_whole_sequences(spark):
    from types import SimpleNamespace

    from junctura.plans.kernels import window_pairs

    rnd = random.Random(8)
    seqs = {i: "".join(rnd.choices("ACGT", k=n)) for i, n in enumerate((95, 130, 0, 61, 60, 7))}
    v = SimpleNamespace(seqs=spark.createDataFrame([(f"c{i}", i, s) for i, s in seqs.items()], "contig string, n long, seq string"))
    pairs = [(f"c{i}", k, x, y) for i in range(5) for k in range(9) if (x := seqs[i][60 * k : 60 * k + 60]) and (y := seqs[i + 1][60 * k : 60 * k + 60])]
    got = window_pairs(v, 60)
    assert sorted(map(tuple, got.collect())) == sorted(pairs)
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = [(c, k, round(max(naive_local(x, y), naive_local(x, turned(y))) / len(x), 6)) for c, k, x, y in pairs]
    found = got.select("contig", "at", alignment.context_similarity("x", "y").alias("s")).collect()
    assert sorted((r.contig, r.at, round(r.s, 6)) for r in found) == sorted(want)
    runs = got.select("contig", "at", alignment.aligned_pair("x", "y").alias("p")).select("contig", "at", alignment.junction_runs("p.a", "p.b").alias("r")).collect()
    both = {(c, k): alignment.global_alignment(x, y)[1:] for c, k, x, y in pairs}
    brute = lambda a, b: max((len(list(g)) for ok, g in itertools.groupby(zip(a, b, strict=True), lambda p: "-" not in p) if ok), default=0)
    assert all(r.r.homology == brute(*both[r.contig, r.at]) for r in runs)


def test_local_batch_at_the_bounds_of_a_byte():
    rnd, same = random.Random(5), "ACGT" * 20
    pairs = [(same[:n], same[:n]) for n in (1, 59, 60, 61, 62, 63, 64, 80)] + [("a\x00b\x01", "\x00b\x01"), ("é\xffé", "\xffé"), ("\u0141x\u0141", "\u0141x"), ("\u0141x", "Ax"), ("", "A"), ("A", "")]
    pairs += [("".join(rnd.choices("ACG", k=rnd.randrange(55, 66))), "".join(rnd.choices("ACG", k=rnd.randrange(55, 66)))) for _ in range(60)]
    pairs += [(x, x[:20] + "TT" + x[20:50]) for x, _ in pairs[-20:]]
    assert alignment.local_batch(*map(list, zip(*pairs, strict=True))) == [alignment.local_score(a, b) if max(a + b) < "\u0100" and (a + b).isascii() else naive_local(a, b) for a, b in pairs]
    for costs in ((1, -1, 30, 2), (2, -3, 5, 5), (3, -120, 5, 2)):
        assert alignment.local_batch(*map(list, zip(*pairs[-60:], strict=True)), *costs) == [alignment.local_score(a, b, *costs) for a, b in pairs[-60:]]


def test_windows_are_made_once(spark):
    # each side of the join read the documents and made the sequences anew; the turned window was made letter by letter
    from junctura.plans import catalog

    plan = catalog.queries()["f17_context_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "regexp_extract_all" not in plan
    assert "translate(reverse" not in plan and plan.count("Join") == 1


def test_sequence_hashes_equal_those_of_columns(spark):
    rnd = random.Random(1)
    seqs = spark.createDataFrame([(f"c{i}", "".join(rnd.choices("ACGTNacg", (9, 9, 9, 9, 1, 1, 1, 1), k=i * 7))) for i in range(9)], "contig string, seq string")
    for k in (5, 12, 28):
        masks = kmers.coder(k, 3)
        want = kmers.hashes(kmers.kmers(seqs, k, ["contig"]), masks, ["contig", "pos"]).select("contig", "pos", "hash_no", "h").collect()
        got = kmers.sequence_hashes(seqs, k, masks, ["contig"], chunk=17).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(set(map(tuple, got)))


def test_peaks_bins_and_support(spark):
    rnd = random.Random(2)
    k, n = 6, 300
    hit = [int(rnd.random() < (0.9 if 80 < i < 160 else 0.2)) for i in range(n)]
    total = lambda j: sum(hit[max(0, j - 4) : j + 1]) if j >= 4 else 0
    want = set()
    for j in range(2 * k + 11, n):
        for m in range(k, 2 * k):
            if j - 5 - k >= 0 and j - 5 - m >= 0:
                d = total(j - 5) - total(j - 5 - k) + total(j - 5 - m) - total(j)
                want |= {j - m - 5} if d >= 2 else {j} if d <= -2 else set()
    hits = spark.createDataFrame([("c", i, h, 0) for i, h in enumerate(hit)], "contig string, pos long, any_hit int, all_hit int")
    contigs = spark.createDataFrame([("c", n)], "contig string, len long")
    for chunk in (1 << 16, 64, 17):
        found = kmers.peaks(hits, contigs, k, chunk=chunk)
        assert sorted(r.pos for r in found.collect()) == sorted(p for p in want if p >= 0) and want
    good = spark.createDataFrame([("c", 90, 170), ("c", 200, 230)], "contig string, start long, end long")
    inside = sorted(p for p in want if 90 <= p < 170 or 200 <= p < 230)
    first = {p // 50: p for p in reversed(inside)}
    assert sorted((r.pos, r.first) for r in kmers.binned_peaks(found, good).collect()) == [(p, first[p // 50]) for p in inside]
    votes = spark.createDataFrame([("c", 100, 1), ("c", 1600, 2), ("c", 3099, 1), ("c", 9000, 0), ("d", 700, 3)], "contig string, pos long, support int")
    assert sorted(tuple(r) for r in kmers.support_intervals(votes).collect()) == [("c", 1, 600), ("c", 1100, 3599), ("d", 200, 1200)]


def test_windows_from_runs(spark):
    rnd = random.Random(3)
    size, lens = 10, {"c": 400, "d": 9, "e": 60}
    hit = {c: [(x := int(rnd.random() < (0.95 if i // 70 % 2 else 0.3)), x * int(rnd.random() < 0.5)) for i in range(n)] for c, n in lens.items()}
    rows = [(c, i, *h) for c, hs in hit.items() for i, h in enumerate(hs) if h[0]]
    hits = spark.createDataFrame(rows, "contig string, pos long, any_hit int, all_hit int").repartition(3)
    contigs = spark.createDataFrame([*lens.items()], "contig string, len long")
    want = [(c, i) for c, hs in hit.items() for i in range(size - 1, len(hs)) if sum(h[0] for h in hs[i - size + 1 : i + 1]) >= 8 and sum(h[1] for h in hs[i - size + 1 : i + 1]) >= 4]
    for chunk in (1 << 16, 64, 10):
        runs = kmers.good_runs(hits, contigs, size, 0.8, 0.4, chunk)
        assert sorted((r.contig, p) for r in runs.collect() for p in range(r.a, r.b + 1)) == want and want
    assert sorted(map(tuple, kmers.good_windows(hits, contigs, size, 0.8, 0.4).collect())) == want
    found = []
    for c, i in want:
        s, e = max(i - 2 * size, 1), min(i + 2 * size, lens[c])
        if found and found[-1][0] == c and s - found[-1][2] < size:
            found[-1][2] = max(e, found[-1][2])
        else:
            found.append([c, s, e])
    assert sorted(map(list, kmers.good_intervals(runs, contigs, size).collect())) == found
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0" not in plan and all("chunk" in line for line in plan.split("\n") if "Window [" in line)


def test_peaks_of_hashes_and_their_votes(spark):
    rnd = random.Random(5)
    k, n_hashes = 8, 3
    ref = {c: "".join(rnd.choices("ACGT", k=260)) for c in ("c1", "c2", "c3")}
    reads = {f"r{i}": ref[a := rnd.choice([*ref])][(p := rnd.randrange(150)) : p + 50] + ref[rnd.choice([*ref])][q : q + 50] for i in range(25) for q in [rnd.randrange(150)]}
    masks = kmers.coder(k, n_hashes)
    table = lambda seqs: [(c, p, e, int(h)) for c, s in seqs.items() for pos, hs in [kmers.canonical_hashes(s, k, masks)] for e, own in enumerate(hs) for p, h in zip(pos.tolist(), own, strict=True) if h]
    index, asked = table(ref), table(reads)
    good = {"c1": [(20, 120), (150, 200)], "c2": [(0, 90)], "c3": [(60, 61), (70, 220)]}
    peaks = sorted({(c, rnd.randrange(250)) for c in ref for _ in range(60)})
    # the reference's order: peaks along each contig, one that shares the bin of the last one kept stands for it
    stand, last, binned = {}, None, []
    for c, p in peaks:
        if any(s <= p < e for s, e in good[c]):
            if last is None or (last[0], last[1] // 50) != (c, p // 50):
                last = (c, p)
            binned.append((c, p, last[1]))
            for at in range(p - 2, p + 1):
                for e in range(n_hashes):
                    for h in {x[3] for x in index if x[:3] == (c, at, e)}:
                        stand[h] = last
    seqs = lambda t: spark.createDataFrame([*t.items()], "contig string, seq string")
    own = kmers.sequence_hashes(seqs(ref), k, masks, ["contig"])
    assert sorted(map(tuple, own.collect())) == sorted(index)
    assert {r.h: r.n for r in kmers.hash_counts(seqs(ref), k, masks, chunk=100).collect()} == Counter(x[3] for x in index)
    intervals = spark.createDataFrame([(c, s, e) for c, x in good.items() for s, e in x], "contig string, start long, end long")
    found = kmers.binned_peaks(spark.createDataFrame(peaks, "contig string, pos long"), intervals)
    assert sorted(map(tuple, found.collect())) == sorted(binned)
    claims = kmers.peak_hashes(own, found, near=2)
    assert {r.h: (r.contig, r.pos) for r in claims.collect()} == stand
    votes = kmers.sequence_hashes(seqs(reads), k, masks, ["contig"]).withColumnsRenamed({"contig": "read_name", "pos": "pos_in_read"})
    got = {(x.contig, x.pos): x.support for x in kmers.read_votes(votes, claims).collect()}
    assert got == brute_votes(asked, [(h, c, p) for h, (c, p) in stand.items()], 6) and got


def test_graph_measures(spark):
    rnd = random.Random(3)
    edges = [(s, a, b) for s in "xy" for a, b in itertools.combinations(range(9), 2) if rnd.random() < 0.4] + [("z", 1, 2), ("z", 2, 2)]
    df = spark.createDataFrame(edges, "sample string, src long, dst long")
    rows = {r.sample: r for r in graph.graph_metrics(df, ["sample"]).collect()}
    fiedler = {r.sample: r.fiedler for r in graph.algebraic_connectivity(df, "sample").collect()}
    for s in "xyz":
        own = [(a, b) for k, a, b in edges if k == s and a != b]
        nodes = sorted({v for e in own for v in e})
        m = np.zeros((len(nodes), len(nodes)))
        for a, b in own:
            m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1
        d = m.sum(0)
        x, y = np.nonzero(m)
        corr = np.corrcoef(d[x], d[y])[0, 1] if len(set(d[x])) > 1 else None
        assert (rows[s].assortativity is None) == (corr is None) and (corr is None or abs(rows[s].assortativity - corr) < 1e-9)
        assert abs(fiedler[s] - np.linalg.eigvalsh(np.diag(d) - m)[1]) < 1e-9
        triples = (d * (d - 1) / 2).sum()
        assert abs(rows[s].transitivity - (np.trace(m @ m @ m) / 2 / triples if triples else 0)) < 1e-9


def test_groups_compared(spark):
    from junctura.plans.tests_of_association import compared_groups

    rnd = random.Random(4)
    rows = [(g, p, rnd.randrange(6) + (g == "b")) for g in "abc" for p in ("u", "v") for _ in range(8)]
    got = {(r.property, r.g1, r.g2): (r.p, r.q) for r in compared_groups(spark.createDataFrame(rows, "grp string, property string, value long")).collect()}
    for p in ("u", "v"):
        ps = {}
        for g1, g2 in [(a, b) for a in "abc" for b in "abc" if a >= b]:
            x, y = ([v for g, q, v in rows if (g, q) == (k, p)] for k in (g1, g2))
            both = sorted(x + y)
            rank = lambda v, both=both: both.index(v) + (both.count(v) + 1) / 2
            z = (sum(map(rank, x)) - len(x) * (len(x) + len(y) + 1) / 2) / (len(x) * len(y) * (len(x) + len(y) + 1) / 12) ** 0.5
            ps[g1, g2] = round(math.erfc(abs(z) / 2**0.5), 9)
        for k, v in ps.items():
            q = min(min(1.0, w * len(ps) / sum(u <= w for u in ps.values())) for w in ps.values() if w >= v)
            assert got[p, *k][0] == pytest.approx(v, abs=1e-8) and got[p, *k][1] == pytest.approx(q, abs=1e-8)


def test_markers_are_chosen_inside_each_fold(spark):
    rows = [(f"s{i}", f"C{i % 2}", float(i // 2 % 2)) for i in range(16)]
    # one tag tells the classes apart in the first cohort only, another in the second only
    tags = [(s, f"t{c}") for s, c, y in rows if y == 1.0] + [(s, "noise") for s, *_ in rows[::3]]
    labels, presence = spark.createDataFrame(rows, "sample string, cohort string, label double"), spark.createDataFrame(tags, "sample string, tag string")
    assert learning.markers(presence, labels.filter("cohort <> 'C1'"), 1) == ["tC0"] and learning.markers(presence, labels.filter("cohort <> 'C0'"), 1) == ["tC1"]
    scores, mean = learning.leave_one_out(presence, labels, n=1)
    assert scores == {"C0": 0.5, "C1": 0.5} and mean == 0.5
    row = learning.validated(presence, labels, presence, labels, n=2).first()
    assert row.auc == 1.0 and row.accuracy == 1.0 and row.false_positive_rate == 0.0


def test_rebuilt_and_verified_recipients(spark):
    refs = spark.createDataFrame([("r", "AAAACCCC"), ("d", "TTACGTTT")], "contig string, seq string")
    ev = spark.createDataFrame([(1, "r", 4, "d", 2, 5, "False"), (2, "r", 4, "d", 2, 5, "True"), (3, "r", 1, "d", 6, 20, "False")], "event_id long, receptor string, insert_locus long, donor string, delete_start long, delete_end long, reverse_flag string")
    got = {r.event_id: tuple(r)[1:] for r in simulation.rebuilt_recipients(ev, refs, window=3).collect()}
    assert got == {1: ("AAAACGCCC", 3, 6, True), 2: ("AAACGTCCC", 3, 6, True), 3: ("ATTAAA", 1, 3, False)}
    made = spark.createDataFrame([(i, 2000, 2500, n) for i, n in ((1, 4500), (2, 4500), (3, 9000), (4, 9000), (5, 4500))], "event_id long, left_junction long, right_junction long, length long")
    aligned = [(1, 100, 4400), (2, 0, 2300), (2, 2200, 4500), (3, 0, 2300), (3, 2200, 9000), (4, 0, 2100), (4, 2400, 9000), (5, 1980, 4400)]
    out = {r.event_id: (r.left_ok, r.right_ok, r.mapped, r.verified) for r in simulation.verified_junctions(made, spark.createDataFrame(aligned, "event_id long, t_start long, t_end long")).collect()}
    assert out == {1: (True, True, True, True), 2: (True, True, False, False), 3: (True, True, True, True), 4: (True, True, False, False), 5: (False, True, True, False)}


def test_simulation(spark):
    rnd = random.Random(5)
    seqs = spark.createDataFrame([(f"c{i}", "".join(rnd.choices("ACGT", k=400))) for i in range(40)], "contig string, seq string")
    original = {r.contig: r.seq for r in seqs.collect()}
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for r in simulation.simulate_transfers(seqs, 3, length=100, snp=0.0).collect():
        piece = original[r.donor][r.delete_start : r.delete_end]
        assert r.seq == original[r.receptor][: r.insert_locus] + (turn(piece) if r.reverse_flag == "True" else piece) + original[r.receptor][r.insert_locus :]
    long = spark.createDataFrame([("".join(rnd.choices("ACGT", k=20_000)),)], "s string")
    a = long.select("s", simulation.with_snps("s", 0.05, 1).alias("t"), simulation.with_indels("s", 0.1, 1).alias("u")).first()
    assert 0.03 < sum(x != y for x, y in zip(a.s, a.t, strict=True)) / 20_000 < 0.07 and len(a.u) != 20_000 and abs(len(a.u) - 20_000) < 400
    pairs = simulation.simulated_reads(seqs, 10, 50, 1).collect()
    assert len(pairs) == 40 * 40 and all(r.seq1 in original[r.contig] and turn(r.seq2) in original[r.contig] for r in pairs)
    grid = simulation.scenarios(spark, ("snp", "depth"), 2)
    assert grid.count() == 18 and grid.select("seed").distinct().count() == 18


def test_mechanisms(spark):
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choices("ACGT", k=n))
    flank = make(200)
    donors = {"d1": make(1000), "d2": make(200) + flank + make(400) + flank + make(100), "d3": make(1000), "d4": make(500) + "N" + make(499)}
    ev = [(1, "r", 50, "d1", 700, 300, "x"), (2, "r", 500, "d2", 300, 900, "x"), (3, "q", 5, "d3", 300, 700, "x"), (4, "q", 5, "d4", 450, 900, "x")]
    reads_ = [(1, "start", 2, donors["d1"][220:260] + make(12) + donors["d1"][260:300], "+"), (1, "start", 1, "ACGT", "+"), (3, "end", 1, donors["d3"][640:670] + "ACGTA" + donors["d3"][670:700], "+")]
    got = {r.event_id: r for r in mechanisms.mechanism_evidence(
        spark.createDataFrame(ev, "event_id long, receptor string, insert_locus long, donor string, delete_start long, delete_end long, reverse_flag string"),
        spark.createDataFrame([("r", 40, 60), ("d3", 0, 10)], "contig string, start long, end long"), spark.createDataFrame([("r", 490, 510)], "contig string, start long, end long"),
        spark.createDataFrame(list(donors.items()), "contig string, seq string"), spark.createDataFrame(reads_, "event_id long, side string, row_id long, seq string, strand string"),
    ).collect()}
    assert got[1].inserted >= 12 and got[1].del_mechanism == "FoSTeS/MMBIR" and got[1].ins_mechanism == "VNTR"
    assert got[2].homology == 200 and got[2].del_mechanism == "NAHR" and got[2].ins_mechanism == "TEI"
    assert got[3].inserted > 0 and got[3].ins_mechanism == "NA" and got[4].homology == 0 and got[4].del_mechanism == "NHEJ"


def test_down_sampled(spark):
    df = spark.createDataFrame([(f"r{i}", m, "ACGT" * 5) for i in range(2000) for m in (1, 2)], "read_name string, mate int, seq string")
    got = reads.down_sampled(df, 1, bases=20_000)
    assert 15_000 < 20 * got.count() < 25_000 and got.groupBy("read_name").count().filter("count <> 2").isEmpty()
    assert reads.down_sampled(df, 1, bases=10**9).count() == 4000 and got.count() == reads.down_sampled(df.repartition(7), 1, bases=20_000).count()


def test_clusters_in_the_plane(spark):
    pts = [(1, "r", 0, 0), (2, "r", 60, 79), (3, "r", 60, 80), (4, "r", 160, 180), (5, "q", 0, 0), (6, "r", 500, 500)]
    df = spark.createDataFrame(pts, "point long, k string, pos long, mate_pos long")
    got = {r.point: r.cluster for r in alignment.cluster_pairs(df, ["k"], 100).collect()}
    brute = {}
    for p in pts:
        seen, todo = {p[0]}, [p]
        while todo:
            x = todo.pop()
            for y in pts:
                if y[0] not in seen and x[1] == y[1] and (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 <= 10_000:
                    seen.add(y[0])
                    todo.append(y)
        brute[p[0]] = min(seen)
    assert got == brute


def test_event_branches(spark):
    base = ("S", "A", 1000, "head", "B", 5000, "tail", "False", 3)
    rows = [(1, *base), (2, "S", "A", 1010, "head", "B", 5600, "head", "False", 3), (3, "S", "B", 7000, "head", "A", 1005, "head", "True", 3), (4, "T", "A", 1000, "head", "B", 5600, "head", "False", 3)]
    df = spark.createDataFrame(rows, "bkp_id long, sample string, from_ref string, from_pos long, from_side string, to_ref string, to_pos long, to_side string, if_reverse string, cross_split_reads long")
    got = [(r.i, r.j, r.receptor, r.insert_locus, r.donor, r.delete_start, r.delete_end) for r in events.event_pairs(df).collect()]
    assert got == [(1, 2, "A", 1000, "B", 5000, 5600)]


def test_precise_breakpoint(spark):
    ref = "".join(random.Random(5).choices("ACGT", k=200))
    cl = spark.createDataFrame([(1, 1000, 1200, ref)], "cluster long, lo long, hi long, ref string")
    rd = spark.createDataFrame([(1, 1, "ACGT", True), (1, 2, ref[80:110], True), (1, 3, ref[10:40], False)], "cluster long, row_id long, clip string, right boolean")
    assert tuple(alignment.precise_breakpoints(cl, rd).first()) == (1, 1080, 2.0, 2)


def brute_votes(reads, peaks, least):
    support = {}
    for name in {r[0] for r in reads}:
        count, first = {}, {}
        for offset in sorted({r[1] for r in reads if r[0] == name}):
            chosen, most = None, 0
            for _, contig, pos in sorted((e, c, p) for n, o, e, h in reads if (n, o) == (name, offset) for g, c, p in peaks if g == h):
                if contig in count and count[contig] >= most:
                    chosen, most = (contig, pos), count[contig]
                elif contig not in count and chosen is None:
                    chosen, most = (contig, pos), 0
            if chosen:
                count[chosen[0]] = count.get(chosen[0], 0) + 1
                first.setdefault(*chosen)
        enough = {c: n for c, n in count.items() if n >= least}
        if len(enough) > 1:
            two = sorted(enough.values())[-2:]
            for c in enough:
                if enough[c] in two:
                    support[c, first[c]] = support.get((c, first[c]), 0) + 1
    return {(c, p): min(n, 254) for (c, p), n in support.items()}


def test_read_votes(spark):
    rnd = random.Random(9)
    tied = [("tied", i, 0, 1000 + i % 3) for i in range(9)]  # three contigs with three votes each
    reads = tied + [(f"r{i}", o, e, rnd.randrange(40)) for i in range(40) for o in range(30) for e in range(3)]
    peaks = [(1000, "x", 7), (1001, "y", 8), (1002, "z", 9)] + [(h, rnd.choice("abcde"), rnd.randrange(5)) for h in range(30) for _ in range(1 + h % 2)]
    peaks = sorted(set(peaks))
    r = spark.createDataFrame(reads, "read_name string, pos_in_read long, hash_no int, h long").repartition(3)
    p = spark.createDataFrame(peaks, "h long, contig string, pos long")
    got = {(x.contig, x.pos): x.support for x in kmers.read_votes(r, p, 3).collect()}
    assert got == brute_votes(reads, peaks, 3) and {("x", 7), ("y", 8), ("z", 9)} <= set(got)


def test_seeded_sample(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    one, again, other = (sorted(r.k for r in order.seeded_sample(d, "k", 20, seed).collect()) for d, seed in ((df, 3), (df.repartition(7), 3), (df, 4)))
    assert one == again != other and len(set(one)) == 20
    # a sample of more rows holds that of fewer
    assert set(one) <= {r.k for r in order.seeded_sample(df, "k", 90, 3).collect()}
    counts = [0] * 200
    for seed in range(40):
        for r in order.seeded_sample(df, "k", 50, seed).collect():
            counts[r.k] += 1
    assert min(counts) >= 1 and max(counts) <= 25  # ten are to be expected


def test_saturation_fit_against_a_grid(spark):
    rnd = random.Random(4)
    curves = {g: (a, b) for g, a, b in (("x", 40.0, 0.3), ("y", 7.0, 0.05), ("z", 900.0, 1.1))}
    rows = [(g, float(x), a * (1 - math.exp(-b * x)) * (1 + rnd.uniform(-0.03, 0.03))) for g, (a, b) in curves.items() for x in range(1, 12)]
    loss = lambda g, a, b: sum((y - a * (1 - math.exp(-b * x))) ** 2 for k, x, y in rows if k == g)
    for r in stats.saturation_fit(spark.createDataFrame(rows, "g string, x double, y double"), "g").collect():
        a0, b0 = curves[r.g]
        grid = min(loss(r.g, a0 * i / 100, b0 * j / 100) for i in range(70, 140, 2) for j in range(60, 150, 2))
        assert loss(r.g, r.a, r.b) <= grid * (1 + 1e-9) and abs(r.a / a0 - 1) < 0.3
