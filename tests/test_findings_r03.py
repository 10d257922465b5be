"""The third round's findings on work that grew faster than the input."""

import random

from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_distinct_names_near_places_equal_brute_force(spark):
    from junctura.operators import joins

    rnd = random.Random(8)
    # ids repeat, so that sets have up to six places; names lie at several spots, two rows have no name
    rows = [(rnd.randrange(25), 1 + rnd.randrange(2), f"c{rnd.randrange(2)}", rnd.randrange(0, 400, 3)) for _ in range(60)] + [(99, 1, "c0", 5000)]
    others = [(f"q{rnd.randrange(40)}", f"c{rnd.randrange(2)}", rnd.randrange(400)) for _ in range(120)] + [(None, "c0", 50), (None, "c0", 5001)]
    near = lambda k, sides: {q for i, s, c, p in rows if i == k and s in sides for q, d, a in others if c == d and abs(p - a) <= 20}
    size = lambda names: len(names - {None})
    want = sorted((k, size(near(k, {1})), size(near(k, {2})), size(near(k, {1, 2}))) for k in {r[0] for r in rows} if near(k, {1, 2}))
    got = joins.distinct_near(spark.createDataFrame(rows, "id long, side int, contig string, pos long"), spark.createDataFrame(others, "name string, contig string, at long"), "id", "name", 20)
    assert rows_of(got) == want and want[-1] == (99, 0, 0, 0)


def test_genomes_of_both_ends_are_compared_without_a_join(spark):
    from junctura.plans import catalog

    df = catalog.queries()["o01_union_intersection"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_chain_write_few_rows(spark, monkeypatch):
    from junctura.operators import graph

    tables = []
    kept = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(kept(df)) or tables[-1])
    monkeypatch.setattr(graph, "discard", lambda *_: None)
    n = 500
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 900), (1001, 1000), (1000, 1002)], "src long, dst long")
    got = rows_of(graph.connected_components(chain))
    assert got == [(i, 0) for i in range(n + 1)] + [(900, 900), (1000, 1000), (1001, 1000), (1002, 1000)]
    # every round leaves about half of the nodes
    assert sum(t.count() for t in tables) < 8 * n


def test_matched_truth_equals_brute_force_and_shuffles_no_distinct_calls(spark):
    from junctura.operators import joins

    rnd = random.Random(4)
    row = lambda i: (i, f"s{rnd.randrange(2)}", f"g{rnd.randrange(2)}", rnd.randrange(-30, 120), f"g{rnd.randrange(2)}", rnd.randrange(-30, 120))
    t, c = [row(i) for i in range(80)], [row(i) for i in range(60)]
    meets = lambda a, b, p, q: a[1] == b[1] and (a[2], a[4]) == (b[2], b[4]) and abs(a[3] - b[3]) < 10 and abs(a[5] - b[5]) < 10
    turned = [(i, s, r2, p2, r1, p1) for i, s, r1, p1, r2, p2 in c]
    want = [a[0] for a in t if any(meets(a, b, 0, 0) for b in c + turned)]
    truth = spark.createDataFrame(t, "i long, sample string, ref1 string, pos1 long, ref2 string, pos2 long")
    calls = spark.createDataFrame(c, "i long, sample string, cref1 string, cpos1 long, cref2 string, cpos2 long")
    found = joins.matched_truth(truth, calls, 10, ["sample"], width=3)
    assert sorted(r.i for r in found.collect()) == want and 0 < len(want) < 80
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_clear_pairs_equal_the_unambiguous_ones_of_all_pairs(spark):
    from junctura.operators import events

    rnd = random.Random(6)
    columns = "bkp_id long, sample string, from_ref string, from_pos long, from_side string, to_ref string, to_pos long, to_side string, if_reverse string, cross_split_reads long"
    side = lambda: rnd.choice(("tail", "head"))
    rows = [(rnd.randrange(280), f"S{rnd.randrange(2)}", *rnd.choice((("A", "B"), ("C", "D"), ("B", "C")))[::rnd.choice((1, -1))]) for _ in range(300)]
    rows = [(i, s, a, rnd.randrange(0, 1500, 7), side(), b, rnd.choice((0, 40, 700, 790, 1500)) + rnd.randrange(20), side(), rnd.choice(("True", "False")), 1 + rnd.randrange(5)) for i, s, a, b in rows]
    df = spark.createDataFrame(rows, columns)
    want = rows_of(events.unambiguous(events.event_pairs(df), df))
    got = events.clear_pairs(df, df)
    assert rows_of(got.select(*events.unambiguous(events.event_pairs(df), df).columns)) == want and 0 < len(want) < events.event_pairs(df).count()


def test_longest_shared_words_are_searched_for_by_halves(spark, tmp_path):
    from junctura.plans import catalog

    docs = [(0, "ACGTACGTACGTTTTTTTTT"), (1, "GGACGTACGTACGTAGGGGG"), (2, "ACG"), (3, "GAC"), (4, None)]
    spark.createDataFrame([(i, t and t.translate(str.maketrans("ACGT", "abcd"))) for i, t in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["x15_microhomology"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect() if r.contig == "c0"] == [("c0", 10)]
    assert {r.contig for r in df.collect()} == {"c0", "c1"}


def test_index_of_tracks_is_probed_as_the_table_is(spark, tmp_path):
    from junctura.operators import kmers
    from junctura.sources import index

    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    common = text(120)
    refs = spark.createDataFrame([("a", text(40) + common + "N" + common[20:]), ("b", common[5:]), ("short", "ACG"), ("none", None)], "contig string, seq string")
    reads = spark.createDataFrame([(f"r{i}", common) for i in range(3)], "contig string, seq string")
    masks = kmers.coder(12, 3)
    index.write_tracks(refs, str(tmp_path / "i"), 12, chunk=50)
    got = index.probed_tracks(spark, str(tmp_path / "i"), kmers.frequent_bits(reads, 12, masks), 12)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = kmers.hit_positions(kmers.sequence_hashes(refs, 12, masks, ["contig"]), kmers.hash_counts(reads, 12, masks, least=3), 3)
    assert rows_of(got) == rows_of(want) and got.count() > 200


def test_points_near_genes_are_dealt_by_bins(spark):
    from junctura.plans import catalog

    df = catalog.queries()["f20_near_genes"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "/ 500.0" in plan


def test_segments_over_half_of_an_interval_equal_brute_force(spark):
    from junctura.operators import joins

    rnd = random.Random(2)
    rows = lambda n, top: [(i, f"c{rnd.randrange(2)}", a := rnd.randrange(-50, 300), a + 1 + rnd.randrange(top)) for i in range(n)]
    segments, genes = rows(150, 60), rows(150, 90)
    shared = lambda s, g: min(s[3], g[3]) - max(s[2], g[2])
    want = sorted((s[0], g[0], shared(s, g)) for s in segments for g in genes if s[1] == g[1] and shared(s, g) >= 0.5 * (g[3] - g[2]))
    got = joins.mostly_covered(spark.createDataFrame(segments, "id long, contig string, a long, b long"), spark.createDataFrame(genes, "gene long, contig string, lo long, hi long"), ["contig"], ("a", "b"), ("lo", "hi"), 20)
    assert sorted((r.id, r.gene, r.overlap) for r in got.collect()) == want and len(want) > 300
    # a segment meets an interval in the one bin that holds the interval's middle
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_runs_of_alignments_need_no_aligned_strings():
    from junctura.operators import alignment

    rnd = random.Random(3)
    text = lambda top: "".join(rnd.choices("ACG", k=rnd.randrange(top)))
    pairs = [(text(34), text(34)) for _ in range(150)]
    for _ in range(150):
        x = text(34)
        k = rnd.randrange(len(x) + 1)
        pairs.append((x[:k] + text(8) + x[k:], x))
    a, b = map(list, zip(*pairs, strict=True))
    one = [alignment.global_alignment(x, y) for x, y in pairs]
    homology, inserted = alignment.runs_batch(a, b)
    assert homology.tolist() == [alignment.homology_run(x, y) for _, x, y in one]
    assert inserted.tolist() == [alignment.inserted_run(y) for _, _, y in one] and max(inserted) > 2
    assert alignment.global_batch(a, b) == one


def test_strings_of_many_lengths_are_aligned_together():
    from junctura.operators import alignment

    a, b = zip(*[("A" * i, "C" * j) for i in range(1, 17) for j in range(1, 17)], strict=True)
    assert len(list(alignment._by_shape(list(a), list(b)))) == 1


def test_runs_of_window_pairs_are_one_step(spark):
    from junctura.plans import catalog

    plan = catalog.queries()["u02_x13_junctions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "aligned_runs" in plan and "aligned_pair" not in plan


def test_mechanisms_make_the_sequences_once(spark):
    from junctura.plans import catalog

    plan = catalog.queries()["u05_mechanisms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "length(seq" not in plan
