"""The fourth round's findings on work, disk and memory that grew faster than the input."""

import random

import numpy as np
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def _sequences(rnd, k):
    text = lambda n: "".join(rnd.choices("ACGT", k=n))
    shared = [text(90) for _ in range(6)]
    refs = [(i, f"c{i}", text(rnd.randrange(60)) + "".join(rnd.sample(shared, 3)) + "N" + text(40) + rnd.choice(shared)) for i in range(12)]
    reads = [(100 + i, f"r{i}", "".join(r[2][(p := rnd.randrange(200)) : p + 60] for r in rnd.sample(refs, 2))) for i in range(40)]
    reads += [(300, "long", "".join(r[2] for r in refs)), (301, "short", "ACG"), (302, "none", None), (303, "last", refs[0][2] + refs[5][2])]
    return refs, reads


def test_binned_peaks_of_tracks_equal_the_tables(spark):
    from junctura.operators import kmers

    rnd, k, size = random.Random(3), 14, 40
    text = lambda n: "".join(rnd.choices("ACGT", k=n))
    shared = [text(n) for n in (30, 35, 60, 70, 80)]
    refs = [(i, f"c{i}", text(rnd.randrange(90)) + "".join(rnd.choice(shared) + text(rnd.choice((20, 160, 195, 260))) for _ in range(3))) for i in range(12)]
    table = lambda rows: spark.createDataFrame(rows, "n long, contig string, seq string")
    masks = kmers.coder(k, 3)
    bits = kmers.frequent_bits(table([(i, "r", s) for i, s in enumerate(shared)]), k, masks, 1)
    hits = kmers.hit_tracks(table(refs), k, masks, bits, kmers.track_positions(3), "pos long, any_hit int, all_hit int")
    contigs = table(refs).select("contig", F.length("seq").cast("long").alias("len"))
    good = kmers.good_intervals(kmers.good_runs(hits, contigs, size, 0.8, 0.3), contigs, size)
    want = rows_of(kmers.binned_peaks(kmers.peaks(hits, contigs, k), good))
    for chunk in (70, 1000):
        track = kmers.track_binned_peaks(3, k, size, 0.8, 0.3)
        assert rows_of(kmers.hit_tracks(table(refs), k, masks, bits, track, "pos long, first long", kmers.binned_margin(k, size), chunk)) == want
    assert 30 < len(want) < kmers.peaks(hits, contigs, k).count() and any(p != first for _, p, first in want)


def test_votes_of_units_equal_those_of_rows(spark):
    from junctura.operators import kmers

    rnd, k = random.Random(7), 8
    refs, reads = _sequences(rnd, k)
    table = lambda rows: spark.createDataFrame(rows, "n long, contig string, seq string")
    masks = kmers.coder(k, 3)
    index = {c: dict(zip(pos.tolist(), zip(*(h.tolist() for h in found), strict=True), strict=True)) for _, c, s in refs for pos, found in [kmers.canonical_hashes(s, k, masks)]}
    claims = [(c, n, p, p // 50 * 50, e, h) for n, c, s in refs for p in sorted(rnd.sample([*index[c]], 90)) for e, h in enumerate(index[c][p]) if h]
    own = spark.createDataFrame(claims, "contig string, n long, peak long, first long, hash_no int, h long")
    binned = own.select("contig", F.col("peak").alias("pos"), "first").distinct()
    at_peaks = own.select("contig", F.col("peak").alias("pos"), "hash_no", "h")
    stand = kmers.peak_hashes(at_peaks, binned)
    asked = kmers.sequence_hashes(table(reads), k, masks, ["contig"]).withColumnsRenamed({"contig": "read_name", "pos": "pos_in_read"})
    claimed = kmers.claimed_hashes(own)
    told = [(r.bucket << kmers.BUCKET, *(kmers._numbers(c).astype(int).tolist() for c in (r.low, r.n, r.pos))) for r in claimed.collect()]
    assert sorted((b + h, f"c{n}", p) for b, low, whose, where in told for h, n, p in zip(np.cumsum(low).tolist(), whose, where, strict=True)) == rows_of(stand)
    assert claimed.count() < stand.count()
    for least in (3, 6):
        want = rows_of(kmers.read_votes(asked, stand, least))
        for chunk in (40, 150, 100_000):
            units = kmers.unit_hashes(table(reads).coalesce(2), k, masks, kmers.claimed_bits(claimed, k), chunk=chunk)
            got = kmers.unit_votes(kmers.looked_up(units, claimed), 3, least).select(F.concat(F.lit("c"), "n"), "pos", "support")
            assert rows_of(got) == want and len(want) > 3
    # no row for each hash: a unit and bucket has one
    assert units.count() < asked.count() / 20


def test_tables_of_bits_are_not_made_a_partition_at_a_time(spark, monkeypatch):
    from junctura.operators import kmers

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *_, **__: 1 / 0)
    bits = kmers.hash_bits(spark.createDataFrame([(5,), (300_000,), (5,)], "h long"), 20)
    assert np.flatnonzero(np.unpackbits(bits.value)).tolist() == [5, 300_000]


def _places(rnd, n, top, size):
    return [(rnd.choice((i, None)), f"c{rnd.randrange(2)}", a := rnd.randrange(-50, top, 10), a + rnd.randrange(size)) for i in range(n)]


def test_points_of_a_place_meet_intervals_once(spark):
    from junctura.operators import joins

    rnd = random.Random(5)
    points = [(i, c, p) for i, c, p, _ in _places(rnd, 300, 90, 2)] + [(7, None, 3), (8, "c0", None)]
    genes = _places(rnd, 80, 90, 60) + [(9, "c0", 40, 10)]
    left = spark.createDataFrame(points, "id long, contig string, pos long")
    right = spark.createDataFrame(genes, "gene long, contig string, lo long, hi long")
    for open_ in (True, False):
        inside = (lambda p, lo, hi: lo - 5 < p < hi + 5) if open_ else (lambda p, lo, hi: lo - 5 <= p <= hi + 5)
        want = sorted(((i, g) for i, c, p in points for g, d, lo, hi in genes if c == d and p is not None and inside(p, lo, hi)), key=str)
        got = joins.interval_pairs(left, right, ["contig"], "pos", "lo", "hi", pad=5, bin_size=20, open_=open_)
        assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 2000
    # rows are made of lists, not by the join
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(__l") < plan.index("SortMergeJoin")


def test_segments_between_the_same_ends_meet_genes_once(spark):
    from junctura.operators import joins

    rnd = random.Random(6)
    segments, genes = _places(rnd, 300, 200, 40) + [(9, "c0", 40, 10), (8, "c0", None, 10)], [g for g in _places(rnd, 120, 200, 90) if g[2] < g[3]]
    left = spark.createDataFrame(segments, "id long, contig string, a long, b long")
    right = spark.createDataFrame(genes, "gene long, contig string, lo long, hi long")
    want = joins.mostly_covered(left, right, ["contig"], ("a", "b"), ("lo", "hi"), 20).select("id", "gene", "overlap")
    got = joins.covered_pairs(left, right, ["contig"], ("a", "b"), ("lo", "hi"), 20)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == (rows := sorted(map(tuple, want.collect()), key=str)) and len(rows) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(__l") < plan.index("SortMergeJoin")


def test_reads_meet_clusters_by_their_cells(spark):
    from junctura.operators import joins

    rnd = random.Random(4)
    # keys repeat, positions are below 0 too, clusters reach over several bins on both sides
    reads = [(rnd.randrange(60), "a", rnd.randrange(-60, 160), rnd.choice("bc"), rnd.randrange(-60, 160)) for _ in range(70)] + [(61, "a", None, "b", 5), (62, None, 4, "b", 5)]
    ends = [(f"k{rnd.randrange(9)}{c}", "a", c, rnd.choice("ab"), rnd.randrange(-60, 160)) for c in "bc" * 30] + [("k0b", "a", "b", "a", None)]
    one = lambda s, i: {(r[0], k) for r in reads for k, x, y, side, p in ends if side == s and (r[1], r[3]) == (x, y) and None not in (r[i], p) and abs(r[i] - p) < 25}
    want = sorted(one("a", 2) & one("b", 4))
    e = spark.createDataFrame(ends, "cl string, a_ref string, b_ref string, side string, pos long")
    columns = "id long, a_ref string, a_pos long, b_ref string, b_pos long"
    got = joins.split_reads_to_clusters(spark.createDataFrame(reads, columns), e, "id", "cl", 25)
    assert rows_of(got) == want and len(want) > 50
    single = [(i, *r[1:]) for i, r in enumerate(reads)]
    reads = single
    got = joins.split_reads_to_clusters(spark.createDataFrame(single, columns), e, "id", "cl", 25)
    assert rows_of(got) == sorted(one("a", 2) & one("b", 4))
    # a row for a read and cluster near on both sides, not for all that are near on one
    assert "HashAggregate(keys=[id" not in got._jdf.queryExecution().executedPlan().toString()


def test_truth_is_read_once_and_put_in_the_order_of_numbers(spark, monkeypatch):
    from junctura.plans import catalog, joining

    tables = []
    kept = joining.stored
    monkeypatch.setattr(joining, "stored", lambda df: tables.append(kept(df)) or tables[-1])
    df = catalog.queries()["a27_recall_fdr_f1"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(tables) == 1 and "lineitem" not in plan
    assert plan.count("SortMergeJoin [xxhash64(") == 2 and "Exchange hashpartitioning(xxhash64(" in plan


def test_numbers_are_kept_in_the_bytes_they_need():
    from junctura.operators import kmers

    for numbers in ([0], [0, 3, 255], [1, 256], [70_000, 2], [1 << 30, 5], [1 << 40], [-1, 7]):
        planes = kmers._planes(np.array(numbers))
        assert kmers._numbers(planes).tolist() == numbers
        assert len(planes) == 1 + len(numbers) * (8 if min(numbers) < 0 else max(1, -(-max(numbers).bit_length() // 8)))


def test_hits_are_handed_on_in_bounded_batches(spark):
    import pyarrow as pa

    from junctura.operators import kmers

    class Table:
        schema = spark.createDataFrame([], "contig string, seq string").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ACGT", k=100)) for _ in range(50)]
    bits = type("Bits", (), {"value": np.full(1 << 15, 255, np.uint8)})
    run = kmers.hit_tracks(Table(), 12, kmers.coder(12, 3), bits, kmers.track_positions(3), "pos long, any_hit int, all_hit int", full=300)
    sizes = [b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(50)).cast(pa.string()), pa.array(texts)], ["contig", "seq"])]))]
    assert sum(sizes) == 50 * 89 and max(sizes) < 300 + 89
    # the words of hashes are no wider than their bits need
    assert all(h.dtype == np.uint32 for h in kmers.canonical_hashes(texts[0], 28, kmers.coder(28, 3))[1])
