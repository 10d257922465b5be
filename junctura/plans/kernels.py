"""k-mer, graph, cluster and alignment queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import alignment as A
from ..operators import graph as G
from ..operators import kmers as K
from ..operators.checkpoints import stored
from ..operators.joins import canonical_pair
from .binding import oracle
from .catalog import query
from .cohort import with_taxa

_K, _E = 28, 3
_MASKS = K.coder(_K, _E)


def _hash_sql() -> str:
    bits = lambda s, code: f"translate({s}, 'ACGT', '{code}')::BIT::bigint"
    value = lambda side, mask: " | ".join(f"({side}{c} & {m})" for c, m in enumerate(mask))
    coded = ", ".join(f"{bits(s, code)} AS {side}{c}" for side, s in (("f", "kmer"), ("r", "rc")) for c, code in enumerate(K.CODES))
    hashes = ", ".join(f"least({value('f', m)}, {value('r', m)})::bigint AS h{i}" for i, m in enumerate(_MASKS))
    return f"SELECT contig, n, pos, {hashes} FROM (SELECT contig, n, pos, {coded} FROM k1) c"


# k-mers are cut out of blocks of 200 positions, as a place in a long string is found by counting from its start
_KMERS = f"""kb AS (SELECT contig, n, 200 * b AS off, substring(seq, 200 * b + 1, {199 + _K}) AS blk FROM (SELECT contig, n, seq, unnest(range(0, (length(seq) - {_K}) // 200 + 1)) AS b FROM seqs WHERE length(seq) >= {_K}) x),
    k0 AS (SELECT contig, n, (off + i - 1)::bigint AS pos, substring(blk, i::int, {_K}) AS kmer FROM (SELECT *, unnest(range(1, length(blk) - {_K} + 2)) AS i FROM kb) y),
    k1 AS (SELECT *, translate(reverse(kmer), 'ACGT', 'TGCA') AS rc FROM k0), k2 AS ({_hash_sql()}),
    kh AS (SELECT contig, n, pos, 0 AS hash_no, h0 AS h FROM k2 WHERE h0 <> 0 UNION ALL SELECT contig, n, pos, 1, h1 FROM k2 WHERE h1 <> 0 UNION ALL SELECT contig, n, pos, 2, h2 FROM k2 WHERE h2 <> 0)"""


def _hashes(v, which: str = "true", keep: tuple[str, ...] = ("contig", "n")):
    return K.sequence_hashes(v.seqs.filter(which), _K, _MASKS, list(keep))


def _frequent(v):
    return K.hash_counts(v.seqs.filter(_READS), _K, _MASKS, least=3)


def _bits(v):
    return K.frequent_bits(v.seqs.filter(_READS), _K, _MASKS)


#: Of the sequences the even ones stand for reads, the odd ones for the reference.
_READS, _REFERENCE = "n % 2 = 0", "n % 2 = 1"


@query("k01_k03_hashes", oracle("seqs", "SELECT contig, hash_no, count(*)::bigint AS n, min(h)::bigint AS least, bit_xor(h * (pos + 1))::bigint AS digest FROM kh GROUP BY contig, hash_no", _KMERS))
def k03(v):
    """The hashes of every position, summed up for each sequence and hash function."""
    return _hashes(v).groupBy("contig", "hash_no").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.bit_xor(F.col("h") * (F.col("pos") + 1)).alias("digest"))


@query("k04_frequent_hashes", oracle("seqs", "SELECT h, count(*)::bigint AS n FROM kh WHERE n % 2 = 0 GROUP BY h HAVING count(*) >= 3", _KMERS))
def k04(v):
    """Of the even sequences, which stand for reads here; the odd ones stand for the reference."""
    return _frequent(v)


def _hits(v):
    return K.hit_tracks(v.seqs.filter(_REFERENCE), _K, _MASKS, _bits(v), K.track_positions(_E), "pos long, any_hit int, all_hit int")


def _runs(v, bits):
    return K.hit_tracks(v.seqs.filter(_REFERENCE), _K, _MASKS, bits, K.track_runs(_E, 50, 0.9, 0.2), "a long, b long", margin=50)


def _peaks(v, bits):
    return K.hit_tracks(v.seqs.filter(_REFERENCE), _K, _MASKS, bits, K.track_peaks(_K), "pos long", margin=2 * (_K + 5))


@query("k05_k06_hit_positions", oracle("seqs", f"SELECT contig, pos, 1 AS any_hit, (count(*) >= {_E})::int AS all_hit FROM kh WHERE n % 2 = 1 AND h IN (SELECT h FROM kh WHERE n % 2 = 0 GROUP BY h HAVING count(*) >= 3) GROUP BY contig, pos", _KMERS))
def k06(v):
    return _hits(v)


_WINDOWS = _KMERS + f""", hp AS (SELECT contig, pos, 1 AS a, (count(*) >= {_E})::int AS b FROM kh WHERE n % 2 = 1 AND h IN (SELECT h FROM kh WHERE n % 2 = 0 GROUP BY h HAVING count(*) >= 3) GROUP BY contig, pos),
    al AS (SELECT contig, unnest(range(0, length(seq)))::bigint AS pos FROM seqs WHERE n % 2 = 1),
    gw AS (SELECT contig, pos FROM (SELECT contig, pos, sum(coalesce(a, 0)) OVER t AS sa, sum(coalesce(b, 0)) OVER t AS sb FROM al LEFT JOIN hp USING (contig, pos) WINDOW t AS (PARTITION BY contig ORDER BY pos RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)) x WHERE sa >= 45 AND sb >= 10 AND pos >= 49)"""


def _lengths(v):
    return v.seqs.filter("n % 2 = 1 and length(seq) > 0").select("contig", F.length("seq").cast("long").alias("len"))


@query("k07_good_windows", oracle("seqs", "SELECT contig, pos FROM gw", _WINDOWS))
def k07(v):
    return _runs(v, _bits(v)).select("contig", F.explode(F.sequence("a", "b")).alias("pos"))


@query("k08_good_intervals", oracle("seqs", """
    SELECT contig, min(s)::bigint AS start, max(e)::bigint AS end FROM (SELECT *, sum(op) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 49 THEN 0 ELSE 1 END AS op FROM (
        SELECT r.contig, greatest(min(pos) - 100, 1) AS s, least(max(pos) + 100, length(min(seq))) AS e FROM (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS k FROM gw) r JOIN seqs ON seqs.contig = r.contig GROUP BY r.contig, k) a) b) c GROUP BY contig, g""", _WINDOWS))
def k08(v):
    return K.good_intervals(_runs(v, _bits(v)), _lengths(v), 50)


@query("k09_peaks", None)
def k09(v):
    """Edges of the hit signal on every contig."""
    return _peaks(v, _bits(v))


_BINNED, _MARGIN = K.track_binned_peaks(_E, _K, 50, 0.9, 0.2), K.binned_margin(_K, 50)


@query("k10_binned_peaks", None)
def k10(v):
    """Peaks within good intervals, with the first one of their bin."""
    return K.hit_tracks(v.seqs.filter(_REFERENCE), _K, _MASKS, _bits(v), _BINNED, "pos long, first long", margin=_MARGIN)


#: Votes that a contig needs of a read.
_LEAST_VOTES = 6


def _votes(v):
    claims = K.hit_tracks(v.seqs.filter(_REFERENCE), _K, _MASKS, _bits(v), K.track_claims(_BINNED), "peak long, first long, hash_no int, h long", _MARGIN, keep=("contig", "n"), hashed=True)
    table = K.claimed_hashes(claims)
    found = K.looked_up(K.unit_hashes(v.seqs.filter(_READS), _K, _MASKS, K.claimed_bits(table, _K)), table)
    return K.unit_votes(found, _E, _LEAST_VOTES).join(v.seqs.filter(_REFERENCE).select("n", "contig").distinct(), "n").select("contig", "pos", "support")


@query("k11_k12_read_votes", None)
def k11(v):
    """Peaks supported by sequences whose k-mers point to two contigs or more."""
    return _votes(v)


@query("k13_support_intervals", None)
def k13(v):
    """The stretches about supported peaks."""
    return K.support_intervals(_votes(v))


@query("k14_occupancy", oracle("seqs", f"SELECT hash_no, round(1 - count(*) / {float(1 << _K)}, 9) AS empty_rate, round(1 - count(*) FILTER (WHERE c >= 3) / {float(1 << _K)}, 9) AS below_rate FROM (SELECT hash_no, h, count(*) AS c FROM kh GROUP BY hash_no, h) x GROUP BY hash_no", _KMERS))
def k14(v):
    return K.table_occupancy(v.seqs, _K, _MASKS).select("hash_no", F.round("empty_rate", 9).alias("empty_rate"), F.round("below_rate", 9).alias("below_rate"))


def _graph(v):
    number = lambda c: F.substring(c, 2, 9).cast("long")
    return v.bkp.filter("cross_split_reads >= 5").select("sample", number("from_genome").alias("src"), number("to_genome").alias("dst"), F.col("cross_split_reads").cast("double").alias("weight"))


_EDGE = "ed AS (SELECT sample, substring(from_genome, 2)::bigint AS src, substring(to_genome, 2)::bigint AS dst, cross_split_reads::double AS weight FROM bkp WHERE cross_split_reads >= 5), "


@query("g01_components", oracle("ev", "SELECT event_id AS node, min(event_id) OVER (PARTITION BY sample, receptor) AS component FROM ev QUALIFY count(*) OVER (PARTITION BY sample, receptor) > 1"))
def g01(v):
    """Chains from each event to the next one of its sample and receptor."""
    w = Window.partitionBy("sample", "receptor").orderBy("event_id")
    e = v.ev.select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst")).filter("dst is not null")
    return G.connected_components(e)


@query("g03_graph_metrics", oracle("bkp", """
    SELECT dg.sample, nodes, n_edges, round(2 * n_edges / (nodes * (nodes - 1))::double, 6) AS density, round(CASE WHEN triples > 0 THEN 3 * coalesce(t, 0) / triples::double ELSE 0 END, 6) AS transitivity
    FROM (SELECT sample, count(*)::bigint AS nodes, sum(d * (d - 1) / 2)::double AS triples FROM (SELECT sample, v, count(*) AS d FROM (SELECT sample, a AS v FROM e UNION ALL SELECT sample, b FROM e) x GROUP BY ALL) y GROUP BY sample) dg
    JOIN (SELECT sample, count(*)::bigint AS n_edges FROM e GROUP BY sample) c USING (sample)
    LEFT JOIN (SELECT x.sample, count(*) AS t FROM e x JOIN e y ON x.sample = y.sample AND x.b = y.a JOIN e z ON z.sample = x.sample AND z.a = x.a AND z.b = y.b GROUP BY x.sample) tr USING (sample)""", _EDGE + "e AS (SELECT DISTINCT sample, least(src, dst) AS a, greatest(src, dst) AS b FROM ed WHERE src <> dst)"))
def g03(v):
    out = G.graph_metrics(_graph(v), ["sample"])
    return out.select("sample", "nodes", "n_edges", F.round("density", 6).alias("density"), F.round("transitivity", 6).alias("transitivity"))


@query("g03_connectivity", None)
def g03b(v):
    """Assortativity and algebraic connectivity of every sample's graph."""
    e = _graph(v)
    return G.graph_metrics(e, ["sample"]).select("sample", F.round("assortativity", 3).alias("assortativity")).join(G.algebraic_connectivity(e, "sample"), "sample")


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::double / (SELECT count(*) FROM nd) AS rank FROM nd)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT nd.node, 0.15::double / (SELECT count(*) FROM nd) + 0.85::double * coalesce(s, 0) AS rank FROM nd LEFT JOIN (SELECT dst, sum(rank * share) AS s FROM lk JOIN r{i} ON src = node GROUP BY dst) q ON dst = node)")
    return ", ".join(steps)


@query("g05_pagerank", oracle("bkp", "SELECT node, round(rank, 8) AS rank FROM r10", _EDGE + "sy AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed) x GROUP BY ALL), tt AS (SELECT src, sum(w) AS t FROM sy GROUP BY src), nd AS (SELECT src AS node FROM tt), lk AS (SELECT src, dst, w / t AS share FROM sy JOIN tt USING (src)), " + _rank_sql(10)))
def g05(v):
    return G.pagerank(_graph(v), rounds=10).select("node", F.round("rank", 8).alias("rank"))


@query("g06_smoothed_markers", oracle("abund bkp tax", """
    SELECT sample, species AS marker, round(0.5 * abundance + 0.5 * coalesce(near, 0), 6) AS value FROM abund LEFT JOIN (
      SELECT x.sample, m.a AS species, sum(m.w * x.abundance) AS near FROM (SELECT a, b, n / (sum(n) OVER (PARTITION BY a))::double AS w FROM sy) m JOIN abund x ON x.species = m.b GROUP BY ALL) y USING (sample, species)""",
    "sp AS (SELECT a.species AS s1, b.species AS s2, count(*)::double AS n FROM bkp JOIN tax a ON a.genome = from_genome JOIN tax b ON b.genome = to_genome WHERE a.species < b.species GROUP BY ALL HAVING count(*) >= 20), sy AS (SELECT s1 AS a, s2 AS b, n FROM sp UNION ALL SELECT s2, s1, n FROM sp)"))
def g06(v):
    pairs = with_taxa(v).filter("s1 < s2").groupBy(F.col("s1").alias("src"), F.col("s2").alias("dst")).agg(F.count("*").cast("double").alias("weight")).filter("weight >= 20")
    values = v.abund.select("sample", F.col("species").alias("marker"), F.col("abundance").alias("value"))
    return G.smoothed(values, pairs).select("sample", "marker", F.round("value", 6).alias("value"))


@query("w02_a02_raw_clusters", None)
def w02(v):
    """Discordant pairs clustered on both positions, and the clusters' summaries."""
    rows = canonical_pair(v.bkp.select("bkp_id", "from_ref", "from_pos", "to_ref", "to_pos", "if_reverse"), fields=("ref", "pos"))
    points = rows.select(F.col("bkp_id").alias("point"), "a_ref", "b_ref", F.col("a_pos").alias("pos"), F.col("b_pos").alias("mate_pos"), (F.col("if_reverse") == "True").alias("is_reverse"), F.lit(True).alias("mate_is_reverse"))
    by = ["a_ref", "b_ref", "is_reverse", "mate_is_reverse"]
    return A.raw_clusters(A.cluster_pairs(points, by, 300), by)


def window_pairs(v, size: int):
    """contig, at (from 0), x and y: the windows of size letters of each sequence, one after another to its end, beside those of
    the sequence that follows it."""
    # both sides of the join read the windows, which are made once
    windows = stored(v.seqs.select("contig", "n", F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("x")))
    following = windows.select((F.col("n") - 1).alias("n"), F.col("x").alias("y"))
    both = windows.join(following, "n").select("contig", F.posexplode(F.arrays_zip("x", "y")).alias("at", "w"))
    return both.select("contig", "at", "w.x", "w.y").filter("x is not null and y is not null")


@query("u01_local_similarity", None)
def u01(v):
    """Local similarity of neighbouring sequences, window by window."""
    return window_pairs(v, 50).select("contig", "at", F.round(A.local_similarity("x", "y"), 6).alias("similarity"))


@query("u03_precise_breakpoints", None)
def u03(v):
    """A clip of each stretch of the sequences is placed on the stretch again."""
    stretches = v.seqs.select("n", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,430}"), F.lit(0))).alias("at", "ref")).filter("length(ref) >= 120")
    some = stretches.withColumn("cluster", F.col("n") * 1_000_000 + F.col("at")).withColumn("lo", F.col("at").cast("long") * 430)
    clusters = some.select("cluster", "lo", (F.col("lo") + F.length("ref")).cast("long").alias("hi"), "ref")
    place = F.pmod(F.xxhash64("cluster"), F.length("ref") - 30).cast("int")
    reads = some.select("cluster", F.col("cluster").alias("row_id"), F.substring("ref", place + 1, F.lit(30)).alias("clip"), F.lit(True).alias("right"))
    return A.precise_breakpoints(clusters, reads)


@query("u02_x13_junctions", None)
def u02(v):
    """Homology and inserted bases in global alignments of the windows of neighbouring sequences."""
    return window_pairs(v, 30).select("contig", "at", A.aligned_runs("x", "y").alias("r")).select("contig", "at", "r.homology", "r.inserted")


def _labelled(v):
    """(tags of samples, labels of samples: sample, cohort, label), written once, as each fold reads them."""
    from ..operators.checkpoints import stored

    labels = v.phe.filter("full_disease IN ('CRC', 'healthy')").select("sample", "cohort", (F.col("full_disease") == "CRC").cast("double").alias("label"))
    return stored(v.bkp.select("sample", X.pair_tag(F.col("from_genome"), F.col("to_genome")).alias("tag")).distinct()), stored(labels)


@query("m01_cross_validation", None)
def m01(v):
    """AUC of a random forest over 25 markers in each of five stratified folds."""
    from ..operators import learning

    tags, labels = _labelled(v)
    scores = learning.cross_validated(learning.feature_table(tags, labels, learning.markers(tags, labels, 25)))
    return v.spark.createDataFrame(list(enumerate(scores)), "fold int, auc double")


@query("m02_cohort_auc", None)
def m02(v):
    """AUC of a random forest over 25 markers: each cohort left out, and the size-weighted mean."""
    from ..operators import learning

    scores, mean = learning.leave_one_out(*_labelled(v))
    return v.spark.createDataFrame([*sorted(scores.items()), ("all", mean)], "cohort string, auc double")


@query("m03_external_validation", None)
def m03(v):
    """AUC, accuracy and false positives on one cohort of a forest trained on the others."""
    from ..operators import learning

    tags, labels = _labelled(v)
    return learning.validated(tags, labels.filter("cohort <> 'C3'"), tags, labels.filter("cohort = 'C3'"))


@query("z01_simulated_events", None)
def z01(v):
    """Simulated transfers between the sequences: the recipients' new sequences and the truth."""
    from ..operators.simulation import simulate_transfers

    return simulate_transfers(v.seqs.select("contig", "seq"), seed=1)


@query("z02_scenarios", None)
def z02(v):
    """The parameters of simulated scenarios with their seeds."""
    from ..operators.simulation import scenarios

    return scenarios(v.spark)


def _with_length(v):
    return v.seqs.withColumn("len", F.length("seq"))


def _sequence_events(lengths):
    """Events between neighbouring sequences (contig, n, len), with places all over them."""
    two = lengths.select((F.col("n") - 1).alias("n"), F.col("contig").alias("donor"), F.col("len").alias("l2"))
    met = lengths.select("contig", "n", "len").join(two, "n").filter("len >= 300 and l2 >= 500")
    place = lambda seed, top: F.pmod(F.xxhash64("n", F.lit(seed)), top).cast("long")
    start = (F.lit(120) + place(2, F.col("l2") - 420)).alias("delete_start")
    return met.select(F.col("n").alias("event_id"), F.col("contig").alias("receptor"), (F.lit(100) + place(1, F.col("len") - 200)).alias("insert_locus"), "donor", start, (start + F.lit(200)).alias("delete_end"), F.when(F.col("n") % 2 == 0, "True").otherwise("False").alias("reverse_flag"))


@query("u04_verified_events", None)
def u04(v):
    """Recipients rebuilt from events, and which of them long alignments bear out."""
    from ..operators.simulation import rebuilt_recipients, verified_junctions

    built = rebuilt_recipients(_sequence_events(_with_length(v)), v.seqs.select("contig", "seq"), window=80).filter("complete").withColumn("length", F.length("seq").cast("long"))
    place = lambda seed, n: F.pmod(F.xxhash64("event_id", "k", F.lit(seed)), F.lit(n)).cast("long")
    aligned = built.select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("event_id", place(1, 200).alias("t_start"), (F.lit(100) + place(2, 260)).alias("t_end")).filter("t_end > t_start")
    return verified_junctions(built, aligned, long=300)


@query("u05_mechanisms", None)
def u05(v):
    """Mechanisms of events from repeats, mobile elements, inserted bases and homology at their junctions."""
    from ..operators.mechanisms import mechanism_evidence

    # written once with their lengths, as most steps need no letter
    seqs = stored(_with_length(v))
    events = _sequence_events(seqs)
    region = lambda seed, size: seqs.filter("len > 300").select("contig", F.pmod(F.xxhash64("contig", F.lit(seed)), F.col("len") - 200).cast("long").alias("start")).withColumn("end", F.col("start") + size)
    # reads that end at the segment's start, with bases of another sequence for some
    donors = seqs.select(F.col("contig").alias("donor"), "seq")
    at = F.col("delete_start")
    cut = lambda a, n: F.substring("seq", (a + 1).cast("int"), F.lit(n))
    extra = F.when(F.col("event_id") % 3 == 0, F.lit("ACGTTGCATGCA")).when(F.col("event_id") % 3 == 1, F.lit("TTGCA")).otherwise(F.lit(""))
    reads = events.join(donors, "donor").select("event_id", F.lit("start").alias("side"), F.col("event_id").alias("row_id"), F.concat(cut(at - 80, 40), extra, cut(at - 40, 40)).alias("seq"), F.lit("+").alias("strand"))
    return mechanism_evidence(events, region(3, 90), region(4, 60), seqs.select("contig", "seq"), reads)


@query("x15_microhomology", oracle("seqs", """
    SELECT contig, max(k)::bigint AS longest FROM (SELECT contig, x, y, k FROM pr, (SELECT unnest(range(3, 11)) AS k) ks
      WHERE len(list_intersect(list_transform(range(1, length(x) - k + 2), lambda i: substring(x, i::int, k::int)), list_transform(range(1, length(y) - k + 2), lambda i: substring(y, i::int, k::int)))) > 0) z GROUP BY contig""",
    """wd AS (SELECT contig, n, regexp_extract_all(seq, '.{1,30}') AS w FROM seqs),
    pr AS (SELECT contig, unnest(wa) AS x, unnest(wb) AS y FROM (SELECT a.contig, a.w[1:least(len(a.w), len(b.w))] AS wa, b.w[1:least(len(a.w), len(b.w))] AS wb FROM wd a JOIN wd b ON a.n = b.n - 1) p)"""))
def x15(v):
    """The longest k (3 to 10) of which two windows at one place of neighbouring sequences share a k-mer."""
    cut = lambda c, k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substr(F.col(c), i, F.lit(k))))
    shares = lambda k: F.arrays_overlap(cut("x", k), cut("y", k))

    def search(lo: int, hi: int):
        """The longest shared of lo to hi, where lo is shared (2: none): a shared k-mer holds shared ones of all lesser lengths."""
        if lo == hi:
            return F.lit(lo) if lo > 2 else F.lit(None).cast("int")
        mid = (lo + hi + 1) // 2
        return F.when(shares(mid), search(mid, hi)).otherwise(search(lo, mid - 1))

    longest = window_pairs(v, 30).select("contig", search(2, 10).cast("long").alias("longest"))
    return longest.groupBy("contig").agg(F.max("longest").alias("longest")).filter("longest is not null")


@query("t09_saturation_fit", None)
def t09(v):
    """a and b of a * (1 - exp(-b * x)) over each individual's cumulated tags."""
    from ..operators.stats import saturation_fit

    first = v.ts.groupBy("individual", "tag").agg(F.min("time_point").alias("t"))
    points = v.ts.select("individual", F.col("time_point").alias("x")).distinct().join(first, "individual").filter("t <= x").groupBy("individual", "x").agg(F.count("*").cast("double").alias("y"))
    return saturation_fit(points.withColumn("x", F.col("x").cast("double") + 1), "individual")


@query("s20_phenotype_union", oracle("phe reads_num", """
    SELECT sample, src, coalesce(o.bases, p.bases)::bigint AS bases, CASE WHEN disease = 'control' THEN 'healthy' ELSE disease END AS grp
    FROM (SELECT *, 'one' AS src FROM phe WHERE cohort IN ('C0', 'C1') UNION ALL SELECT *, 'two' FROM phe WHERE cohort IN ('C2', 'C3')) p LEFT JOIN (SELECT sample, reads_num * 100 AS bases FROM reads_num WHERE reads_num > 2000000) o USING (sample)"""))
def s20(v):
    """Phenotypes of two table groups in one, with another table's base counts where it has them."""
    part = lambda cohorts, name: v.phe.filter(F.col("cohort").isin(*cohorts)).withColumn("src", F.lit(name))
    both = part(("C0", "C1"), "one").unionByName(part(("C2", "C3"), "two"))
    other = v.reads_num.filter("reads_num > 2000000").select("sample", (F.col("reads_num") * 100).alias("other"))
    group = F.when(F.col("disease") == "control", "healthy").otherwise(F.col("disease"))
    return both.join(other, "sample", "left").select("sample", "src", F.coalesce("other", "bases").alias("bases"), group.alias("grp"))
