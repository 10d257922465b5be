"""Join-shaped queries: band, interval, as-of, theta, semi and anti joins, and event matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import events, joins
from ..operators.checkpoints import stored
from .binding import oracle
from .catalog import query

_PAIRS = """
    c AS (SELECT bkp_id, sample, if_reverse, cross_split_reads AS n, least(from_ref, to_ref) AS ar, greatest(from_ref, to_ref) AS br,
      CASE WHEN from_ref > to_ref THEN to_pos ELSE from_pos END AS ap, CASE WHEN from_ref > to_ref THEN from_pos ELSE to_pos END AS bp,
      CASE WHEN from_ref > to_ref THEN to_side ELSE from_side END AS asd, CASE WHEN from_ref > to_ref THEN from_side ELSE to_side END AS bsd FROM bkp),
    m AS (SELECT x.sample, x.bkp_id AS i, y.bkp_id AS j, x.ar, x.br, x.ap AS ap1, y.ap AS ap2, x.bp AS bp1, y.bp AS bp2, x.asd AS as1, y.asd AS as2, x.bsd AS bs1, y.bsd AS bs2, x.if_reverse AS rf, (x.n + y.n) / 2.0::double AS w
      FROM c x JOIN c y ON x.sample = y.sample AND x.ar = y.ar AND x.br = y.br AND x.if_reverse = y.if_reverse AND x.bkp_id < y.bkp_id),
    p AS (
      SELECT sample, i, j, ar AS receptor, ap1 AS insert_locus, br AS donor, least(bp1, bp2) AS delete_start, greatest(bp1, bp2) AS delete_end, rf AS reverse_flag, w AS weight,
        CASE WHEN bp1 > bp2 THEN bs2 = 'tail' AND bs1 = 'head' ELSE bs1 = 'tail' AND bs2 = 'head' END AS ok FROM m WHERE abs(ap1 - ap2) < 20 AND abs(bp1 - bp2) > 20
      UNION ALL
      SELECT sample, i, j, br, bp1, ar, least(ap1, ap2), greatest(ap1, ap2), rf, w,
        CASE WHEN ap1 > ap2 THEN as2 = 'tail' AND as1 = 'head' ELSE as1 = 'tail' AND as2 = 'head' END FROM m WHERE abs(bp1 - bp2) < 20 AND abs(ap1 - ap2) > 20),
    e AS (SELECT sample, i, j, receptor, insert_locus, donor, delete_start, delete_end, reverse_flag, weight FROM p WHERE ok AND delete_end - delete_start >= 500)"""


@query("j06_event_pairs", oracle("bkp", "SELECT * FROM e", _PAIRS))
def j06(v):
    return events.event_pairs(v.bkp)


@query("w01_unambiguous_pairs", oracle("bkp", "SELECT e.* FROM e JOIN k USING (receptor, donor, insert_locus)", _PAIRS + """,
    q AS (SELECT DISTINCT * FROM (SELECT from_ref AS receptor, from_pos AS r_pos, to_ref AS donor, to_pos AS d_pos FROM bkp UNION ALL SELECT to_ref, to_pos, from_ref, from_pos FROM bkp) x),
    s AS (SELECT DISTINCT e.receptor, e.donor, e.insert_locus, q.d_pos FROM e JOIN q ON e.receptor = q.receptor AND e.donor = q.donor AND abs(q.r_pos - e.insert_locus) < 20),
    o AS (SELECT *, CASE WHEN d_pos - lag(d_pos) OVER (PARTITION BY receptor, donor, insert_locus ORDER BY d_pos) <= 100 THEN 0 ELSE 1 END AS op FROM s),
    k AS (SELECT receptor, donor, insert_locus FROM o GROUP BY ALL HAVING sum(op) <= 2)"""))
def w01(v):
    return events.clear_pairs(v.bkp, v.bkp)


@query("g02_matched_events", None)
def g02(v):
    """Whole event inference: contig ends, ambiguity and maximum-weight matching."""
    return events.events(v.bkp_all, v.contigs)


@query("j01_mates", oracle("aln", """
    SELECT qname, i, j, r1, r2, p1, p2 FROM (SELECT qname, min(aln_id) AS i, max(aln_id) AS j, count(*) AS n, arg_min(ref, aln_id) AS r1, arg_max(ref, aln_id) AS r2, arg_min(pos, aln_id) AS p1, arg_max(pos, aln_id) AS p2 FROM aln GROUP BY qname) x
    WHERE n = 2 AND split_part(r1, ':', 1) <> split_part(r2, ':', 1)"""))
def j01(v):
    both = v.aln.groupBy("qname").agg(F.min("aln_id").alias("i"), F.max("aln_id").alias("j"), F.count("*").alias("n"), F.min_by("ref", "aln_id").alias("r1"), F.max_by("ref", "aln_id").alias("r2"), F.min_by("pos", "aln_id").alias("p1"), F.max_by("pos", "aln_id").alias("p2"))
    return both.filter((F.col("n") == 2) & (X.segment_contig(F.col("r1")) != X.segment_contig(F.col("r2")))).drop("n")


@query("j02_dimension_lookup", oracle("bkp tax phe", "SELECT bkp_id, phylum, full_disease FROM bkp JOIN tax ON genome = from_genome JOIN phe USING (sample)"))
def j02(v):
    return v.bkp.join(v.tax, F.col("genome") == F.col("from_genome")).join(v.phe, "sample").select("bkp_id", "phylum", "full_disease")


@query("j03_reads_to_clusters", oracle("bkp", """
    SELECT bkp_id, cid FROM (SELECT DISTINCT r.bkp_id, k.cid FROM r JOIN (SELECT DISTINCT ar, br, cid, ap FROM c) k ON r.ar = k.ar AND r.br = k.br AND abs(k.ap - r.ap) < 300) x
    JOIN (SELECT DISTINCT r.bkp_id, k.cid FROM r JOIN (SELECT DISTINCT ar, br, cid, bp FROM c) k ON r.ar = k.ar AND r.br = k.br AND abs(k.bp - r.bp) < 300) y USING (bkp_id, cid)""", """
    r AS (SELECT bkp_id, least(from_ref, to_ref) AS ar, greatest(from_ref, to_ref) AS br, CASE WHEN from_ref > to_ref THEN to_pos ELSE from_pos END AS ap, CASE WHEN from_ref > to_ref THEN from_pos ELSE to_pos END AS bp FROM bkp),
    c AS (SELECT *, concat_ws('|', ar, br, (ap // 900)::varchar, (bp // 900)::varchar) AS cid FROM r)"""))
def j03(v):
    """Breakpoints as reads, attached to the clusters of breakpoints of one square of 900 bases a side."""
    # written, as ends, cells and reads each read it, and the view's names cost more than the rest
    reads = stored(joins.canonical_pair(v.bkp.select("bkp_id", "from_ref", "from_pos", "to_ref", "to_pos"), fields=("ref", "pos")))
    square = F.concat_ws("|", "a_ref", "b_ref", F.expr("cast(a_pos div 900 AS string)"), F.expr("cast(b_pos div 900 AS string)"))
    ends = reads.select("a_ref", "b_ref", square.alias("cid"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_pos").alias("pos")), F.struct(F.lit("b").alias("side"), F.col("b_pos").alias("pos")))).alias("e")).select("a_ref", "b_ref", "cid", "e.*")
    return joins.split_reads_to_clusters(reads, ends, "bkp_id", "cid", 300)


@query("j04_alignments_near_breakpoints", oracle("bkp aln", """
    SELECT bkp_id, count(*)::bigint AS n FROM bkp JOIN (SELECT *, split_part(ref, ':', 1) AS contig, regexp_extract(ref, ':([0-9]+)-', 1)::bigint + pos AS gp FROM aln) a
    ON contig = from_ref AND gp >= from_pos - 20 AND gp <= from_pos + 20 GROUP BY bkp_id"""))
def j04(v):
    a = v.aln.select("aln_id", X.segment_contig(F.col("ref")).alias("contig"), X.segment_to_global(F.col("ref"), F.col("pos")).alias("gp"))
    b = v.bkp.select("bkp_id", F.col("from_ref").alias("contig"), "from_pos")
    return joins.near_counts(b, a, ["contig"], "from_pos", "gp", 20).groupBy("bkp_id").agg(F.sum("near").alias("n"))


@query("j05_asof_segments", oracle("bkp genes", """
    SELECT bkp_id, seg_start, greatest(from_pos - seg_start, 1)::bigint AS new_pos FROM (
      SELECT bkp_id, from_pos, (SELECT max(g_start) FROM genes WHERE contig = from_ref AND g_start - 150 <= from_pos) AS seg_start FROM bkp) x"""))
def j05(v):
    points = v.bkp.select("bkp_id", F.col("from_ref").alias("contig"), "from_pos")
    segments = v.genes.select("contig", F.col("g_start").alias("seg_start")).distinct()
    out = joins.asof_join(points, segments, ["contig"], "from_pos", "seg_start", slack=150)
    # greatest() skips nulls: a point before every segment has no position on one
    new = F.when(F.col("seg_start").isNotNull(), F.greatest(F.col("from_pos") - F.col("seg_start"), F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long"))
    return out.select("bkp_id", "seg_start", new.alias("new_pos"))


@query("j07_drop_near_repeats", None)
def j07(v):
    """Breakpoints of the cohort without near repeats, in the order of their ids."""
    from ..operators.greedy import drop_near_repeats

    return drop_near_repeats(v.bkp.withColumn("row_id", F.col("bkp_id")))


@query("j08_points_in_genes", oracle("ev genes", "SELECT event_id, count(*)::bigint AS n FROM ev JOIN genes ON contig = receptor AND insert_locus BETWEEN g_start - 100 AND g_end + 100 GROUP BY event_id"))
def j08(v):
    points = v.ev.select("event_id", F.col("receptor").alias("contig"), "insert_locus")
    return joins.covering_counts(points, v.genes.drop("attrs"), ["contig"], "insert_locus", "g_start", "g_end", pad=100).groupBy("event_id").agg(F.sum("covering").alias("n"))


@query("j08_segments_over_half_genes", oracle("ev genes", """
    SELECT event_id, gene_id, (least(delete_end, g_end) - greatest(delete_start, g_start))::bigint AS overlap FROM ev JOIN genes ON contig = donor
    WHERE least(delete_end, g_end) - greatest(delete_start, g_start) >= 0.5 * (g_end - g_start)"""))
def j08b(v):
    segments = v.ev.select("event_id", F.col("donor").alias("contig"), "delete_start", "delete_end")
    out = joins.covered_pairs(segments, v.genes.drop("attrs"), ["contig"], ("delete_start", "delete_end"), ("g_start", "g_end"))
    return out.select("event_id", "gene_id", "overlap")


# calls are the truth of each sample in the other spelling, shifted by up to 60 bases
_TRUTH = """t AS (SELECT bkp_id, sample, from_ref AS r1, from_pos AS p1, to_ref AS r2, to_pos AS p2 FROM bkp),
    c0 AS (SELECT sample, to_ref AS r1, to_pos + (bkp_id % 121 - 60) AS p1, from_ref AS r2, from_pos - (bkp_id % 121 - 60) AS p2 FROM bkp),
    c AS (SELECT * FROM c0 UNION SELECT sample, r2, p2, r1, p1 FROM c0)"""


def _truth(v):
    # written, as both sides, the counts and the ways back read it, and the view's names cost more than the joins
    t = stored(v.bkp.selectExpr("bkp_id", "sample", "from_ref AS ref1", "from_pos AS pos1", "to_ref AS ref2", "to_pos AS pos2"))
    c = t.selectExpr("sample", "ref2 AS cref1", "pos2 + (bkp_id % 121 - 60) AS cpos1", "ref1 AS cref2", "pos1 - (bkp_id % 121 - 60) AS cpos2")
    return t, c


@query("j09_truth_found", oracle("bkp", "SELECT bkp_id FROM t WHERE EXISTS (SELECT 1 FROM c WHERE t.sample = c.sample AND t.r1 = c.r1 AND t.r2 = c.r2 AND abs(t.p1 - c.p1) < 50 AND abs(t.p2 - c.p2) < 50)", _TRUTH))
def j09(v):
    return joins.matched_truth(*_truth(v), by=["sample"]).select("bkp_id")


@query("a27_recall_fdr_f1", oracle("bkp", """
    SELECT round(found / nt::double, 2) AS recall, round(1 - right_ / nc::double, 2) AS fdr, round(2 * (found / nt::double) * (right_ / nc::double) / (found / nt::double + right_ / nc::double), 2) AS f1 FROM (
      SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM c0) AS nc,
      (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM c WHERE t.sample = c.sample AND t.r1 = c.r1 AND t.r2 = c.r2 AND abs(t.p1 - c.p1) < 50 AND abs(t.p2 - c.p2) < 50)) AS found,
      (SELECT count(*) FROM c0 WHERE EXISTS (SELECT 1 FROM (SELECT sample, r1, p1, r2, p2 FROM t UNION SELECT sample, r2, p2, r1, p1 FROM t) t WHERE t.sample = c0.sample AND t.r1 = c0.r1 AND t.r2 = c0.r2 AND abs(t.p1 - c0.p1) < 50 AND abs(t.p2 - c0.p2) < 50)) AS right_) x""", _TRUTH))
def a27(v):
    t, c = _truth(v)
    called = c.selectExpr("sample", "cref1 AS ref1", "cpos1 AS pos1", "cref2 AS ref2", "cpos2 AS pos2")
    swapped = t.selectExpr("sample", "ref1 AS cref1", "pos1 AS cpos1", "ref2 AS cref2", "pos2 AS cpos2")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(t, "nt").crossJoin(one(c, "nc")).crossJoin(one(joins.matched_truth(t, c, by=["sample"]), "found")).crossJoin(one(joins.matched_truth(called, swapped, by=["sample"]), "right"))  # one row each
    recall, precision = F.col("found") / F.col("nt").cast("double"), F.col("right") / F.col("nc").cast("double")
    return counts.select(F.round(recall, 2).alias("recall"), F.round(1 - precision, 2).alias("fdr"), F.round(2 * recall * precision / (recall + precision), 2).alias("f1"))


@query("j10_sample_pair_jaccard", oracle("ts", """
    SELECT a.sample AS s1, b.sample AS s2, round(count(*) / (min(x.n) + min(y.n) - count(*))::double, 9) AS jaccard
    FROM ts a JOIN ts b ON a.tag = b.tag AND a.sample < b.sample JOIN n x ON x.sample = a.sample JOIN n y ON y.sample = b.sample GROUP BY 1, 2""", "n AS (SELECT sample, count(*) AS n FROM ts GROUP BY sample)"))
def j10(v):
    tags = v.ts.select("sample", "tag")
    n = tags.groupBy("sample").agg(F.count("*").alias("n"))
    shared = tags.withColumnRenamed("sample", "s1").join(tags.withColumnRenamed("sample", "s2"), "tag").filter("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("k"))
    sized = shared.join(n.select(F.col("sample").alias("s1"), F.col("n").alias("n1")), "s1").join(n.select(F.col("sample").alias("s2"), F.col("n").alias("n2")), "s2")
    return sized.select("s1", "s2", F.round(F.col("k") / (F.col("n1") + F.col("n2") - F.col("k")).cast("double"), 9).alias("jaccard"))


@query("j11_fuzzy_jaccard", oracle("ev phe", """
    SELECT x.sample AS s1, y.sample AS s2, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))::double, 9) AS jaccard
    FROM n x JOIN n y ON x.cohort = y.cohort AND x.sample < y.sample LEFT JOIN (
      SELECT a.sample AS s1, b.sample AS s2, count(DISTINCT b.event_id) AS k FROM e a JOIN e b ON a.cohort = b.cohort AND a.sample < b.sample AND a.receptor = b.receptor AND a.donor = b.donor AND a.reverse_flag = b.reverse_flag
        AND abs(a.insert_locus - b.insert_locus) < 500 AND abs(a.delete_start - b.delete_start) < 500 AND abs(a.delete_end - b.delete_end) < 500 GROUP BY ALL) z ON z.s1 = x.sample AND z.s2 = y.sample""",
    "e AS (SELECT ev.*, cohort FROM ev JOIN phe USING (sample)), n AS (SELECT sample, cohort, count(*) AS n FROM e GROUP BY ALL)"))
def j11(v):
    """Samples of one cohort compared by their events: those of the second that meet one of the first within a tolerance on
    three coordinates, over all of the first and those of the second that meet none."""
    e = v.ev.join(v.phe.select("sample", "cohort"), "sample")
    key = ["cohort", "receptor", "donor", "reverse_flag"]
    a = e.select(*key, F.col("sample").alias("s1"), F.col("insert_locus").alias("i"), F.col("delete_start").alias("s"), F.col("delete_end").alias("e"))
    b = e.select(*key, F.col("sample").alias("s2"), "event_id", "insert_locus", "delete_start", "delete_end")
    near = joins.band_join(b, a, key, "insert_locus", "i", 500).filter("s1 < s2 AND abs(s - delete_start) < 500 AND abs(e - delete_end) < 500")
    shared = near.select("s1", "s2", "event_id").distinct().groupBy("s1", "s2").agg(F.count("*").alias("k"))
    n = e.groupBy("cohort", "sample").agg(F.count("*").alias("n"))
    pairs = n.select("cohort", F.col("sample").alias("s1"), F.col("n").alias("n1")).join(n.select("cohort", F.col("sample").alias("s2"), F.col("n").alias("n2")), "cohort").filter("s1 < s2")
    k = F.coalesce("k", F.lit(0))
    return pairs.join(shared, ["s1", "s2"], "left").select("s1", "s2", F.round(k / (F.col("n1") + F.col("n2") - k).cast("double"), 9).alias("jaccard"))


@query("j12_fallback_lookup", oracle("abund phe", """
    SELECT sample, coalesce(a.abundance, b.abundance) AS abundance FROM phe LEFT JOIN d a ON a.k = concat(sample, '_s__S3') LEFT JOIN d b ON b.k = concat(sample, '_s__S5')""", "d AS (SELECT concat(sample, '_', species) AS k, abundance FROM abund)"))
def j12(v):
    dim = v.abund.select(F.concat_ws("_", "sample", "species").alias("k"), "abundance")
    return joins.fallback_join(v.phe, dim, [F.concat("sample", F.lit("_s__S3")), F.concat("sample", F.lit("_s__S5"))], "k", "abundance").select("sample", "abundance")


@query("j13_binned_spellings", oracle("bkp ev", """
    SELECT DISTINCT bkp_id, event_id FROM b JOIN k USING (tag)""", """
    b AS (SELECT bkp_id, concat_ws('&', from_ref, (round_even(from_pos / 200::double, 0)::bigint)::varchar, to_ref, (round_even(to_pos / 200::double, 0)::bigint)::varchar) AS tag FROM bkp),
    r AS (SELECT event_id, receptor, donor, round_even(insert_locus / 200::double, 0)::bigint AS i, round_even(delete_start / 200::double, 0)::bigint AS s, round_even(delete_end / 200::double, 0)::bigint AS e FROM ev),
    k AS (SELECT event_id, concat_ws('&', receptor, i::varchar, donor, s::varchar) AS tag FROM r UNION ALL SELECT event_id, concat_ws('&', receptor, i::varchar, donor, e::varchar) FROM r
      UNION ALL SELECT event_id, concat_ws('&', donor, s::varchar, receptor, i::varchar) FROM r UNION ALL SELECT event_id, concat_ws('&', donor, e::varchar, receptor, i::varchar) FROM r)"""))
def j13(v):
    b = v.bkp.select("bkp_id", X.hgt_tag(*[F.col(c) for c in ("from_ref", "from_pos", "to_ref", "to_pos")], 200, even=True).alias("tag"))
    c = {n: F.col(n) for n in ("receptor", "insert_locus", "donor", "delete_start", "delete_end")}
    spellings = [X.hgt_tag(c["receptor"], c["insert_locus"], c["donor"], c[d], 200, True) for d in ("delete_start", "delete_end")] + [X.hgt_tag(c["donor"], c[d], c["receptor"], c["insert_locus"], 200, True) for d in ("delete_start", "delete_end")]
    return b.join(v.ev.select("event_id", F.explode(F.array(*spellings)).alias("tag")), "tag").select("bkp_id", "event_id").distinct()


@query("j14_enrichment_split", oracle("genes ev", """
    SELECT ko, count(*) FILTER (WHERE inside)::bigint AS n_in, count(*) FILTER (WHERE NOT inside)::bigint AS n_out FROM (
      SELECT gene_id, replace(unnest(string_split(regexp_extract(attrs, 'KEGG=([^;]*)', 1), ',')), 'ko:', '') AS ko,
        EXISTS (SELECT 1 FROM ev WHERE receptor = contig AND insert_locus BETWEEN g_start AND g_end) AS inside FROM genes) x GROUP BY ko"""))
def j14(v):
    # a gene holds an insertion if the last one up to its end lies in it
    places = v.ev.select(F.col("receptor").alias("contig"), "insert_locus").distinct()
    met = joins.asof_join(v.genes.select("contig", "g_start", "g_end", "attrs"), places, ["contig"], "g_end", "insert_locus")
    kos = met.select(F.when(F.col("insert_locus") >= F.col("g_start"), 1).alias("hit"), F.explode(X.ko_list(F.col("attrs"))).alias("ko"))
    return kos.groupBy("ko").agg(F.count("hit").alias("n_in"), (F.count("*") - F.count("hit")).alias("n_out"))


@query("j15_marker_rows", oracle("bkp tax", """
    SELECT bkp_id, NOT (a.genus || b.genus IN (SELECT g FROM mk)) AS other FROM bkp JOIN tax a ON a.genome = from_genome JOIN tax b ON b.genome = to_genome""", """
    mk AS (SELECT a.genus || b.genus AS g FROM bkp JOIN tax a ON a.genome = from_genome JOIN tax b ON b.genome = to_genome GROUP BY 1 HAVING count(DISTINCT sample) >= 20)"""))
def j15(v):
    a, b = v.tax.select(F.col("genome").alias("from_genome"), F.col("genus").alias("g1")), v.tax.select(F.col("genome").alias("to_genome"), F.col("genus").alias("g2"))
    rows = v.bkp.join(a, "from_genome").join(b, "to_genome").withColumn("g", F.concat("g1", "g2"))
    markers = rows.groupBy("g").agg(F.countDistinct("sample").alias("n")).filter("n >= 20").select("g")
    found = rows.join(markers, "g", "left_semi").select("bkp_id", F.lit(False).alias("other"))
    return found.unionByName(rows.join(markers, "g", "left_anti").select("bkp_id", F.lit(True).alias("other")))


@query("j16_run_pairing", oracle("phe", "SELECT a.sample AS s1, b.sample AS s2 FROM phe a JOIN phe b ON a.age + 20 = b.age"))
def j16(v):
    b = v.phe.select(F.col("sample").alias("s2"), (F.col("age") - 20).alias("age"))
    return v.phe.select(F.col("sample").alias("s1"), "age").join(b, "age").select("s1", "s2")


@query("j17_phylum_relation", oracle("bkp tax", "SELECT bkp_id, CASE WHEN a.phylum = b.phylum THEN 'intra' ELSE 'inter' END AS relation FROM bkp JOIN tax a ON a.genome = from_genome JOIN tax b ON b.genome = to_genome"))
def j17(v):
    a, b = v.tax.select(F.col("genome").alias("from_genome"), F.col("phylum").alias("p1")), v.tax.select(F.col("genome").alias("to_genome"), F.col("phylum").alias("p2"))
    return v.bkp.join(a, "from_genome").join(b, "to_genome").select("bkp_id", F.when(F.col("p1") == F.col("p2"), "intra").otherwise("inter").alias("relation"))
