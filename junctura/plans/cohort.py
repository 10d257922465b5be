"""Cohort aggregates: counts, shares, frequencies and matrices of samples, taxa and tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as X
from .binding import oracle
from .catalog import query
from .projections import CLASSES


@query("a01_insert_size", oracle("aln", """
    SELECT round(avg(tlen), 6) AS mean, round(stddev_samp(tlen), 6) AS sd, floor(avg(tlen) + 2 * stddev_samp(tlen))::bigint AS insert_size
    FROM (SELECT * FROM aln WHERE flag & 3 = 3 AND flag & 3084 = 0 AND tlen > 0 AND tlen < 1000 ORDER BY aln_id LIMIT 10001) x"""))
def a01(v):
    first = v.aln.filter(X.proper_pair(F.col("flag"), F.col("tlen"))).orderBy("aln_id").limit(10001)
    mean, sd = F.avg("tlen"), F.stddev_samp("tlen")
    return first.agg(F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.floor(mean + 2 * sd).cast("long").alias("insert_size"))


@query("a03_split_support", oracle("bkp aln", """
    SELECT bkp_id, count(DISTINCT CASE WHEN side = 1 THEN qname END)::bigint AS n_from, count(DISTINCT CASE WHEN side = 2 THEN qname END)::bigint AS n_to, count(DISTINCT qname)::bigint AS n_any FROM (
      SELECT bkp_id, 1 AS side, qname FROM bkp JOIN a ON contig = from_ref AND abs(gp - from_pos) <= 60 UNION ALL SELECT bkp_id, 2, qname FROM bkp JOIN a ON contig = to_ref AND abs(gp - to_pos) <= 60) x GROUP BY bkp_id""",
    "a AS (SELECT qname, split_part(ref, ':', 1) AS contig, regexp_extract(ref, ':([0-9]+)-', 1)::bigint + pos AS gp FROM aln)"))
def a03(v):
    from ..operators.joins import distinct_near

    a = v.aln.select("qname", X.segment_contig(F.col("ref")).alias("contig"), X.segment_to_global(F.col("ref"), F.col("pos")).alias("at"))
    side = lambda n, ref, pos: v.bkp.select("bkp_id", F.lit(n).alias("side"), F.col(ref).alias("contig"), F.col(pos).alias("pos"))
    counts = distinct_near(side(1, "from_ref", "from_pos").unionByName(side(2, "to_ref", "to_pos")), a, "bkp_id", "qname", 60)
    return counts.select("bkp_id", F.col("n_1").alias("n_from"), F.col("n_2").alias("n_to"), "n_any")


@query("a04_breakpoints_per_sample", oracle("bkp phe", """
    SELECT full_disease, round(avg(n), 6) AS mean, round(median(n)::double, 6) AS med, min(n)::bigint AS lo, max(n)::bigint AS hi, round(sum(bases) / 1e9::double, 3) AS gbp
    FROM (SELECT sample, count(*) AS n FROM bkp GROUP BY sample) x JOIN phe USING (sample) GROUP BY full_disease"""))
def a04(v):
    n = v.bkp.groupBy("sample").agg(F.count("*").alias("n")).join(v.phe, "sample")
    return n.groupBy("full_disease").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n").cast("double"), 6).alias("med"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.sum("bases") / F.lit(1e9), 3).alias("gbp"))


@query("a05_genome_pairs", oracle("bkp", "SELECT least(from_genome, to_genome) || '&' || greatest(from_genome, to_genome) AS pair, count(*)::bigint AS n, count(DISTINCT sample)::bigint AS n_samples FROM bkp GROUP BY 1"))
def a05(v):
    return v.bkp.groupBy(X.pair_tag(F.col("from_genome"), F.col("to_genome")).alias("pair")).agg(F.count("*").alias("n"), F.countDistinct("sample").alias("n_samples"))


_BOTH = "w AS (SELECT bkp.*, a.phylum AS p1, b.phylum AS p2, a.genus AS g1, b.genus AS g2, a.species AS s1, b.species AS s2 FROM bkp JOIN tax a ON a.genome = from_genome JOIN tax b ON b.genome = to_genome)"


def with_taxa(v):
    one = v.tax.selectExpr("genome AS from_genome", "phylum AS p1", "genus AS g1", "species AS s1")
    two = v.tax.selectExpr("genome AS to_genome", "phylum AS p2", "genus AS g2", "species AS s2")
    return v.bkp.join(one, "from_genome").join(two, "to_genome")


@query("a06_intra_ratio", oracle("bkp tax", "SELECT sample, 'phylum' AS level, round(avg((p1 = p2)::int), 9) AS intra FROM w GROUP BY sample UNION ALL SELECT sample, 'genus', round(avg((g1 = g2)::int), 9) FROM w WHERE length(g1) > 3 AND length(g2) > 3 GROUP BY sample", _BOTH))
def a06(v):
    w = with_taxa(v)
    levels = F.array(F.struct(F.lit("phylum").alias("level"), F.col("p1").alias("a"), F.col("p2").alias("b")), F.struct(F.lit("genus").alias("level"), F.col("g1").alias("a"), F.col("g2").alias("b")))
    rows = w.select("sample", F.explode(levels).alias("x")).select("sample", "x.*").filter("length(a) > 3 AND length(b) > 3")
    return rows.groupBy("sample", "level").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 9).alias("intra"))


@query("a07_taxon_frequency", oracle("bkp tax", """
    SELECT taxon, round(avg(share), 9) AS frequency, count(*)::bigint AS n_samples FROM (
      SELECT sample, taxon, count(*) / (sum(count(*)) OVER (PARTITION BY sample))::double AS share FROM (SELECT sample, g1 AS taxon FROM w UNION ALL SELECT sample, g2 FROM w) x GROUP BY sample, taxon) y
    GROUP BY taxon HAVING count(*) >= 0.1 * (SELECT count(DISTINCT sample) FROM bkp)""", _BOTH))
def a07(v):
    ends = with_taxa(v).select("sample", F.explode(F.array("g1", "g2")).alias("taxon")).groupBy("sample", "taxon").agg(F.count("*").alias("n"))
    share = ends.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample")).cast("double"))
    total = ends.agg(F.countDistinct("sample").alias("all"))
    agg = share.groupBy("taxon").agg(F.round(F.avg("share"), 9).alias("frequency"), F.count("*").alias("n_samples"))
    return agg.crossJoin(F.broadcast(total)).filter("n_samples >= 0.1 * all").drop("all")  # one row


@query("a07b_frequency_by_abundance", oracle("bkp tax abund", """
    SELECT species, round(avg(n / abundance), 6) AS per_abundance FROM (SELECT sample, s1 AS species, count(*) AS n FROM w GROUP BY ALL) x JOIN abund USING (sample, species) WHERE abundance > 0 GROUP BY species""", _BOTH))
def a07b(v):
    n = with_taxa(v).groupBy("sample", F.col("s1").alias("species")).agg(F.count("*").alias("n"))
    return n.join(v.abund.filter("abundance > 0"), ["sample", "species"]).groupBy("species").agg(F.round(F.avg(F.col("n") / F.col("abundance")), 6).alias("per_abundance"))


_TOP = "t AS (SELECT taxon FROM (SELECT g1 AS taxon FROM w UNION ALL SELECT g2 FROM w) x GROUP BY taxon ORDER BY count(*) DESC, taxon LIMIT 5), o AS (SELECT coalesce(a.taxon, 'Others') AS x, coalesce(b.taxon, 'Others') AS y FROM w LEFT JOIN t a ON a.taxon = g1 LEFT JOIN t b ON b.taxon = g2)"


@query("a08_top_taxa_contingency", oracle("bkp tax", "SELECT greatest(x, y) AS a, least(x, y) AS b, count(*)::bigint AS n FROM o GROUP BY 1, 2", f"{_BOTH}, {_TOP}"))
def a08(v):
    """Lower-triangular counts of pairs of the five most frequent taxa and `Others`."""
    w = with_taxa(v).select("g1", "g2")
    top = w.select(F.explode(F.array("g1", "g2")).alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(5).select("t")
    name = lambda df, c, n: df.join(F.broadcast(top.withColumnRenamed("t", n)), F.col(c) == F.col(n), "left").withColumn(n, F.coalesce(n, F.lit("Others")))  # noqa: E731  five rows
    return name(name(w, "g1", "x"), "g2", "y").groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.count("*").alias("n"))


@query("a09_pairs_by_distance", oracle("bkp tax", """
    SELECT (floor(d / 0.5::double) / 2)::double AS bin, count(*)::bigint AS n_pairs, round(avg(n), 6) AS mean FROM (SELECT s1, s2, count(*) AS n, abs(substring(s1, 5)::bigint - substring(s2, 5)::bigint) / 7::double AS d FROM w GROUP BY ALL) x GROUP BY 1""", _BOTH))
def a09(v):
    """Pairs of species in half-wide bins of a distance."""
    number = lambda c: F.substring(c, 5, 9).cast("long")
    n = with_taxa(v).groupBy("s1", "s2").agg(F.count("*").alias("n")).withColumn("d", F.abs(number("s1") - number("s2")) / F.lit(7.0))
    return n.groupBy((F.floor(F.col("d") / 0.5) / F.lit(2.0)).alias("bin")).agg(F.count("*").alias("n_pairs"), F.round(F.avg("n"), 6).alias("mean"))


_GROUPS = "g AS (SELECT sample, full_disease = 'CRC' AS crc FROM phe WHERE full_disease IN ('CRC', 'healthy')), d AS (SELECT DISTINCT sample, least(from_genome, to_genome) || '&' || greatest(from_genome, to_genome) AS tag FROM bkp)"


def presence(v):
    """tag, a and b: case and control samples with the tag; c and d: without it."""
    g = v.phe.filter("full_disease IN ('CRC', 'healthy')").select("sample", (F.col("full_disease") == "CRC").alias("crc"))
    tags = v.bkp.select("sample", X.pair_tag(F.col("from_genome"), F.col("to_genome")).alias("tag")).distinct()
    n = g.agg(F.sum(F.col("crc").cast("long")).alias("n1"), F.sum((~F.col("crc")).cast("long")).alias("n0"))
    agg = tags.join(g, "sample").groupBy("tag").agg(F.sum(F.col("crc").cast("long")).alias("a"), F.sum((~F.col("crc")).cast("long")).alias("b"))
    return agg.crossJoin(F.broadcast(n)).select("tag", "a", "b", (F.col("n1") - F.col("a")).alias("c"), (F.col("n0") - F.col("b")).alias("d"))  # one row


@query("a10_presence_counts", oracle("bkp phe", """
    SELECT tag, a, b, (n1 - a)::bigint AS c, (n0 - b)::bigint AS d FROM (SELECT tag, count(*) FILTER (WHERE crc)::bigint AS a, count(*) FILTER (WHERE NOT crc)::bigint AS b FROM d JOIN g USING (sample) GROUP BY tag) x,
      (SELECT count(*) FILTER (WHERE crc) AS n1, count(*) FILTER (WHERE NOT crc) AS n0 FROM g) y""", _GROUPS))
def a10(v):
    return presence(v)


@query("a11_recurrent_tags", oracle("ts", "SELECT tag, count(DISTINCT sample)::bigint AS n FROM ts GROUP BY tag HAVING count(DISTINCT sample) >= 8"))
def a11(v):
    return v.ts.groupBy("tag").agg(F.countDistinct("sample").alias("n")).filter("n >= 8")


@query("a12_conserved_tags", oracle("ts", """
    SELECT individual, count(*) FILTER (WHERE n = 10)::bigint AS conserved, count(*) FILTER (WHERE n > 5)::bigint AS common, count(*) FILTER (WHERE n = 1)::bigint AS once
    FROM (SELECT individual, tag, count(DISTINCT time_point) AS n FROM ts GROUP BY ALL) x GROUP BY individual"""))
def a12(v):
    n = v.ts.groupBy("individual", "tag").agg(F.countDistinct("time_point").alias("n"))
    return n.groupBy("individual").agg(F.count_if(F.col("n") == 10).alias("conserved"), F.count_if(F.col("n") > 5).alias("common"), F.count_if(F.col("n") == 1).alias("once"))


@query("a13_tags_by_time", oracle("ts", "SELECT individual, " + ", ".join(f"count(*) FILTER (WHERE time_point = {t})::bigint AS t{t}" for t in range(10)) + " FROM ts GROUP BY individual"))
def a13(v):
    out = v.ts.groupBy("individual").pivot("time_point", list(range(10))).agg(F.count(F.lit(1))).fillna(0)
    return out.select("individual", *[F.col(str(t)).cast("long").alias(f"t{t}") for t in range(10)])


@query("a14_multiplicity", oracle("ev", """
    SELECT CASE WHEN n > 10 THEN '>10' ELSE n::varchar END AS sites, count(*)::bigint AS n_segments FROM (
      SELECT concat_ws('&', donor, round_even(delete_start / 100::double, 0)::bigint::varchar, round_even(delete_end / 100::double, 0)::bigint::varchar) AS seg, count(DISTINCT receptor || '&' || insert_locus) AS n FROM ev GROUP BY seg) x GROUP BY 1"""))
def a14(v):
    seg = F.concat_ws("&", "donor", X.bin_even(F.col("delete_start"), 100).cast("string"), X.bin_even(F.col("delete_end"), 100).cast("string"))
    n = v.ev.groupBy(seg.alias("seg")).agg(F.countDistinct("receptor", "insert_locus").alias("n"))
    return n.groupBy(F.when(F.col("n") > 10, ">10").otherwise(F.col("n").cast("string")).alias("sites")).agg(F.count("*").alias("n_segments"))


@query("a15_merged_segments", None)
def a15(v):
    """Donor segments of each sample merged greedily."""
    from ..operators.greedy import merge_segments

    rows = v.ev.select("sample", "donor", F.col("event_id").alias("row_id"), F.col("delete_start").alias("start"), F.col("delete_end").alias("end"), F.col("receptor").alias("recipient"))
    return merge_segments(rows, ["sample", "donor"])


@query("a16_unique_events", oracle("ev", "SELECT sample, round(count(*) FILTER (WHERE n = 1) / count(*)::double, 9) AS unique_ratio FROM (SELECT sample, receptor, donor, count(*) AS n FROM ev GROUP BY ALL) x GROUP BY sample"))
def a16(v):
    n = v.ev.groupBy("sample", "receptor", "donor").agg(F.count("*").alias("n"))
    return n.groupBy("sample").agg(F.round(F.count_if(F.col("n") == 1) / F.count("*").cast("double"), 9).alias("unique_ratio"))


@query("a17_length_stats", oracle("ev", "SELECT reverse_flag, round(avg(delete_end - delete_start), 6) AS mean, median(delete_end - delete_start)::double AS med, min(delete_end - delete_start)::bigint AS lo, max(delete_end - delete_start)::bigint AS hi, sum(delete_end - delete_start)::bigint AS total FROM ev GROUP BY reverse_flag"))
def a17(v):
    length = F.col("delete_end") - F.col("delete_start")
    return v.ev.groupBy("reverse_flag").agg(F.round(F.avg(length), 6).alias("mean"), F.median(length).alias("med"), F.min(length).alias("lo"), F.max(length).alias("hi"), F.sum(length).alias("total"))


@query("a18_transposon_segments", oracle("genes ev", """
    SELECT donor, count(*)::bigint AS n, count(*) FILTER (WHERE tr)::bigint AS n_transposon FROM (
      SELECT donor, delete_start, delete_end, bool_or(cls = 'transposon') AS tr FROM (SELECT DISTINCT donor, delete_start, delete_end FROM ev) s JOIN c ON contig = donor AND least(delete_end, g_end) - greatest(delete_start, g_start) >= 0 GROUP BY ALL) x GROUP BY donor""",
    f"c AS (SELECT contig, g_start, g_end, {CLASSES} AS cls FROM (SELECT *, regexp_extract(attrs, 'product=([^;]*)', 1) AS product FROM genes) p)"))
def a18(v):
    from ..operators.joins import overlap_join

    segments = v.ev.select(F.col("donor").alias("contig"), "delete_start", "delete_end").distinct()
    genes = v.genes.select("contig", "g_start", "g_end", X.product_class(X.attributes(F.col("attrs"))["product"]).alias("cls"))
    met = overlap_join(segments, genes, ["contig"], ("delete_start", "delete_end"), ("g_start", "g_end"), F.lit(0))
    flags = met.groupBy("contig", "delete_start", "delete_end").agg(F.bool_or(F.col("cls") == "transposon").alias("tr"))
    return flags.groupBy(F.col("contig").alias("donor")).agg(F.count("*").alias("n"), F.count_if("tr").alias("n_transposon"))


@query("a19_category_counts", oracle("genes", "SELECT cog, count(*)::bigint AS n FROM (SELECT unnest(string_split(regexp_extract(attrs, 'COG=([A-Z]*)', 1), '')) AS cog FROM genes) x WHERE cog <> '' GROUP BY cog"))
def a19(v):
    letters = F.explode(F.split(X.attributes(F.col("attrs"))["COG"], ""))
    return v.genes.select(letters.alias("cog")).filter("cog <> ''").groupBy("cog").agg(F.count("*").alias("n"))


@query("a20_pathway_counts", oracle("genes ko_pathway", """
    SELECT pathway, count(*)::bigint AS n FROM (SELECT replace(unnest(string_split(regexp_extract(attrs, 'KEGG=([^;]*)', 1), ',')), 'ko:', '') AS ko FROM genes) x JOIN ko_pathway USING (ko) WHERE pathway NOT LIKE 'ko%' GROUP BY pathway"""))
def a20(v):
    kos = v.genes.select(F.explode(X.ko_list(F.col("attrs"))).alias("ko"))
    return kos.join(v.ko_pathway.filter("pathway NOT LIKE 'ko%'"), "ko").groupBy("pathway").agg(F.count("*").alias("n"))


@query("a21_selected_ko_counts", oracle("genes", "SELECT contig, count(*)::bigint AS n FROM (SELECT contig, replace(unnest(string_split(regexp_extract(attrs, 'KEGG=([^;]*)', 1), ',')), 'ko:', '') AS ko FROM genes) x WHERE ko IN ('K1', 'K5', 'K12', 'K44') GROUP BY contig"))
def a21(v):
    kos = v.genes.select("contig", F.explode(X.ko_list(F.col("attrs"))).alias("ko"))
    return kos.filter(F.col("ko").isin("K1", "K5", "K12", "K44")).groupBy("contig").agg(F.count("*").alias("n"))


@query("a22_shares_per_sample", oracle("ev", "SELECT sample, event_id % 5 AS mech, round(count(*) / (sum(count(*)) OVER (PARTITION BY sample))::double, 9) AS share FROM ev GROUP BY sample, event_id % 5"))
def a22(v):
    n = v.ev.groupBy("sample", (F.col("event_id") % 5).alias("mech")).agg(F.count("*").alias("n"))
    return n.select("sample", "mech", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("sample")).cast("double"), 9).alias("share"))


@query("a23_taxon_support", oracle("bkp tax", "SELECT a, b, round(count(DISTINCT sample) / (SELECT count(DISTINCT sample) FROM bkp)::double, 3) AS freq FROM (SELECT sample, g1 AS a, g2 AS b FROM w UNION ALL SELECT sample, g2, g1 FROM w) x GROUP BY a, b", _BOTH))
def a23(v):
    w = with_taxa(v)
    both = w.select("sample", F.explode(F.array(F.struct(F.col("g1").alias("a"), F.col("g2").alias("b")), F.struct(F.col("g2").alias("a"), F.col("g1").alias("b")))).alias("x")).select("sample", "x.*")
    total = v.bkp.agg(F.countDistinct("sample").alias("all"))
    n = both.groupBy("a", "b").agg(F.countDistinct("sample").alias("n")).crossJoin(F.broadcast(total))  # one row
    return n.select("a", "b", F.round(F.col("n") / F.col("all").cast("double"), 3).alias("freq"))


@query("a24_top_pairs", oracle("bkp tax", "SELECT g1, p1, count(DISTINCT sample)::bigint AS n FROM w GROUP BY g1, p1 ORDER BY n DESC, g1, p1 LIMIT 60", _BOTH))
def a24(v):
    return with_taxa(v).groupBy("g1", "p1").agg(F.countDistinct("sample").alias("n")).orderBy(F.desc("n"), "g1", "p1").limit(60)


@query("a25_marker_abundance", oracle("abund tax", "SELECT sample, round(sum(abundance), 3) AS total FROM abund WHERE species IN (SELECT species FROM tax WHERE phylum = 'p__P1') GROUP BY sample"))
def a25(v):
    markers = v.tax.filter("phylum = 'p__P1'").select("species")
    return v.abund.join(markers, "species", "left_semi").groupBy("sample").agg(F.round(F.sum("abundance"), 3).alias("total"))


@query("a26_saturation", oracle("bkp contigs", """
    SELECT from_genome, f AS fraction, count(*) FILTER (WHERE bkp_id % 10 < f)::bigint AS n, round(count(*) FILTER (WHERE bkp_id % 10 < f) * 300 / min(glen)::double, 2) AS depth
    FROM bkp JOIN (SELECT regexp_replace(contig, '_[^_]*$', '') AS genome, sum(len) AS glen FROM contigs GROUP BY 1) c ON genome = from_genome, (SELECT unnest([2, 4, 6, 8, 10])::bigint AS f) y GROUP BY 1, 2"""))
def a26(v):
    glen = v.contigs.groupBy(X.genome(F.col("contig")).alias("from_genome")).agg(F.sum("len").alias("glen"))
    rows = v.bkp.join(glen, "from_genome").select("from_genome", "glen", (F.col("bkp_id") % 10).alias("k"), F.explode(F.array(*[F.lit(f).cast("long") for f in (2, 4, 6, 8, 10)])).alias("fraction"))
    n = F.count_if(F.col("k") < F.col("fraction"))
    return rows.groupBy("from_genome", "fraction").agg(n.alias("n"), F.round(n * 300 / F.min("glen").cast("double"), 2).alias("depth"))


@query("a28_cohort_sizes", oracle("phe", "SELECT cohort, disease, count(*)::bigint AS n FROM phe GROUP BY cohort, disease"))
def a28(v):
    return v.phe.groupBy("cohort", "disease").agg(F.count("*").alias("n"))


@query("a29_species_interactions", oracle("bkp tax", "SELECT s1, s2, (count(DISTINCT sample) > 5)::int AS linked FROM w GROUP BY s1, s2", _BOTH))
def a29(v):
    return with_taxa(v).groupBy("s1", "s2").agg((F.countDistinct("sample") > 5).cast("int").alias("linked"))


@query("a30_s06_lengths", oracle("contigs", "SELECT regexp_replace(contig, '_[^_]*$', '') AS genome, sum(len)::bigint AS total FROM contigs GROUP BY 1"))
def a30(v):
    return v.contigs.groupBy(X.genome(F.col("contig")).alias("genome")).agg(F.sum("len").alias("total"))
