"""Projections, filters and scalar functions over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import events
from .binding import oracle
from .catalog import query


@query("f08_inter_genome", oracle("bkp", "SELECT bkp_id, from_genome, to_genome FROM bkp"))
def f08(v):
    return events.inter_genome(v.bkp_all).select("bkp_id", X.genome(F.col("from_ref")).alias("from_genome"), X.genome(F.col("to_ref")).alias("to_genome"))


@query("f09_f10_abundance", oracle("bkp reads_num", """
    SELECT bkp_id, round(cross_split_reads / reads_num::double, 12) AS abundance,
      round(cross_split_reads / (sum(cross_split_reads) OVER (PARTITION BY sample))::double, 9) AS split_abundance
    FROM bkp JOIN reads_num USING (sample) WHERE cross_split_reads / reads_num::double >= 1e-6"""))
def f09(v):
    out = events.with_abundance(v.bkp, v.reads_num, 1e-6)
    return out.select("bkp_id", F.round("abundance", 12).alias("abundance"), F.round("split_abundance", 9).alias("split_abundance"))


@query("f11_f12_support_and_ends", oracle("bkp contigs", """
    SELECT bkp_id FROM bkp JOIN contigs a ON a.contig = from_ref JOIN contigs b ON b.contig = to_ref
    WHERE cross_split_reads >= 2 AND from_pos BETWEEN 100 AND a.len - 100 AND to_pos BETWEEN 100 AND b.len - 100"""))
def f11(v):
    return events.away_from_ends(v.bkp.filter("cross_split_reads >= 2"), v.contigs).select("bkp_id")


@query("f01_proper_pairs", oracle("aln", "SELECT aln_id FROM aln WHERE flag & 3 = 3 AND flag & 3084 = 0 AND tlen > 0 AND tlen < 1000"))
def f01(v):
    return v.aln.filter(X.proper_pair(F.col("flag"), F.col("tlen"))).select("aln_id")


@query("f02_discordant_reads", oracle("aln", """
    SELECT aln_id, qname FROM (SELECT *, count(*) OVER (PARTITION BY qname) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY qname ORDER BY aln_id) AS r FROM aln WHERE mapq >= 20 AND flag < 2048) x WHERE r <= 2) y WHERE n = 2"""))
def f02(v):
    from pyspark.sql import Window

    w = Window.partitionBy("qname")
    first = v.aln.filter("mapq >= 20 and flag < 2048").withColumn("r", F.row_number().over(w.orderBy("aln_id"))).filter("r <= 2")
    return first.withColumn("n", F.count("*").over(w)).filter("n = 2").select("aln_id", "qname")


@query("f03_mapq", oracle("aln", "SELECT aln_id FROM aln WHERE mapq >= 30"))
def f03(v):
    return v.aln.filter("mapq >= 30").select("aln_id")


_SPAN = """coalesce(nullif(regexp_extract(cigar, '{0}', 1), '')::bigint, 0)"""
_LEFT, _RIGHT = _SPAN.format("^([0-9]+)[SH]"), _SPAN.format("([0-9]+)[SH]$")
_MI = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MI]', 1), lambda x: x::bigint)), 0)::bigint"


@query("f05_cigar_spans", oracle("aln", f"""
    SELECT aln_id, s::bigint AS q_start, (s + m - 1)::bigint AS q_end, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: x::bigint)), 0)::bigint AS ref_length, side
    FROM (SELECT *, CASE WHEN flag & 16 <> 0 THEN {_RIGHT} ELSE {_LEFT} END AS s, {_MI} AS m, CASE WHEN {_RIGHT} > {_LEFT} THEN 'right' ELSE 'left' END AS side FROM aln) x"""))
def f05(v):
    span = X.cigar_query_span(F.col("cigar"), X.has(F.col("flag"), X.REVERSE))
    return v.aln.select("aln_id", span.start.alias("q_start"), span.end.alias("q_end"), X.reference_length(F.col("cigar")).alias("ref_length"), X.clip_side(F.col("cigar")).alias("side"))


@query("f04_split_reads", oracle("aln", """
    SELECT qname, non_overlap FROM (
      SELECT qname, (least(x.m, y.m) - greatest(0, least(x.a + x.m, y.a + y.m) - greatest(x.a, y.a)))::bigint AS non_overlap
      FROM (SELECT qname, count(*) AS n, min(struct_pack(i := aln_id, a := a, m := m)) AS x, max(struct_pack(i := aln_id, a := a, m := m)) AS y FROM s GROUP BY qname) p WHERE n = 2) z WHERE non_overlap >= 20""",
    f"s AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN {_RIGHT} ELSE {_LEFT} END AS a, {_MI} AS m FROM aln WHERE flag & 1024 = 0)"))
def f04(v):
    """Reads with exactly two alignments that are not duplicates and leave 20 bases or more of their own."""
    span = X.cigar_query_span(F.col("cigar"), X.has(F.col("flag"), X.REVERSE))
    parts = v.aln.filter(~X.has(F.col("flag"), X.DUPLICATE)).groupBy("qname").agg(F.count("*").alias("n"), F.min(F.struct("aln_id", span.alias("s"))).alias("x"), F.max(F.struct("aln_id", span.alias("s"))).alias("y"))
    parts = parts.select("qname", "n", F.col("x.s").alias("x"), F.col("y.s").alias("y"))
    shortest = F.least(F.col("x.end") - F.col("x.start"), F.col("y.end") - F.col("y.start")) + 1
    own = shortest - X.span_overlap(F.col("x"), F.col("y"))
    return parts.filter("n = 2").select("qname", own.alias("non_overlap")).filter("non_overlap >= 20")


@query("f07_f13_segment_positions", oracle("aln", """
    SELECT aln_id, split_part(ref, ':', 1) AS contig, (regexp_extract(ref, ':([0-9]+)-', 1)::bigint + pos)::bigint AS global_pos,
      (pos < 15 AND regexp_extract(ref, ':([0-9]+)-', 1)::bigint > 100) OR (regexp_extract(ref, '-([0-9]+)$', 1)::bigint - regexp_extract(ref, ':([0-9]+)-', 1)::bigint - pos < 15) AS end_point
    FROM aln"""))
def f07(v):
    r, p = F.col("ref"), F.col("pos")
    return v.aln.select("aln_id", X.segment_contig(r).alias("contig"), X.segment_to_global(r, p).alias("global_pos"), X.at_segment_end(r, p).alias("end_point"))


@query("f06_bed_rows", oracle("genes", "SELECT gene_id, greatest(g_start, 1)::bigint AS s, g_end AS e FROM genes WHERE g_end - greatest(g_start, 1) >= 500"))
def f06(v):
    return v.genes.select("gene_id", F.greatest("g_start", F.lit(1).cast("long")).alias("s"), F.col("g_end").alias("e")).filter("e - s >= 500")


@query("f14_disease_groups", oracle("phe", "SELECT sample, full_disease AS grp FROM phe WHERE full_disease NOT LIKE '%;%' AND full_disease IN ('healthy', 'CRC')"))
def f14(v):
    return v.phe.filter((F.size(F.split("full_disease", ";")) == 1) & F.col("full_disease").isin("healthy", "CRC")).select("sample", F.col("full_disease").alias("grp"))


@query("f15_prevalence", oracle("bkp tax", """
    SELECT phylum, count(DISTINCT sample)::bigint AS n FROM (SELECT sample, phylum FROM bkp JOIN tax ON genome = from_genome UNION ALL SELECT sample, phylum FROM bkp JOIN tax ON genome = to_genome) x
    GROUP BY phylum HAVING count(DISTINCT sample) >= 0.1 * (SELECT count(DISTINCT sample) FROM bkp)"""))
def f15(v):
    ends = v.bkp.select("sample", F.explode(F.array("from_genome", "to_genome")).alias("genome")).join(v.tax, "genome")
    n = v.bkp.agg(F.countDistinct("sample").alias("all"))
    return ends.groupBy("phylum").agg(F.countDistinct("sample").alias("n")).crossJoin(F.broadcast(n)).filter("n >= 0.1 * all").drop("all")  # one row


@query("f16_annotated", oracle("tax", "SELECT genome, genus FROM tax WHERE length(genus) > 3"))
def f16(v):
    return v.tax.filter(X.annotated(F.col("genus"))).select("genome", "genus")


@query("f18_read_sample", None)
def f18(v):
    """A seeded tenth of the reads by name: both mates are kept or dropped together."""
    from ..operators.reads import down_sampled

    return down_sampled(v.aln, 7, share=0.1, name="qname").select("aln_id", "qname")


@query("f18_base_budget", None)
def f18b(v):
    """Sequences sampled to a budget of 100,000 bases."""
    from ..operators.reads import down_sampled

    return down_sampled(v.seqs, 7, bases=100_000, name="contig").select("contig", F.length("seq").alias("len"))


@query("f20_near_genes", oracle("bkp genes", """
    SELECT bkp_id, gene_id FROM bkp JOIN genes ON contig = from_ref AND from_pos > g_start - 50 AND from_pos < g_end + 50"""))
def f20(v):
    from ..operators.joins import interval_pairs

    points = v.bkp.select("bkp_id", F.col("from_ref").alias("contig"), "from_pos")
    # rows due are the product of both sides: bins no wider than a gene, and lists on both sides
    return interval_pairs(points, v.genes.drop("attrs"), ["contig"], "from_pos", "g_start", "g_end", pad=50, bin_size=500, open_=True).select("bkp_id", "gene_id")


@query("f21_sample_exclusions", oracle("bkp", "SELECT bkp_id FROM bkp WHERE NOT regexp_matches(sample, '^S(1|2)')"))
def f21(v):
    return v.bkp.filter(~F.col("sample").rlike("^S(1|2)")).select("bkp_id")


_RC = "translate(reverse(seq), 'ACGTacgtRYMKrymkVBHDvbhd', 'TGCAtgcaYRKMyrkmBVDHbvdh')"


@query("x01_x02_sequences", oracle("seqs", f"SELECT contig, {_RC} AS rc, (length(seq) - length(replace(upper(seq), 'N', '')))::bigint AS n_count, substring(seq, greatest(n % 20, 1)::int + 1, greatest(n % 20 + 30 - greatest(n % 20, 1), 0)::int) AS win FROM seqs"))
def x01(v):
    s = F.col("seq")
    return v.seqs.select("contig", X.reverse_complement(s).alias("rc"), X.count_n(s).alias("n_count"), X.window_of(s, F.col("n") % 20, F.col("n") % 20 + 30).alias("win"))


@query("x03_lineage_levels", oracle("tax", "SELECT genome, split_part(lineage, ';', 2) AS l1, split_part(lineage, ';', 7) AS l6 FROM tax"))
def x03(v):
    return v.tax.select("genome", X.lineage_level(F.col("lineage"), 1).alias("l1"), X.lineage_level(F.col("lineage"), 6).alias("l6"))


@query("x04_tags", oracle("bkp", """
    SELECT bkp_id, least(from_genome, to_genome) || '&' || greatest(from_genome, to_genome) AS pair,
      concat_ws('&', from_ref, floor(from_pos / 100.0)::bigint::varchar, to_ref, floor(to_pos / 100.0)::bigint::varchar) AS tag,
      concat_ws('&', from_ref, round_even(from_pos / 200::double, 0)::bigint::varchar, to_ref, round_even(to_pos / 200::double, 0)::bigint::varchar) AS even_tag FROM bkp"""))
def x04(v):
    ends = [F.col(c) for c in ("from_ref", "from_pos", "to_ref", "to_pos")]
    return v.bkp.select("bkp_id", X.pair_tag(F.col("from_genome"), F.col("to_genome")).alias("pair"), X.hgt_tag(*ends, 100).alias("tag"), X.hgt_tag(*ends, 200, even=True).alias("even_tag"))


# the last class whose keywords a product holds, in the order plasmid, phage, transposon, other, enzymes, resistance
CLASSES = "CASE " + " ".join(f"WHEN regexp_matches(product, '{pattern}') THEN '{name}'" for name, pattern in reversed(X.PRODUCT_CLASSES)) + " ELSE 'unclassified' END"


@query("x05_x06_product_classes", oracle("genes", f"SELECT gene_id, product, {CLASSES} AS cls, regexp_matches(product, 'IS[0-9]') AS is_is FROM (SELECT gene_id, regexp_extract(attrs, 'product=([^;]*)', 1) AS product FROM genes) p"))
def x05(v):
    p = X.attributes(F.col("attrs"))["product"]
    return v.genes.select("gene_id", p.alias("product"), X.product_class(p).alias("cls"), X.is_insertion_sequence(p).alias("is_is"))


@query("x07_taxon_names", oracle("tax", "SELECT genome, genus || '_A' AS raw, genus AS refined FROM tax WHERE length(genus) > 3"))
def x07(v):
    raw = F.concat("genus", F.lit("_A"))
    return v.tax.filter(X.annotated(F.col("genus"))).select("genome", raw.alias("raw"), X.taxon_refined(raw).alias("refined"))


@query("x08_gene_attributes", oracle("genes", "SELECT gene_id, replace(ko, 'ko:', '') AS ko FROM (SELECT gene_id, unnest(string_split(regexp_extract(attrs, 'KEGG=([^;]*)', 1), ',')) AS ko FROM genes) x"))
def x08(v):
    return v.genes.select("gene_id", F.explode(X.ko_list(F.col("attrs"))).alias("ko"))


@query("x09_refined_ends", oracle("bkp", """
    SELECT bkp_id, r1 AS from_ref, p1 AS from_pos, s1 AS from_side, CASE WHEN d1 = '-' AND s1 = 'head' THEN '+' ELSE d1 END AS from_strand,
      r2 AS to_ref, p2 AS to_pos, s2 AS to_side, CASE WHEN d1 = '-' AND s1 = 'head' THEN CASE WHEN d2 = '+' THEN '-' ELSE '+' END ELSE d2 END AS to_strand
    FROM (SELECT bkp_id, CASE WHEN sw THEN to_ref ELSE from_ref END AS r1, CASE WHEN sw THEN to_pos ELSE from_pos END AS p1, CASE WHEN sw THEN to_side ELSE from_side END AS s1, CASE WHEN sw THEN to_strand ELSE from_strand END AS d1,
            CASE WHEN sw THEN from_ref ELSE to_ref END AS r2, CASE WHEN sw THEN from_pos ELSE to_pos END AS p2, CASE WHEN sw THEN from_side ELSE to_side END AS s2, CASE WHEN sw THEN from_strand ELSE to_strand END AS d2
          FROM (SELECT *, from_strand = '+' AND from_side = 'tail' AS sw FROM bkp) x) y"""))
def x09(v):
    return v.bkp.select("bkp_id", X.refined_ends().alias("e")).select("bkp_id", "e.*")


@query("x14_mechanisms", oracle("ev", """
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'TEI' WHEN event_id % 7 = 0 THEN 'VNTR' WHEN i > 10 THEN 'FoSTeS/MMBIR' WHEN i > 0 THEN 'NHEJ' WHEN h > 100 THEN 'NAHR' WHEN h >= 2 THEN 'alt-EJ' ELSE 'NHEJ' END AS mechanism
    FROM (SELECT event_id, event_id % 13 - 6 AS i, event_id % 103 AS h FROM ev) x"""))
def x14(v):
    e = F.col("event_id")
    return v.ev.select("event_id", X.mechanism(e % 11 == 0, e % 7 == 0, e % 13 - 6, e % 103).alias("mechanism"))


@query("x17_hit_classes", oracle("hits", "SELECT hit_id, CASE WHEN length / full_length::double > 0.9 THEN 'A' WHEN length > 100 THEN 'B' ELSE 'C' END AS cls FROM hits WHERE evalue < 1e-5"))
def x17(v):
    return v.hits.select("hit_id", X.hit_class(F.col("evalue"), F.col("length"), F.col("full_length")).alias("cls")).filter("cls is not null")


@query("x18_flanks", oracle("bkp contigs", "SELECT bkp_id, greatest(from_pos - 5000, 1)::bigint AS s, least(from_pos + 5000, len)::bigint AS e FROM bkp JOIN contigs ON contig = from_ref"))
def x18(v):
    joined = v.bkp.join(v.contigs, F.col("contig") == F.col("from_ref"))
    return joined.select("bkp_id", X.flank(F.col("from_pos"), F.col("len")).alias("w")).select("bkp_id", F.col("w.start").cast("long").alias("s"), F.col("w.end").cast("long").alias("e"))


@query("x16_indicator_means", oracle("ev", "SELECT receptor, count(*) FILTER (WHERE delete_end - delete_start >= 900)::bigint AS n_long, round(sum((delete_end - delete_start) * (insert_locus + 1)) / sum(insert_locus + 1)::double, 6) AS weighted FROM ev GROUP BY receptor"))
def x16(v):
    length = F.col("delete_end") - F.col("delete_start")
    w = F.col("insert_locus") + 1
    return v.ev.groupBy("receptor").agg(F.sum((length >= 900).cast("long")).alias("n_long"), F.round(F.sum(length * w) / F.sum(w).cast("double"), 6).alias("weighted"))


@query("x11_event_tags", oracle("ev", "SELECT event_id, concat_ws('&', receptor, round_even(insert_locus / 100::double, 0)::bigint::varchar, donor, round_even(delete_start / 100::double, 0)::bigint::varchar, round_even(delete_end / 100::double, 0)::bigint::varchar) AS tag FROM ev"))
def x11(v):
    return v.ev.select("event_id", X.event_tag(*[F.col(c) for c in ("receptor", "insert_locus", "donor", "delete_start", "delete_end")]).alias("tag"))
