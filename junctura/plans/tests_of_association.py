"""Statistical queries: exact tests, corrections, rank tests, correlations, slopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import stats as S
from .binding import oracle
from .catalog import query
from .cohort import _BOTH, _GROUPS, presence, with_taxa

_PRESENCE = """, q AS (SELECT tag, a, b, (n1 - a)::bigint AS c, (n0 - b)::bigint AS d FROM (SELECT tag, count(*) FILTER (WHERE crc)::bigint AS a, count(*) FILTER (WHERE NOT crc)::bigint AS b FROM d JOIN g USING (sample) GROUP BY tag) x,
    (SELECT count(*) FILTER (WHERE crc) AS n1, count(*) FILTER (WHERE NOT crc) AS n0 FROM g) y),
    z AS (SELECT tag, a, b, c, d, unnest(range(greatest(0, a + c - (c + d) - 0, (a + c) - (a + c + b + d) + (a + b), a + b - (b + d))::bigint, least(a + b, a + c)::bigint + 1)) AS k FROM q),
    l AS (SELECT tag, a, b, c, d, k, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS p
      FROM z WHERE k <= a + b AND k <= a + c AND d - a + k >= 0),
    f AS (SELECT tag, min(a)::bigint AS a, min(b)::bigint AS b, min(c)::bigint AS c, min(d)::bigint AS d, least(1.0, sum(CASE WHEN p <= p0 * (1 + 1e-7) THEN p ELSE 0 END)) AS pv FROM (SELECT *, max(CASE WHEN k = a THEN p END) OVER (PARTITION BY tag) AS p0 FROM l) x GROUP BY tag)"""


@query("t01_fisher", oracle("bkp phe", "SELECT tag, round(pv, 6)::double AS p_value, CASE WHEN b * c > 0 THEN round(a * d / (b * c)::double, 9) END AS odds_ratio FROM f", _GROUPS + _PRESENCE))
def t01(v):
    out = S.fisher_exact(presence(v), "a", "b", "c", "d")
    return out.select("tag", F.round("p_value", 6).alias("p_value"), F.round("odds_ratio", 9).alias("odds_ratio"))


@query("t02_bonferroni", oracle("bkp phe", "SELECT tag, round(least(1.0, pv * count(*) OVER ()), 5)::double AS p_adj FROM f", _GROUPS + _PRESENCE))
def t02(v):
    return S.bonferroni(S.fisher_exact(presence(v), "a", "b", "c", "d"), "p_value").select("tag", F.round("p_adj", 5).alias("p_adj"))


@query("t03_benjamini_hochberg", oracle("bkp phe", """
    SELECT tag, round(least(1.0, min(pv * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 5)::double AS q_value FROM (SELECT tag, pv, count(*) OVER () AS m, row_number() OVER (ORDER BY round(pv, 9), tag) AS r FROM f) x""", _GROUPS + _PRESENCE))
def t03(v):
    rows = S.fisher_exact(presence(v), "a", "b", "c", "d").withColumn("p", F.round("p_value", 9))
    return S.benjamini_hochberg(rows, "p").select("tag", F.round("q_value", 5).alias("q_value"))


_MWU = """i AS (SELECT sample, round(avg((p1 = p2)::int), 9) AS v FROM w GROUP BY sample), j AS (SELECT i.sample, v, full_disease = 'CRC' AS first FROM i JOIN phe USING (sample) WHERE full_disease IN ('CRC', 'healthy')),
    k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::double AS r, count(*) OVER (PARTITION BY v) AS t FROM j),
    s AS (SELECT count(*) FILTER (WHERE first)::bigint AS n1, count(*) FILTER (WHERE NOT first)::bigint AS n2, sum(CASE WHEN first THEN r ELSE 0 END)::double AS r1, sum(t * t - 1)::double AS tt FROM k),
    o AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0::double AS u, n1 * n2 / 2.0::double AS mid, (n1 + n2)::double AS n, tt FROM s)"""


def _intra(v):
    per = with_taxa(v).groupBy("sample").agg(F.round(F.avg((F.col("p1") == F.col("p2")).cast("int")), 9).alias("v"))
    return per.join(v.phe.filter("full_disease IN ('CRC', 'healthy')"), "sample").select("sample", "v", "full_disease", F.lit(1).alias("one"))


@query("t04_mann_whitney", oracle("bkp tax phe", "SELECT n1, n2, u, round((u - mid - sign(u - mid) * least(abs(u - mid), 0.5)) / sqrt(n1 * n2 / 12.0::double * (n + 1 - tt / (n * (n - 1)))), 6)::double AS z FROM o", f"{_BOTH}, {_MWU}"))
def t04(v):
    return S.mann_whitney(_intra(v), ["one"], "full_disease", "v", F.col("full_disease") == "CRC").select("n1", "n2", "u", F.round("z", 6).alias("z"))


@query("t05_rank_sum", oracle("bkp tax phe", "SELECT n1, n2, u, round((u - mid) / sqrt(n1 * n2 / 12.0::double * (n + 1)), 6)::double AS z FROM o", f"{_BOTH}, {_MWU}"))
def t05(v):
    return S.mann_whitney(_intra(v), ["one"], "full_disease", "v", F.col("full_disease") == "CRC", correct=False, ties=False).select("n1", "n2", "u", F.round("z", 6).alias("z"))


@query("t06_spearman", oracle("bkp abund", """
    SELECT species, n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS rho FROM (
      SELECT species, count(*) OVER (PARTITION BY species) AS n, rank() OVER (PARTITION BY species ORDER BY abundance) + (count(*) OVER (PARTITION BY species, abundance) - 1) / 2.0::double AS rx,
        rank() OVER (PARTITION BY species ORDER BY k) + (count(*) OVER (PARTITION BY species, k) - 1) / 2.0::double AS ry FROM abund JOIN (SELECT sample, count(*) AS k FROM bkp GROUP BY sample) b USING (sample)) x
    GROUP BY species, n HAVING stddev_pop(rx) > 0 AND stddev_pop(ry) > 0"""))
def t06(v):
    rows = v.abund.join(v.bkp.groupBy("sample").agg(F.count("*").alias("k")), "sample")
    return S.spearman(rows, ["species"], "abundance", "k").select("species", "n", F.round("rho", 6).alias("rho"))


@query("t07_pearson_edges", oracle("abund", """
    SELECT a, b, n, round(r, 6) AS r FROM (SELECT x.species AS a, y.species AS b, count(*) AS n, covar_pop(x.abundance, y.abundance) / (stddev_pop(x.abundance) * stddev_pop(y.abundance)) AS r
      FROM abund x JOIN abund y ON x.sample = y.sample AND x.species < y.species GROUP BY 1, 2 HAVING stddev_pop(x.abundance) > 0 AND stddev_pop(y.abundance) > 0) z WHERE r > 0.4"""))
def t07(v):
    return S.pearson_edges(v.abund, "species", "sample", "abundance", 0.4).select("a", "b", "n", F.round("r", 6).alias("r"))


@query("t08_slope_convergence", oracle("ts", """
    SELECT individual, round(regr_slope(n, time_point), 6) AS slope, abs(regr_slope(n, time_point)) <= 0.2 AS converged FROM (
      SELECT *, row_number() OVER (PARTITION BY individual ORDER BY time_point DESC) AS r FROM (SELECT individual, time_point, count(*) AS n FROM ts GROUP BY ALL) a) b WHERE r <= 3 GROUP BY individual HAVING count(*) = 3"""))
def t08(v):
    n = v.ts.groupBy("individual", "time_point").agg(F.count("*").alias("n"))
    return S.converged(n, ["individual"], "time_point", "n").select("individual", F.round("slope", 6).alias("slope"), "converged")


PROPERTIES = ("density", "transitivity", "assortativity", "fiedler")


def network_properties(edges, by: str = "sample"):
    """by, property, value of each group's graph (by, src, dst), rounded; undefined ones are left out."""
    from ..operators import graph as G
    from ..operators.checkpoints import stored

    both = stored(G.graph_metrics(edges, [by]).join(G.algebraic_connectivity(edges, by), by))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.round(F.col(p).cast("double"), 3).alias("value")) for p in PROPERTIES])).alias("x")
    return both.select(by, each).select(by, "x.*").filter("value is not null")


def compared_groups(values):
    """property, g1, g2, p, q of values (grp, property, value): rank-sum tests between all pairs g1 >= g2 of groups, a group
    with itself among them, corrected over all pairs of a property."""
    groups = values.select("grp").distinct()
    pairs = groups.select(F.col("grp").alias("g1")).join(groups.select(F.col("grp").alias("g2")), F.col("g1") >= F.col("g2"))  # names of groups
    side = lambda c, first: values.join(pairs, F.col("grp") == F.col(c)).select("property", "g1", "g2", "value", F.lit(first).alias("first"))
    z = S.mann_whitney(side("g1", 1).unionByName(side("g2", 0)), ["property", "g1", "g2"], "first", "value", F.col("first") == 1, correct=False, ties=False)
    tested = z.select("property", "g1", "g2", F.round(S.normal_two_sided(F.coalesce("z", F.lit(0.0))), 9).alias("p"))
    return S.benjamini_hochberg(tested, "p", ["property"]).select("property", "g1", "g2", "p", F.round("q_value", 9).alias("q"))


@query("g04_group_comparison", None)
def g04(v):
    """Properties of samples' genus networks of ten strongest edges, compared between disease groups."""
    from ..operators.checkpoints import stored
    from ..operators.order import top_k

    w = with_taxa(v).filter("length(g1) > 3 AND length(g2) > 3")
    counted = w.groupBy("sample", F.least("g1", "g2").alias("src"), F.greatest("g1", "g2").alias("dst")).agg(F.count("*").alias("n"))
    edges = stored(top_k(counted, ["sample"], [F.desc("n"), F.asc("src"), F.asc("dst")], 10, full_only=True))
    single = v.phe.filter("full_disease NOT LIKE '%;%' AND disease <> '' AND (disease <> 'control' OR full_disease = 'healthy')")
    return compared_groups(network_properties(edges).join(single.select("sample", F.col("disease").alias("grp")), "sample"))


@query("m04_markers", oracle("bkp phe", "SELECT tag FROM (SELECT tag, row_number() OVER (ORDER BY round(pv, 9), tag) AS r FROM f WHERE least(1.0, pv * (SELECT count(*) FROM f)) <= 1) x WHERE r <= 25", _GROUPS + _PRESENCE))
def m04(v):
    """The 25 tags that differ most between the groups."""
    rows = S.bonferroni(S.fisher_exact(presence(v), "a", "b", "c", "d"), "p_value").filter("p_adj <= 1")
    return rows.select("tag", F.round("p_value", 9).alias("p")).orderBy("p", "tag").limit(25).select("tag")


@query("f17_context_similarity", None)
def f17(v):
    """The windows of neighbouring sequences compared either way round."""
    from ..operators.alignment import context_similarity
    from .kernels import window_pairs

    pairs = window_pairs(v, 60)
    return pairs.select("contig", "at", F.round(context_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("x03_genome_names", oracle("contigs", "SELECT contig, regexp_replace(contig, '_[^_]*$', '') AS genome FROM contigs"))
def x03(v):
    return v.contigs.select("contig", X.genome(F.col("contig")).alias("genome"))
