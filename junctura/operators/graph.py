"""Graphs as edge tables: components, matching, metrics, PageRank and marker smoothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import discard, stored
from .matching import max_weight_matching
from .order import sorted_groups


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the least node reachable). In each round every node goes over to the one of least hash among its
    neighbours and itself, and the edges between the nodes that are left go on: half of a chain's nodes or fewer. On the way
    back each node takes what the one it went over to has become."""
    e = stored(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    levels: list[DataFrame] = []
    while not levels or not e.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("u"))  # noqa: E731, B023
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), ranked("b").alias("to")), F.struct(F.col("b").alias("node"), ranked("a").alias("to")))).alias("x")).select("x.*")
        went = stored(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), ranked("node"))["u"].alias("label")))
        levels.append(went)
        one, two = went.select(F.col("node").alias("a"), F.col("label").alias("la")), went.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        before, e = e, stored(e.join(one, "a").join(two, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        discard(before)
    discard(e)
    out = levels[-1]
    for went in reversed(levels[:-1]):
        met = went.join(out.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        before, out = out, stored(met.select("node", F.coalesce("further", "label").alias("label")))
        discard(before, went)
    least = out.groupBy("label").agg(F.min("node").alias("component"))
    return out.join(least, "label").select("node", "component")


def matching_per_component(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of a maximum-weight matching of every component: src, dst, weight, component.

    Edges that share no end with another one are taken as they are. The components of the rest are dealt out whole, many
    to a batch; a component, which in this use is a tangle of breakpoints of one sample, is solved by one task."""
    e = stored(edges.filter("src <> dst and weight > 0").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    shared = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    one = e.join(shared.withColumnRenamed("node", "src"), "src", "left_anti").join(shared.withColumnRenamed("node", "dst"), "dst", "left_anti")
    rest = stored(e.join(one.select("src", "dst"), ["src", "dst"], "left_anti"))
    comp = connected_components(rest).select(F.col("node").alias("src"), "component")

    def start():
        rows: list = []

        def step(r):
            rows.append(r)
            return ()

        def end():
            nodes = sorted({r.src for r in rows} | {r.dst for r in rows})
            at = {v: i for i, v in enumerate(nodes)}
            chosen = max_weight_matching(len(nodes), [(at[r.src], at[r.dst], r.weight) for r in rows])
            return [(r.src, r.dst, r.weight, r.component) for r in rows if (at[r.src], at[r.dst]) in chosen]

        return step, end

    tangles = sorted_groups(rest.join(comp, "src").select("src", "dst", "weight", "component"), "component", ["src", "dst"], start, "src long, dst long, weight double, component long")
    return one.select("src", "dst", "weight", F.col("src").alias("component")).unionByName(tangles)


def graph_metrics(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, nodes, n_edges, density, transitivity, assortativity (null where undefined), all from joins.

    Edges (by, src, dst) are taken as simple and undirected; loops are left out."""
    e = edges.filter("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = e.select(*by, F.explode(F.array("a", "b")).alias("v"))
    degree = ends.groupBy(*by, "v").agg(F.count("*").alias("d"))
    base = degree.groupBy(*by).agg(F.count("*").alias("nodes"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("__triples"))
    count = e.groupBy(*by).agg(F.count("*").alias("n_edges"))
    # a triangle is found once, from its least node; wedges leave the node of the least id only
    e1, e2, e3 = e.select(*by, "a", F.col("b").alias("x")), e.select(*by, "a", F.col("b").alias("y")), e.select(*by, F.col("a").alias("x"), F.col("b").alias("y"))
    tri = e1.join(e2, [*by, "a"]).filter("x < y").join(e3, [*by, "x", "y"]).groupBy(*by).agg(F.count("*").alias("__tri"))
    da, db = degree.select(*by, F.col("v").alias("a"), F.col("d").alias("da")), degree.select(*by, F.col("v").alias("b"), F.col("d").alias("db"))
    both = e.join(da, [*by, "a"]).join(db, [*by, "b"])
    sym = both.select(*by, F.explode(F.array(F.struct(F.col("da").alias("x"), F.col("db").alias("y")), F.struct(F.col("db").alias("x"), F.col("da").alias("y")))).alias("p")).select(*by, "p.x", "p.y")
    mix = sym.groupBy(*by).agg(F.covar_pop("x", "y").alias("__c"), F.stddev_pop("x").alias("__s"))
    out = base.join(count, by).join(tri, by, "left").join(mix, by, "left")
    n = F.col("nodes").cast("double")
    return out.select(
        *by, "nodes", "n_edges",
        F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).alias("density"),
        F.when(F.col("__triples") > 0, 3 * F.coalesce("__tri", F.lit(0)) / F.col("__triples")).otherwise(0.0).alias("transitivity"),
        F.when(F.col("__s") > 1e-9, F.col("__c") / (F.col("__s") * F.col("__s"))).alias("assortativity"),
    )


def algebraic_connectivity(edges: DataFrame, by: str) -> DataFrame:
    """by, fiedler: the second least eigenvalue of the Laplacian of each group's (small) graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        nodes = sorted(set(pdf.src) | set(pdf.dst))
        at = {v: i for i, v in enumerate(nodes)}
        lap = np.zeros((len(nodes), len(nodes)))
        for a, b in {(min(x, y), max(x, y)) for x, y in zip(pdf.src, pdf.dst, strict=True) if x != y}:
            i, j = at[a], at[b]
            lap[i, j] = lap[j, i] = -1
            lap[i, i] += 1
            lap[j, j] += 1
        values = np.linalg.eigvalsh(lap)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "fiedler": [float(values[1]) if len(values) > 1 else 0.0]})

    return edges.select(by, "src", "dst").groupBy(by).applyInPandas(run, f"{by} string, fiedler double")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank of an undirected weighted graph (src, dst, weight) after a fixed number of rounds."""
    sym = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    sym = sym.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = sym.groupBy("src").agg(F.sum("w").alias("total"))
    links = stored(sym.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = stored(out.select(F.col("src").alias("node")))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        ranks = nodes.join(sent, nodes.node == sent.dst, "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            ranks = stored(ranks)
    return ranks


def smoothed(values: DataFrame, edges: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Marker values (sample, marker, value) smoothed over marker edges (src, dst, weight): beta of the own value plus
    alpha of the neighbours' mean, weighted by the row-normalised edges."""
    sym = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = sym.groupBy("src").agg(F.sum("weight").alias("t"))
    norm = sym.join(total, "src").select("src", "dst", (F.col("weight") / F.col("t")).alias("w"))
    passed = norm.join(values.select("sample", F.col("marker").alias("dst"), "value"), "dst").groupBy("sample", F.col("src").alias("marker")).agg(F.sum(F.col("w") * F.col("value")).alias("near"))
    return values.join(passed, ["sample", "marker"], "left").select("sample", "marker", (beta * F.col("value") + alpha * F.coalesce("near", F.lit(0.0))).alias("value"))
