"""Order-dependent operators: top-k, runs of equal rows, samples and the merge about a running mean.

The merge depends on all members of a cluster in their order, so it runs over groups that cannot interact: a contig is first
cut, on Spark, into runs of occupied position bins. Rows stream through a group; what is held is the open cluster.
Where positions leave no gap at all a run is the whole contig. The other greedy merges are in greedy.py.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, full_only: bool = False) -> DataFrame:
    """The first k rows of each group; with full_only, groups with fewer rows are left out."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(*order)))
    if full_only:
        ranked = ranked.withColumn("__n", F.count("*").over(w)).filter(F.col("__n") >= k).drop("__n")
    return ranked.filter(F.col("__r") <= k).drop("__r")


def consecutive_distinct(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ in the columns from the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    now, last = F.struct(*columns), F.lag(F.struct(*columns)).over(w)
    return df.withColumn("__same", F.coalesce(now == last, F.lit(False))).filter(~F.col("__same")).drop("__same")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


# --- greedy merges ------------------------------------------------------------------------------------------------


def bin_runs(df: DataFrame, by: list[str], pos: str, width: int, name: str) -> DataFrame:
    """df with name, the first bin of the run of occupied bins of width that holds a row's position: rows of different runs
    lie more than width apart. Only occupied bins are sorted, of which a contig has so many as its length allows."""
    binned = df.withColumn("__bin", F.floor(F.col(pos) / width))
    w = Window.partitionBy(*by).orderBy("__bin")
    opens = F.when(F.coalesce(F.col("__bin") - F.lag("__bin").over(w), F.lit(2)) > 1, F.col("__bin"))
    runs = binned.select(*by, "__bin").distinct().withColumn("__open", opens)
    runs = runs.withColumn(name, F.last("__open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")
    return binned.join(runs, [*by, "__bin"]).drop("__bin")


def sorted_groups(df: DataFrame, key: str, order: list[str], start, schema: str) -> DataFrame:
    """Rows (named tuples) of each group in order through a pair of functions from start(): step(row) and end(), which
    return output rows. Groups lie whole and sorted in partitions, and batches of many small groups pass to Python
    together, unlike one call a group."""

    def stream(frames):
        last = step = end = None
        for pdf in frames:
            out: list = []
            for r in pdf.itertuples(index=False):
                if step is None or getattr(r, key) != last:
                    if step is not None:
                        out += end()
                    step, end = start()
                    last = getattr(r, key)
                out += step(r)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if step is not None and (out := list(end())):
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = [c.split()[0] for c in schema.split(", ")]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(stream, schema)


def running_mean_merge(df: DataFrame, by: str, pos: str, gap: int = 5000) -> DataFrame:
    """Positions of a contig merged along the line: a position within gap of the anchor joins it, and the anchor moves
    to int(mean) + 1 of its members. Columns: by, pos, anchor (the cluster's last one)."""
    # an anchor lies at most one base behind its last member
    runs = bin_runs(df.select(by, pos), [by], pos, gap + 1, "__run").withColumn("group_key", F.concat_ws("|", by, F.col("__run").cast("string")))

    def start():
        members: list = []
        state = {"sum": 0, "anchor": None}

        def close():
            return [(c, p, state["anchor"]) for c, p in members]

        def step(r):
            c, p = getattr(r, by), getattr(r, pos)
            out = ()
            if state["anchor"] is not None and p - state["anchor"] < gap:
                members.append((c, p))
                state["sum"] += p
                state["anchor"] = state["sum"] // len(members) + 1
            else:
                out = close()
                members[:] = [(c, p)]
                state["sum"] = state["anchor"] = p
            return out

        return step, close

    return sorted_groups(runs.select("group_key", by, pos), "group_key", [pos], start, f"{by} string, {pos} long, anchor long")
