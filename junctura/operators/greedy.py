"""Greedy choices in row order as independent sets: a row is chosen unless an earlier chosen row lies near.

Run one after another, the choices give the lexicographically first maximal independent set of the graph of near rows. It is
found in rounds: of the undecided rows those that no earlier undecided row lies near are chosen, and what lies near a
chosen row falls away. That gives the sequential result whatever the order, and each round is joins over cells of the
plane; the number of rounds is the longest chain of rows that wait for one another, which is short unless the row order
runs along the positions of a contig that has no gaps.

Cells are as wide as the distance, so two rows of a cell are near and at most one of them is chosen; only the neighbouring
cells have to be met. Rows at one place are one point, which stands for the first of them: a cell has a bounded number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import discard, stored


def _cell(x: str, y: str, near: int) -> list[Column]:
    return [F.floor(F.col(x) / near).cast("long").alias("__cx"), F.floor(F.col(y) / near).cast("long").alias("__cy")]


def _about(rows: DataFrame) -> DataFrame:
    """rows repeated into their cell and the eight about it."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    moved = rows.withColumn("__m", F.explode(moves))
    return moved.withColumn("__cx", F.col("__cx") + F.col("__m.i")).withColumn("__cy", F.col("__cy") + F.col("__m.j")).drop("__m")


def _near(near: int, a: str = "x", b: str = "ox", c: str = "y", d: str = "oy") -> Column:
    return (F.abs(F.col(a) - F.col(b)) < near) & (F.abs(F.col(c) - F.col(d)) < near)


def first_rows(rows: DataFrame, key: list[str], near: int, rounds: list[int] | None = None) -> DataFrame:
    """key, row_id, x and y of the rows (key, row_id, x, y) that are chosen: those without an earlier chosen row of their key
    within near at both positions. Keys are not null. The number of undecided points of each round is added to rounds."""
    cell = [*key, "__cx", "__cy"]
    points = rows.groupBy(*key, "x", "y").agg(F.min("row_id").alias("row_id"))
    left, chosen = stored(points.select(*key, "row_id", "x", "y", *_cell("x", "y", near))), None
    parts: list[DataFrame] = []
    while count := left.count():
        if rounds is not None:
            rounds.append(count)
        first = left.groupBy(*cell).agg(F.min(F.struct("row_id", "x", "y")).alias("f")).select(*cell, F.col("f.row_id").alias("o"), F.col("f.x").alias("ox"), F.col("f.y").alias("oy"))
        # rows repeated into nine cells are never broadcast: Spark takes them for as small as the table that they come from
        met = left.join(_about(first).hint("merge"), cell).filter(_near(near) & (F.col("row_id") < F.col("o")))
        free = first.join(met.select("o").distinct().hint("merge"), "o", "left_anti")
        made = stored(free.select(*cell, "o", "ox", "oy"))
        parts.append(made)
        close = _about(made).select(*[F.col(c).alias(f"o_{c}") for c in cell], "ox", "oy")
        same = _near(near)
        for c in cell:
            same = same & (F.col(c) == F.col(f"o_{c}"))
        before, left = left, stored(left.join(close.hint("merge"), same, "left_anti"))
        discard(before)
    discard(left)
    for p in parts:
        chosen = p if chosen is None else chosen.unionByName(p)
    if chosen is None:
        return points.select(*key, "row_id", "x", "y").limit(0)
    return chosen.select(*key, F.col("o").alias("row_id"), F.col("ox").alias("x"), F.col("oy").alias("y"))


def near_chosen(rows: DataFrame, chosen: DataFrame, key: list[str], near: int) -> DataFrame:
    """rows (key, row_id, x, y and others) with each chosen row near them, as o, ox and oy."""
    cell = [*key, "__cx", "__cy"]
    spread = _about(chosen.select(*key, F.col("row_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), *_cell("x", "y", near)))
    return rows.select("*", *_cell("x", "y", near)).join(spread.hint("merge"), cell).filter(_near(near)).drop("__cx", "__cy")


def _pair(ref1: str, ref2: str) -> Column:
    return F.concat_ws("&", F.least(ref1, ref2), F.greatest(ref1, ref2)).alias("pair")


def drop_near_repeats(df: DataFrame, near: int = 50, rounds: list[int] | None = None) -> DataFrame:
    """Rows kept in row_id order unless an earlier kept row of the contig pair lies within near bases at both ends, in
    either orientation. Columns: row_id, from_ref, from_pos, to_ref, to_pos."""
    # the position on the lesser contig counts as the first, on one contig with itself the lesser position
    turned = (F.col("from_ref") > F.col("to_ref")) | ((F.col("from_ref") == F.col("to_ref")) & (F.col("from_pos") > F.col("to_pos")))
    x, y = F.when(turned, F.col("to_pos")).otherwise(F.col("from_pos")), F.when(turned, F.col("from_pos")).otherwise(F.col("to_pos"))
    kept = first_rows(df.select(_pair("from_ref", "to_ref"), "row_id", x.alias("x"), y.alias("y")), ["pair"], near, rounds)
    return df.select("row_id", "from_ref", "from_pos", "to_ref", "to_pos").join(kept.select("row_id"), "row_id", "left_semi")


def merge_raw_clusters(df: DataFrame, near: int = 50) -> DataFrame:
    """Raw clusters (row_id, ref1, pos1, ref2, pos2, reverse, support) of each unordered contig pair merged in row order:
    a row joins every cluster of its direction whose first positions lie within near on both sides, in the orientation
    of the pair's first row; else it opens one. Columns: ref1, ref2, reverse, p1 and p2 (distinct, sorted), support."""
    rows = df.select("row_id", "ref1", "pos1", "ref2", "pos2", "reverse", "support", _pair("ref1", "ref2"))
    first = rows.groupBy("pair").agg(F.min_by(F.struct("ref1", "ref2"), "row_id").alias("f")).select("pair", F.col("f.ref1").alias("first1"), F.col("f.ref2").alias("first2"))
    own = F.col("ref1") == F.col("first1")
    placed = rows.join(first, "pair").select(
        "pair", "reverse", "row_id", "first1", "first2", "support", F.when(own, F.col("pos1")).otherwise(F.col("pos2")).alias("x"), F.when(own, F.col("pos2")).otherwise(F.col("pos1")).alias("y")
    )
    key = ["pair", "reverse"]
    # a row belongs to the clusters that were there when it came
    joined = near_chosen(placed, first_rows(placed, key, near), key, near).filter("o <= row_id")
    merged = joined.groupBy("first1", "first2", "reverse", "o").agg(F.array_sort(F.collect_set("x")).alias("p1"), F.array_sort(F.collect_set("y")).alias("p2"), F.sum("support").alias("support"))
    return merged.select(F.col("first1").alias("ref1"), F.col("first2").alias("ref2"), "reverse", "p1", "p2", "support")


def merge_segments(df: DataFrame, by: list[str], near: int = 50) -> DataFrame:
    """Donor segments (row_id, start, end, recipient) of a group merged greedily: a segment within near bases at both
    ends of a cluster's first one joins it, the first one that came of several. Columns: by, start, end (the first one's),
    n_segments, n_recipients."""
    rows = df.select(*by, "row_id", F.col("start").alias("x"), F.col("end").alias("y"), "recipient")
    met = near_chosen(rows, first_rows(rows, by, near), by, near)
    own = met.groupBy(*by, "row_id", "recipient").agg(F.min(F.struct("o", "ox", "oy")).alias("c"))
    merged = own.groupBy(*by, "c").agg(F.count("*").alias("n_segments"), F.count_distinct("recipient").alias("n_recipients"))
    return merged.select(*by, F.col("c.ox").alias("start"), F.col("c.oy").alias("end"), "n_segments", "n_recipients")
