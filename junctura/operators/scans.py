"""Ordered scans whose groups may be of any size: islands, unions and gaps of intervals, ranks and suffix minima.

A contig is dealt over bins of its positions: rows are put in order within a bin, and what a bin needs from before it (the
reach of earlier intervals, the number of clusters) is carried over the table of bins, which has one row a bin. Ranks
come from the distinct values of a group with their counts: these are range-partitioned on (group, value), and offsets
are carried over the table of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import stored

#: Bases in a bin.
BIN = 1_000_000


def _before(by: list[str], order: str, value: Column, how=F.max) -> Column:
    """An aggregate over the rows before, for tables of bins or partitions."""
    return how(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def islands(df: DataFrame, by: list[str], pos: str, gap: int, tie: list[str] = (), name: str = "cluster", bin_size: int = BIN) -> DataFrame:
    """Single-linkage clusters on a line: a new one begins where the step is over gap; numbered from 1 in each group."""
    by = list(by)
    rows = df.withColumn("__bin", F.floor(F.col(pos) / bin_size))
    w = Window.partitionBy(*by, "__bin").orderBy(pos, *tie)
    step = F.col(pos) - F.lag(pos).over(w)
    rows = rows.withColumn("__open", F.when(step > gap, 1).otherwise(0)).withColumn("__n", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bins = rows.groupBy(*by, "__bin").agg(F.min(pos).alias("__lo"), F.max(pos).alias("__hi"), F.sum("__open").alias("__c"))
    earlier = _before(by, "__bin", F.col("__hi"))
    bins = bins.withColumn("__first", F.when(earlier.isNull() | (F.col("__lo") - earlier > gap), 1).otherwise(0))
    bins = bins.select(*by, "__bin", (F.coalesce(_before(by, "__bin", F.col("__first") + F.col("__c"), F.sum), F.lit(0)) + F.col("__first")).alias("__offset"))
    return rows.join(bins, [*by, "__bin"]).withColumn(name, (F.col("__n") + F.col("__offset")).cast("long")).select(*df.columns, name)


def interval_union(df: DataFrame, by: list[str], start: str, end: str, gap: int = 0, bin_size: int = BIN) -> DataFrame:
    """Maximal intervals of the union of closed intervals; those that touch (or lie within gap) are joined.

    Intervals are united by the bins of their starts. A bin's first pieces that the reach of earlier bins holds belong to the
    last interval that began in one of them."""
    by = list(by)
    rows = df.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e")).withColumn("__bin", F.floor(F.col("__s") / bin_size))
    w = Window.partitionBy(*by, "__bin").orderBy("__s", "__e")
    reach = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__open", F.when(reach.isNull() | (F.col("__s") > reach + gap), F.col("__s")))
    marked = marked.withColumn("__n", F.last("__open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(*by, "__bin", "__n").agg(F.max("__e").alias("__e"))
    reached = pieces.groupBy(*by, "__bin").agg(F.max("__e").alias("__e"))
    reached = reached.select(*by, "__bin", _before(by, "__bin", F.col("__e")).alias("__reach"))
    begun = pieces.join(reached, [*by, "__bin"]).withColumn("__open", F.col("__reach").isNull() | (F.col("__n") > F.col("__reach") + gap))
    last = begun.groupBy(*by, "__bin").agg(F.max(F.when(F.col("__open"), F.col("__n"))).alias("__last"))
    last = last.select(*by, "__bin", _before(by, "__bin", F.col("__last")).alias("__of"))
    owned = begun.join(last, [*by, "__bin"]).withColumn(start, F.when(F.col("__open"), F.col("__n")).otherwise(F.col("__of")))
    return owned.groupBy(*by, start).agg(F.max("__e").alias(end)).select(*by, start, end)


def interval_gaps(union: DataFrame, by: list[str], start: str, end: str, least: int, bin_size: int = BIN) -> DataFrame:
    """The stretches between successive intervals that are longer than least."""
    by = list(by)
    rows = union.select(*by, start, end).withColumn("__bin", F.floor(F.col(start) / bin_size))
    w = Window.partitionBy(*by, "__bin").orderBy(start)
    rows = rows.withColumn("__p", F.lag(end).over(w))
    bins = rows.groupBy(*by, "__bin").agg(F.max(end).alias("__hi")).select(*by, "__bin", _before(by, "__bin", F.col("__hi")).alias("__before"))
    found = rows.join(bins, [*by, "__bin"]).select(*by, F.coalesce("__p", "__before").alias("gap_start"), F.col(start).alias("gap_end"))
    return found.filter(F.col("gap_end") - F.col("gap_start") > least)


def _same(left: str, right: str, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def value_ranks(each: DataFrame, by: list[str], value: str, n: str, suffix: Column | None = None) -> DataFrame:
    """each (one row a value of a group, nulls first, with the count n of its rows) with before, the number of rows with a
    lesser value, and total, that of the group; with suffix, an expression over these, also its least value from here up
    (lowest)."""
    by = list(by)
    placed = stored(each.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    key = by or []
    parts = placed.groupBy("__part", *key).agg(F.sum(n).alias("__c"))
    # one row a partition, or a partition and group
    over = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    prefix = over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *key, F.coalesce(F.sum("__c").over(prefix), F.lit(0)).alias("__offset"), F.sum("__c").over(over).alias("total"))
    local = Window.partitionBy("__part", *key)
    upto = placed.withColumn("__upto", F.sum(n).over(local.orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = upto.alias("l").join(parts.alias("r"), _same("l", "r", ["__part", *key])).select("l.*", (F.col("__offset") + F.col("__upto") - F.col(n)).alias("before"), "total")
    if suffix is None:
        return ranked.drop("__part", "__upto")
    above = local.orderBy(F.desc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("__own", suffix).withColumn("lowest", F.min("__own").over(above))
    later = ranked.groupBy("__part", *key).agg(F.min("__own").alias("__m"))
    follow = over.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    later = later.select("__part", *key, F.min("__m").over(follow).alias("__later"))
    out = ranked.alias("l").join(later.alias("r"), _same("l", "r", ["__part", *key])).select("l.*", "__later")
    return out.withColumn("lowest", F.least("lowest", "__later")).drop("__part", "__upto", "__own", "__later")


def rank_avg(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean, nulls first. The rows are written first: ranks are joined to them by value, and values
    that come of sums of doubles may differ in a second evaluation."""
    by, df = list(by), stored(df)
    each = value_ranks(df.groupBy(*by, value).agg(F.count("*").alias("__c")), by, value, "__c")
    rank = F.col("before") + 1 + (F.col("__c") - 1) / F.lit(2.0)
    ranks = each.select(*by, value, rank.alias("__rank"))
    return df.alias("l").join(ranks.alias("r"), _same("l", "r", [*by, value])).select("l.*", F.col("__rank").alias(name))
