"""Band, interval and as-of joins as equi-joins on bins with the exact test behind them, and other join shapes.

Bins bound what one key can gather: a contig with very many rows is dealt out over its bins, so no task holds a whole
contig and no cross product is formed. All of them are plain DataFrame plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, tol: int, how: str = "inner", strict: bool = True) -> DataFrame:
    """Rows with equal keys and |left_pos - right_pos| < tol (<= if not strict).

    Bins of tol on both sides; the right side is repeated into the two neighbouring bins. Column names besides the keys
    must differ."""
    size = tol + (0 if strict else 1)
    gap = F.abs(F.col(left_pos) - F.col(right_pos))
    near = right.withColumn("__bin", F.explode(F.array(*[_bin(F.col(right_pos), size) + k for k in (-1, 0, 1)])))
    test = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], F.col("l.__bin") == F.col("r.__bin")) & (gap < tol if strict else gap <= tol)
    joined = left.withColumn("__bin", _bin(F.col(left_pos), size)).alias("l").join(near.alias("r"), test, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bin")
    return joined.select("l.*", *[f"r.{c}" for c in right.columns if c not in keys]).drop("__bin")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, pad: int = 0, bin_size: int = 2000, how: str = "inner", open_: bool = False) -> DataFrame:
    """Points and the intervals that hold them, start - pad <= pos <= end + pad (or < with open_).

    Intervals are repeated into each bin they touch."""
    lo, hi = F.col(start) - pad, F.col(end) + pad
    spread = intervals.withColumn("__bin", F.explode(F.sequence(_bin(lo, bin_size), _bin(F.greatest(hi, lo), bin_size))))
    inside = (F.col(pos) > lo) & (F.col(pos) < hi) if open_ else F.col(pos).between(lo, hi)
    test = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], F.col("l.__bin") == F.col("r.__bin")) & inside
    joined = points.withColumn("__bin", _bin(F.col(pos), bin_size)).alias("l").join(spread.alias("r"), test, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bin")
    return joined.select("l.*", *[f"r.{c}" for c in intervals.columns if c not in keys]).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], least: Column, bin_size: int = 2000) -> DataFrame:
    """Pairs of intervals whose overlap is at least `least` bases; each pair is found in the first bin both touch."""
    spread = lambda df, s, e: df.withColumn("__bin", F.explode(F.sequence(_bin(F.col(s), bin_size), _bin(F.col(e), bin_size))))
    shared = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    first = _bin(F.greatest(F.col(a[0]), F.col(b[0])), bin_size)
    joined = spread(left, *a).join(spread(right, *b), [*keys, "__bin"])
    return joined.filter((F.col("__bin") == first) & (shared >= least)).withColumn("overlap", shared).drop("__bin")


def mostly_covered(segments: DataFrame, intervals: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bin_size: int = 500) -> DataFrame:
    """Pairs of segments and intervals, and the overlap, where a segment covers half of an interval or more; starts lie below ends.

    Such a segment holds the interval's middle, so an interval stands in one bin and meets few segments besides those."""
    middle = intervals.withColumn("__middle", F.floor((F.col(b[0]) + F.col(b[1])) / 2))
    shared = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    met = interval_join(middle, segments.hint("merge"), keys, "__middle", *a, bin_size=bin_size)
    return met.filter(2 * shared >= F.col(b[1]) - F.col(b[0])).withColumn("overlap", shared).drop("__middle")


#: Members of a list, about, if all rows share one key.
LONGEST = 1 << 21


def _listed(df: DataFrame, by: list[str], columns: list[str], name: str, rows: int) -> DataFrame:
    """by and name, lists of the columns of rows with the same by, nulls too. The table has so many rows; they are dealt over as
    many lists of a key as keep each bounded."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rows // LONGEST + 1))
    one = df.select(*by, F.struct(*columns).alias(name), part.alias("__part"))
    return one.groupBy(*by, "__part").agg(F.collect_list(name).alias(name)).drop("__part")


#: Members of left lists, on average, in a task that makes rows of lists: columns of ids up to 131,072 are written as numbers of a dictionary.
MEMBERS = 32_768


def _paired(left: DataFrame, right: DataFrame, on: list[str], members: int, test, made) -> DataFrame:
    """The columns of the lists __l of left rows, which hold so many members, and those that made(x) gives of the structs x in
    the lists __r of right rows with the same on for which test(x) holds. A left row's list is not tested again for each of its
    members: the right ones that it meets are a list too, and rows are made of the two lists where they are returned."""
    parts = max(members // MEMBERS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # named __l, as Spark would test the size of __r on the right side alone, where the left row in the lambda is not known
    own = F.when(F.size("__l") > 0, F.transform(F.filter("__r", test), made))
    met = left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on).withColumn("__r", own)
    return met.select("__r", F.explode("__l").alias("__x")).select(F.col("__x.*"), F.explode("__r").alias("__y")).select("*", "__y.*").drop("__y")


def interval_pairs(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, pad: int = 0, bin_size: int = 500, open_: bool = False) -> DataFrame:
    """interval_join() without keys, positions and ends, for many points at one place: distinct places meet the intervals of a
    bin, and rows are made of the lists of a place's points and its intervals."""
    own = [c for c in points.columns if c not in (*keys, pos)]
    of = [c for c in intervals.columns if c not in (*keys, start, end)]
    at = points.filter(F.col(pos).isNotNull()).withColumn("__bin", _bin(F.col(pos), bin_size))
    lo, hi = F.col(start) - pad, F.col(end) + pad
    spread = intervals.withColumns({"__lo": lo, "__hi": hi}).withColumn("__bin", F.explode(F.sequence(_bin(lo, bin_size), _bin(F.greatest(hi, lo), bin_size))))
    here = F.col(pos)
    test = lambda x: (here > x["__lo"]) & (here < x["__hi"]) if open_ else (here >= x["__lo"]) & (here <= x["__hi"])
    lists = _listed(spread, [*keys, "__bin"], ["__lo", "__hi", *of], "__r", intervals.count())
    n = points.count()
    return _paired(_listed(at, [*keys, "__bin", pos], own, "__l", n), lists, [*keys, "__bin"], n, test, lambda x: F.struct(*[x[c].alias(c) for c in of]))


def covered_pairs(segments: DataFrame, intervals: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bin_size: int = 500) -> DataFrame:
    """mostly_covered() without keys and ends, for many segments between the same ends: distinct segments meet the intervals
    whose middle lies in one of their bins, and rows are made of lists, as in interval_pairs()."""
    own = [c for c in segments.columns if c not in (*keys, *a)]
    of = [c for c in intervals.columns if c not in (*keys, *b)]
    middle = F.floor((F.col(b[0]) + F.col(b[1])) / 2)
    lists = _listed(intervals.withColumn("__middle", middle).withColumn("__bin", _bin(middle, bin_size)), [*keys, "__bin"], ["__middle", *b, *of], "__r", intervals.count())
    first, last = F.col(a[0]), F.col(a[1])
    some, n = segments.filter(first <= last), segments.count()
    spread = _listed(some, [*keys, *a], own, "__l", n).withColumn("__bin", F.explode(F.sequence(_bin(first, bin_size), _bin(last, bin_size))))
    shared = lambda x: F.least(last, x[b[1]]) - F.greatest(first, x[b[0]])
    test = lambda x: (x["__middle"] >= first) & (x["__middle"] <= last) & (2 * shared(x) >= x[b[1]] - x[b[0]])
    return _paired(spread, lists, [*keys, "__bin"], n, test, lambda x: F.struct(*[x[c].alias(c) for c in of], shared(x).alias("overlap")))


def asof_join(points: DataFrame, segments: DataFrame, keys: list[str], pos: str, start: str, slack: int = 0, bin_size: int = 1_000_000) -> DataFrame:
    """Each point with the last segment with start - slack <= pos (nulls if there is none; of equal starts the greatest row).

    A union sorted by position carries the last segment forward; no pairs are formed. Keys are dealt out over bins of
    bin_size; what a bin needs from before it is the last segment of an earlier one, carried over the bins alone."""
    from pyspark.sql import Window

    from .scans import _same

    seg_cols = [c for c in segments.columns if c not in keys]
    point_cols = [c for c in points.columns if c not in keys]
    s = segments.select(*keys, (F.col(start) - slack).cast("long").alias("__at"), F.struct(*seg_cols).alias("__s"))
    p = points.select(*keys, F.col(pos).cast("long").alias("__at"), F.struct(*point_cols).alias("__p"))
    no_point, no_segment = F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s")
    both = s.select(*keys, "__at", F.lit(0).alias("__kind"), no_point, "__s").unionByName(p.select(*keys, "__at", F.lit(1).alias("__kind"), "__p", no_segment))
    both = both.withColumn("__bin", _bin(F.col("__at"), bin_size))
    w = Window.partitionBy(*keys, "__bin").orderBy(F.asc_nulls_first("__at"), "__kind", "__s").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__s", F.last("__s", ignorenulls=True).over(w)).filter("__kind = 1")
    # one row a bin, put together before it is shuffled
    last = both.groupBy(*keys, "__bin").agg(F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__s"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "__bin", F.last("__last", ignorenulls=True).over(earlier)["__s"].alias("__before")).filter("__before is not null")
    out = met.alias("l").join(carried.alias("r"), _same("l", "r", [*keys, "__bin"]), "left").select("l.*", F.coalesce("l.__s", "r.__before").alias("__found"))
    return out.select(*keys, "__p.*", *[F.col(f"__found.{c}").alias(c) for c in seg_cols])


def covering_counts(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, pad: int = 0, bin_size: int = 1_000_000) -> DataFrame:
    """points with covering, the number of intervals with start - pad <= pos <= end + pad, without those that none covers.

    No pair of a point and an interval is formed: at each distinct place where intervals begin or end stands how many are open
    from there on, and each distinct place of a point takes that of the last one before it."""
    from pyspark.sql import Window

    lo, hi = F.col(start) - pad, F.col(end) + pad
    edges = F.explode(F.array(F.struct(lo.alias("at"), F.lit(1).alias("d")), F.struct((hi + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")
    steps = intervals.filter(lo <= hi).select(*keys, edges).groupBy(*keys, F.col("e.at").alias("__at")).agg(F.sum("e.d").alias("__d")).withColumn("__bin", _bin(F.col("__at"), bin_size))
    bins = steps.groupBy(*keys, "__bin").agg(F.sum("__d").alias("__all"))
    before = F.sum("__all").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*keys, "__bin", F.coalesce(before, F.lit(0)).alias("__before"))
    upto = F.sum("__d").over(Window.partitionBy(*keys, "__bin").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    open_ = steps.withColumn("__upto", upto).join(bins, [*keys, "__bin"]).select(*keys, F.col("__at").alias("__from"), (F.col("__before") + F.col("__upto")).alias("covering"))
    places = asof_join(points.select(*keys, pos).distinct(), open_, keys, pos, "__from", bin_size=bin_size).filter("covering > 0").select(*keys, pos, "covering")
    return points.join(places, [*keys, pos])


def near_counts(points: DataFrame, others: DataFrame, keys: list[str], pos: str, other: str, tol: int) -> DataFrame:
    """points with near, the number of rows of others with |pos - other| <= tol, without those that none is near; distinct
    places meet, so that a place has 2 * tol + 1 of the others' at most."""
    weighed = others.groupBy(*keys, other).agg(F.count("*").alias("__n"))
    met = band_join(points.select(*keys, pos).distinct(), weighed, keys, pos, other, tol, strict=False)
    return points.join(met.groupBy(*keys, pos).agg(F.sum("__n").alias("near")), [*keys, pos])


def distinct_near(rows: DataFrame, others: DataFrame, key: str, name: str, tol: int) -> DataFrame:
    """key, n_1, n_2, n_any: the distinct names of others (name, contig, at) with |pos - at| <= tol, for the rows (key, side 1 or
    2, contig, pos) of each key by side and together, without keys that none is near.

    No row meets a name. Names whose spots are the same are one signature with a weight, and a place sums up those near it.
    Keys with the same set of places are counted once: a name near m places of a set is in their sum m times, and the pairs
    of places that it is near to, of which it makes m * (m - 1) / 2, tell how often too many."""
    from .checkpoints import stored

    rows = stored(rows.select(key, "side", "contig", "pos").distinct())
    numbered = lambda df, n: stored(df.withColumn(n, F.monotonically_increasing_id()))
    places, spots = numbered(rows.select("contig", "pos").distinct(), "p"), numbered(others.select("contig", "at").distinct(), "s")
    near = stored(band_join(places, spots, ["contig"], "pos", "at", tol, strict=False).select("p", "s"))
    used = spots.join(near.select("s").distinct(), "s")
    each = others.join(used, ["contig", "at"]).groupBy(name).agg(F.sort_array(F.collect_set("s")).alias("spots"))
    signs = numbered(each.groupBy("spots").agg(F.count(name).alias("n")), "g")
    seen = stored(signs.select("g", "n", F.explode("spots").alias("s")).join(near, "s").select("g", "n", "p").distinct())
    alone = stored(seen.groupBy("p").agg(F.sum("n").alias("n")))

    at = rows.join(places, ["contig", "pos"]).join(alone.select("p"), "p")
    on = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("p"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("set")) for k, c in ((1, on(1)), (2, on(2)), (0, F.sort_array(F.collect_set("p"))))])
    asked = stored(at.groupBy(key).agg(kinds.alias("e")).select(key, F.explode("e").alias("e")).select(key, "e.*").filter(F.size("set") > 0))
    sets = numbered(asked.select("set").distinct(), "i")
    summed = sets.select("i", F.explode("set").alias("p")).join(alone, "p").groupBy("i").agg(F.sum("n").alias("n"))
    both = seen.join(seen.select("g", F.col("p").alias("q")), "g").filter("p < q")
    two = sets.filter(F.size("set") == 2).select("i", F.col("set")[0].alias("p"), F.col("set")[1].alias("q"))
    twice = both.groupBy("p", "q").agg(F.sum("n").alias("over")).join(two, ["p", "q"]).select("i", "over")
    more = sets.filter(F.size("set") > 2)
    member = more.select("i", F.explode("set").alias("p"), "set").select("i", "p", F.explode("set").alias("q")).filter("p < q")
    met = both.join(member, ["p", "q"]).groupBy("i", "g").agg(F.count("*").alias("pairs"), F.first("n").alias("n"))
    often = met.groupBy("i").agg(F.sum(F.col("n") * F.round((F.sqrt(8 * F.col("pairs") + 1) - 1) / 2).cast("long")).alias("over"))
    told = sets.join(summed, "i").join(twice.unionByName(often), "i", "left").select("set", (F.col("n") - F.coalesce("over", F.lit(0))).alias("n"))
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long")
    return asked.join(told, "set").groupBy(key).agg(of(1).alias("n_1"), of(2).alias("n_2"), of(0).alias("n_any"))


def fallback_join(left: DataFrame, dim: DataFrame, keys: list[Column], dim_key: str, value: str) -> DataFrame:
    """left with the dimension's value for the first of several keys that is found (null if none is)."""
    out = left
    names = []
    for i, key in enumerate(keys):
        names.append(f"__v{i}")
        out = out.join(dim.select(F.col(dim_key).alias(f"__k{i}"), F.col(value).alias(names[-1])), key == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def canonical_pair(df: DataFrame, a: str = "from", b: str = "to", fields: tuple[str, ...] = ("ref", "pos", "side")) -> DataFrame:
    """df with the ends' fields renamed a_* and b_* so that a_ref <= b_ref."""
    swap = F.col(f"{a}_{fields[0]}") > F.col(f"{b}_{fields[0]}")
    rest = [c for c in df.columns if c not in {f"{x}_{f}" for x in (a, b) for f in fields}]
    one = [F.when(swap, F.col(f"{b}_{f}")).otherwise(F.col(f"{a}_{f}")).alias(f"a_{f}") for f in fields]
    two = [F.when(swap, F.col(f"{a}_{f}")).otherwise(F.col(f"{b}_{f}")).alias(f"b_{f}") for f in fields]
    return df.select(*rest, *one, *two)


def _reach(ends: DataFrame, near: list[str], by: list[str], pos: str, insert: int) -> DataFrame:
    """near, by, __bin, __upto and __from: in a bin of insert bases the places below __upto and those above __from are those within
    insert bases of a position (exclusive). A position reaches all of its own bin and a part of either neighbour, so a bin's
    first and last ones tell. Dealt out once, by near."""
    at = ends.repartition(*near).groupBy(*near, *by, _bin(F.col(pos), insert).alias("__at")).agg(F.min(pos).alias("__lo"), F.max(pos).alias("__hi"))
    none = F.lit(None).cast("long")
    part = lambda k, upto, above: F.struct((F.col("__at") + k).alias("__bin"), upto.cast("long").alias("__upto"), above.cast("long").alias("__from"))
    parts = F.array(part(0, F.lit((1 << 63) - 1), none), part(1, F.col("__hi") + insert, none), part(-1, none, F.col("__lo") - insert))
    spread = at.filter("__at is not null").select(*near, *by, F.explode(parts).alias("__p")).select(*near, *by, "__p.*")
    return spread.groupBy(*near, *by, "__bin").agg(F.max("__upto").alias("__upto"), F.min("__from").alias("__from"))


def split_reads_to_clusters(reads: DataFrame, ends: DataFrame, key: str, cluster: str, insert: int) -> DataFrame:
    """Split reads (key, a_ref, a_pos, b_ref, b_pos) attached to every cluster of their contig pair that has a position
    within insert bases on each side: distinct key and cluster.

    ends: cluster, a_ref, b_ref, side (a or b) and pos, a row for each position of a cluster. What a cluster reaches of a bin is
    two bounds, whatever its positions; the distinct cells of reads meet the clusters that reach both of their bins, and a read
    meets those of its cell. The two sides are tested independently, so reads that share key and contig pair, told by a hash,
    take a join for each side. A cluster lies on one contig pair."""
    from .checkpoints import discard, stored

    pair = ["a_ref", "b_ref"]
    spread = stored(_reach(ends, [*pair, cluster], ["side"], "pos", insert))
    side = lambda s: spread.filter(F.col("side") == s).select(*pair, cluster, *[F.col(f"__{c}").alias(f"__{s}_{c}") for c in ("bin", "upto", "from")])
    reached = lambda s: (F.col(f"{s}_pos") < F.col(f"__{s}_upto")) | (F.col(f"{s}_pos") > F.col(f"__{s}_from"))
    placed = reads.select(key, *pair, "a_pos", "b_pos", _bin(F.col("a_pos"), insert).alias("__a_bin"), _bin(F.col("b_pos"), insert).alias("__b_bin"))
    placed = placed.withColumn("__own", F.xxhash64(key, *pair))
    several = stored(placed.groupBy("__own").agg(F.count("*").alias("__n")).filter("__n > 1").select("__own"))
    some = several.limit(1).count() > 0
    alone = placed.join(several, "__own", "left_anti") if some else placed
    cells = alone.select(*pair, "__a_bin", "__b_bin").distinct()
    near = cells.join(side("a"), [*pair, "__a_bin"]).join(side("b"), [*pair, cluster, "__b_bin"])
    out = alone.join(near, [*pair, "__a_bin", "__b_bin"]).filter(reached("a") & reached("b")).select(key, cluster)
    if not some:
        discard(several)
        return out
    more = stored(placed.join(several, "__own", "left_semi"))
    hits = lambda s: more.join(side(s), [*pair, f"__{s}_bin"]).filter(reached(s)).select(key, *pair, cluster).distinct()
    return out.unionByName(hits("a").join(hits("b"), [key, *pair, cluster]).select(key, cluster))


def matched_truth(truth: DataFrame, calls: DataFrame, tol: int = 50, by: list[str] = (), width: int = 8) -> DataFrame:
    """Truth rows (by, ref1, pos1, ref2, pos2) that a call (by, cref1, cpos1, cref2, cpos2) meets in either orientation.

    Both are put in one orientation (calls whose two contigs are one in both) and dealt over cells of width * tol on both
    positions; only a call near a cell's edge is repeated. A row looks for one call of its cell and no further. Rows are put in the
    order of a cell's hash, a number, before that of its names."""
    size = width * tol
    turn = lambda p, q, x, y: F.struct(F.col(p).alias("__r1"), F.col(x).alias("__p1"), F.col(q).alias("__r2"), F.col(y).alias("__p2"))
    asis, swapped = turn("cref1", "cref2", "cpos1", "cpos2"), turn("cref2", "cref1", "cpos2", "cpos1")
    ways = F.when(F.col("cref1") < F.col("cref2"), F.array(asis)).when(F.col("cref1") > F.col("cref2"), F.array(swapped)).otherwise(F.array(asis, swapped))
    turned = calls.select(*[F.col(k).alias(f"__{k}") for k in by], F.explode(ways).alias("__w")).select(*[f"__{k}" for k in by], "__w.*")
    reach = lambda c: F.explode(F.sequence(_bin(F.col(c) - tol, size), _bin(F.col(c) + tol, size)))
    near = turned.filter("__p1 is not null and __p2 is not null").withColumn("__x", reach("__p1")).withColumn("__y", reach("__p2"))
    swap = F.col("ref1") > F.col("ref2")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    left = truth.withColumns({"__s1": pick("ref1", "ref2"), "__s2": pick("ref2", "ref1"), "__q1": pick("pos1", "pos2"), "__q2": pick("pos2", "pos1")})
    left = left.withColumns({"__u": _bin(F.col("__q1"), size), "__v": _bin(F.col("__q2"), size)})
    # an expression of the join, which is not shuffled
    cell = F.xxhash64(*by, "__s1", "__s2", "__u", "__v") == F.xxhash64(*[f"__{k}" for k in by], "__r1", "__r2", "__x", "__y")
    test = cell & (F.col("__s1") == F.col("__r1")) & (F.col("__s2") == F.col("__r2")) & (F.col("__u") == F.col("__x")) & (F.col("__v") == F.col("__y"))
    test = test & (F.abs(F.col("__q1") - F.col("__p1")) < tol) & (F.abs(F.col("__q2") - F.col("__p2")) < tol)
    test = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in by], test)
    return left.join(near.hint("merge"), test, "left_semi").select(*truth.columns)
