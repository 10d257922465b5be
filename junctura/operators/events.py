"""Breakpoints to transfer events: cleaning, pairing and choice.

Two breakpoints of a sample on one contig pair form an event if exactly one of their ends is shared (the receptor, whose
position is the insertion) and the other ends lie apart (the donor's segment). With breakpoints in canonical orientation
the four possible branches are one symmetric condition, so the pairing is an equi-join on sample, contig pair and the
bin of the shared end, tried once for either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import genome
from .checkpoints import stored
from .graph import matching_per_component
from .joins import canonical_pair
from .scans import islands

SHARED, LEAST_LENGTH, END_ZONE = 20, 500, 100


def inter_genome(bkp: DataFrame) -> DataFrame:
    return bkp.filter(genome(F.col("from_ref")) != genome(F.col("to_ref")))


def with_abundance(bkp: DataFrame, reads: DataFrame, cutoff: float = 1e-7) -> DataFrame:
    """Rows with cross_split_reads / reads_num at least the cutoff, and each one's share of its sample's kept reads."""
    joined = bkp.join(reads.filter("reads_num > 0"), "sample").withColumn("abundance", F.col("cross_split_reads") / F.col("reads_num").cast("double"))
    kept = joined.filter(F.col("abundance") >= cutoff)
    share = F.col("cross_split_reads") / F.sum("cross_split_reads").over(Window.partitionBy("sample")).cast("double")
    return kept.withColumn("split_abundance", share)


def away_from_ends(bkp: DataFrame, contigs: DataFrame, zone: int = END_ZONE) -> DataFrame:
    """Breakpoints at least zone bases from either end of both contigs."""
    one = contigs.select(F.col("contig").alias("from_ref"), F.col("len").alias("__l1"))
    two = contigs.select(F.col("contig").alias("to_ref"), F.col("len").alias("__l2"))
    inside = lambda pos, length: (F.col(pos) >= zone) & (F.col(pos) <= F.col(length) - zone)
    return bkp.join(one, "from_ref").join(two, "to_ref").filter(inside("from_pos", "__l1") & inside("to_pos", "__l2")).drop("__l1", "__l2")


def event_pairs(bkp: DataFrame, shared: int = SHARED, least: int = LEAST_LENGTH) -> DataFrame:
    """Pairs i < j of breakpoints (bkp_id, sample, ends, if_reverse, cross_split_reads) that form an event.

    Columns: sample, i, j, receptor, insert_locus, donor, delete_start, delete_end, reverse_flag, weight."""
    columns = ["bkp_id", "sample", "from_ref", "from_pos", "from_side", "to_ref", "to_pos", "to_side", "if_reverse", "cross_split_reads"]
    # read four times below
    flat = stored(canonical_pair(bkp.select(*columns)))

    def one(close: str, far: str) -> DataFrame:
        # the segment runs from a tail to a head, so only these two sides meet
        at = lambda side: flat.filter(F.col(f"{far}_side") == side).select(
            "sample", "a_ref", "b_ref", "if_reverse", F.col("bkp_id").alias(side), F.col(f"{close}_pos").alias(f"{side}_close"), F.col(f"{far}_pos").alias(f"{side}_far"),
            F.col("cross_split_reads").alias(f"{side}_n"), F.floor(F.col(f"{close}_pos") / shared).alias("bin"),
        )
        right = at("head").withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
        near = F.abs(F.col("tail_close") - F.col("head_close")) < shared
        length = F.col("head_far") - F.col("tail_far")
        met = at("tail").join(right, ["sample", "a_ref", "b_ref", "if_reverse", "bin"]).filter(near & (length > shared) & (length >= least) & (F.col("tail") != F.col("head")))
        first = F.col("tail") < F.col("head")
        return met.select(
            "sample", F.least("tail", "head").alias("i"), F.greatest("tail", "head").alias("j"), F.col(f"{close}_ref").alias("receptor"),
            F.when(first, F.col("tail_close")).otherwise(F.col("head_close")).alias("insert_locus"), F.col(f"{far}_ref").alias("donor"),
            F.col("tail_far").alias("delete_start"), F.col("head_far").alias("delete_end"), F.col("if_reverse").alias("reverse_flag"), ((F.col("tail_n") + F.col("head_n")) / F.lit(2.0)).alias("weight"),
        )

    return one("a", "b").unionByName(one("b", "a"))


def unambiguous(pairs: DataFrame, pool: DataFrame, shared: int = SHARED, eps: int = 100, most: int = 2) -> DataFrame:
    """Pairs whose insertion site sees at most `most` clusters of donor positions in the pool of breakpoints."""
    site = stored(pairs.select("receptor", "donor", "insert_locus").distinct())
    contigs = site.select("receptor", "donor").distinct()
    ends = pool.select(F.col("from_ref").alias("receptor"), F.col("from_pos").alias("r_pos"), F.col("to_ref").alias("donor"), F.col("to_pos").alias("d_pos"))
    ends = ends.unionByName(pool.select(F.col("to_ref").alias("receptor"), F.col("to_pos").alias("r_pos"), F.col("from_ref").alias("donor"), F.col("from_pos").alias("d_pos")))
    ends = ends.join(contigs, ["receptor", "donor"], "left_semi").distinct().withColumn("bin", F.floor(F.col("r_pos") / shared))
    asked = site.withColumn("bin", F.explode(F.array(*[F.floor(F.col("insert_locus") / shared) + k for k in (-1, 0, 1)])))
    seen = asked.join(ends, ["receptor", "donor", "bin"]).filter(F.abs(F.col("r_pos") - F.col("insert_locus")) < shared)
    key = ["receptor", "donor", "insert_locus"]
    counts = islands(seen.select(*key, "d_pos").distinct(), key, "d_pos", eps).groupBy(*key).agg(F.max("cluster").alias("n"))
    return pairs.join(counts.filter(F.col("n") <= most).select(*key), key, "left_semi")


def clear_sites(pool: DataFrame, shared: int = SHARED, eps: int = 100, most: int = 2) -> DataFrame:
    """The places (receptor, donor, insert_locus) of the pool's ends that see at most `most` clusters of donor positions in it.

    Each place of a receptor keeps its donor positions as clusters, as many as the contig's length over eps at most; what
    a site sees are those of the places near it put together."""
    end = lambda one, two: F.struct(F.col(f"{one}_ref").alias("receptor"), F.col(f"{one}_pos").alias("r_pos"), F.col(f"{two}_ref").alias("donor"), F.col(f"{two}_pos").alias("d_pos"))
    ends = pool.select(F.explode(F.array(end("from", "to"), end("to", "from"))).alias("e")).select("e.*")
    grouped = ends.groupBy("receptor", "donor", "r_pos").agg(F.sort_array(F.collect_set("d_pos")).alias("d"))
    opens = F.filter("d", lambda x, i: (i == 0) | (x - F.get("d", i - 1) > eps))
    closes = F.filter("d", lambda x, i: (i == F.size("d") - 1) | (F.get("d", i + 1) - x > eps))
    places = stored(grouped.select("receptor", "donor", "r_pos", F.arrays_zip(opens.alias("lo"), closes.alias("hi")).alias("spans")))
    bin_ = lambda c: F.floor(F.col(c) / shared)
    asked = places.select("receptor", "donor", F.col("r_pos").alias("insert_locus")).withColumn("bin", F.explode(F.array(*[bin_("insert_locus") + k for k in (-1, 0, 1)])))
    seen = asked.join(places.withColumn("bin", bin_("r_pos")), ["receptor", "donor", "bin"]).filter(F.abs(F.col("r_pos") - F.col("insert_locus")) < shared)
    key = ["receptor", "donor", "insert_locus"]
    spans = seen.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("reach"))
    step = lambda acc, x: F.struct((acc["n"] + F.when(acc["reach"].isNull() | (x["lo"] - acc["reach"] > eps), 1).otherwise(0)).cast("long").alias("n"), F.greatest(acc["reach"], x["hi"]).cast("long").alias("reach"))
    return spans.filter(F.aggregate("spans", none, step)["n"] <= most).select(*key)


def clear_pairs(bkp: DataFrame, pool: DataFrame, shared: int = SHARED, least: int = LEAST_LENGTH) -> DataFrame:
    """unambiguous(event_pairs(bkp), pool) where all of bkp is in the pool: pairs are formed at clear sites alone, of which
    there are the fewer the more breakpoints there are."""
    sites = stored(clear_sites(pool, shared))
    flat = canonical_pair(bkp.select("bkp_id", "sample", "from_ref", "from_pos", "from_side", "to_ref", "to_pos", "to_side", "if_reverse", "cross_split_reads"))
    end = lambda close, far: F.struct(F.lit(close).alias("close"), F.col(f"{close}_ref").alias("receptor"), F.col(f"{far}_ref").alias("donor"), F.col(f"{close}_pos").alias("insert_locus"), F.col(f"{far}_pos").alias("far"), F.col(f"{far}_side").alias("side"))
    ends = flat.select("sample", "if_reverse", "bkp_id", "cross_split_reads", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("sample", "if_reverse", "bkp_id", "cross_split_reads", "e.*")
    ends = ends.filter("side IN ('tail', 'head')").join(sites.select("receptor", "donor").distinct(), ["receptor", "donor"], "left_semi")
    bin_ = F.floor(F.col("insert_locus") / shared)
    key = ["sample", "receptor", "donor", "close", "if_reverse", "bin", "side"]
    # the breakpoint of the lesser id gives the site
    one = ends.join(sites, ["receptor", "donor", "insert_locus"]).withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    one = one.withColumnRenamed("bkp_id", "i").withColumnRenamed("far", "i_far").withColumnRenamed("cross_split_reads", "i_n").withColumn("side", F.when(F.col("side") == "tail", "head").otherwise("tail"))
    two = ends.select("sample", "receptor", "donor", "close", "if_reverse", bin_.alias("bin"), "side", F.col("bkp_id").alias("j"), F.col("insert_locus").alias("__at"), F.col("far").alias("j_far"), F.col("cross_split_reads").alias("j_n"))
    start, stop = (F.when(F.col("side") == "head", F.col(x)).otherwise(F.col(y)) for x, y in (("i_far", "j_far"), ("j_far", "i_far")))
    met = one.join(two, key).filter((F.col("i") < F.col("j")) & (F.abs(F.col("__at") - F.col("insert_locus")) < shared) & (stop - start > shared) & (stop - start >= least))
    return met.select("sample", "i", "j", "receptor", "insert_locus", "donor", start.alias("delete_start"), stop.alias("delete_end"), F.col("if_reverse").alias("reverse_flag"), ((F.col("i_n") + F.col("j_n")) / F.lit(2.0)).alias("weight"))


def events(bkp: DataFrame, contigs: DataFrame | None = None, least: int = LEAST_LENGTH, support: int = 0, ambiguity: bool = True, matching: bool = True) -> DataFrame:
    """Transfer events of all samples: cleaned breakpoints, paired, unambiguous, and matched so that each breakpoint
    belongs to one event at most."""
    pool = inter_genome(bkp)
    used = pool.filter(F.col("cross_split_reads") >= support)
    used = away_from_ends(used, contigs) if contigs is not None else used
    pairs = clear_pairs(used, pool, least=least) if ambiguity else event_pairs(used, least=least)
    if matching:
        pairs = stored(pairs)
        chosen = matching_per_component(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "weight"))
        pairs = pairs.join(chosen.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_semi")
    return pairs
