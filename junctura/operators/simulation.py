"""Seeded simulation of transfers for fixtures, and verification of events by long alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reverse_complement


def with_snps(seq, rate: float, seed: int):
    """A sequence column with about rate of its bases replaced by another one, chosen by a seeded hash of the place."""
    bases = F.split(seq, "")
    drawn = lambda i: F.pmod(F.xxhash64(seq, i, F.lit(seed)), F.lit(1_000_000))
    other = lambda b: F.translate(b, "ACGT", "GTAC")
    return F.array_join(F.transform(bases, lambda b, i: F.when(drawn(i) < int(rate * 1_000_000), other(b)).otherwise(b)), "")


def with_indels(seq, rate: float, seed: int):
    """A sequence column in which about rate of the places lose their base or get another one before it, half each."""
    bases = F.split(seq, "")
    drawn = lambda i: F.pmod(F.xxhash64(seq, i, F.lit(seed), F.lit("indel")), F.lit(2_000_000))
    extra = lambda i: F.element_at(F.array(*map(F.lit, "ACGT")), F.pmod(drawn(i), F.lit(4)).cast("int") + 1)
    half = int(rate * 1_000_000)
    return F.array_join(F.transform(bases, lambda b, i: F.when(drawn(i) < half, "").when(drawn(i) < 2 * half, F.concat(extra(i), b)).otherwise(b)), "")


#: Scenarios of a simulation: rates of changed and of lost or added bases, lengths of the transferred segment, depths,
#: read lengths, and whether the donor is in the sample.
SCENARIOS = {"snp": (0.01, 0.02, 0.03, 0.04, 0.05), "indel": (0.0, 0.005), "length": (120, 300), "depth": (5, 10, 30, 100), "read_length": (75, 100, 150), "donor": (True, False)}


def scenarios(spark, vary: tuple[str, ...] = tuple(SCENARIOS), replicates: int = 10) -> DataFrame:
    """A row for each value of each varied parameter, the others at their first value, and for each replicate: scenario,
    replicate, seed and the parameters."""
    base = {k: v[0] for k, v in SCENARIOS.items()}
    rows = [(f"{k}={v}", r, *(base | {k: v}).values()) for k in vary for v in SCENARIOS[k] for r in range(replicates)]
    made = spark.createDataFrame(rows, "scenario string, replicate int, snp double, indel double, length int, depth int, read_length int, donor boolean")
    return made.withColumn("seed", F.pmod(F.xxhash64("scenario", "replicate"), F.lit(1 << 30)))


def simulated_reads(seqs: DataFrame, depth: int, read_length: int, seed: int, insert: int = 300) -> DataFrame:
    """Read pairs (contig, pair, seq1, seq2, the second turned around) from seeded places, about depth over each contig."""
    many = F.greatest(F.floor(F.length("seq") * depth / (2 * read_length)), F.lit(0)).cast("int")
    spots = seqs.filter(F.length("seq") >= insert).select("contig", "seq", F.explode(F.sequence(F.lit(1), many)).alias("pair")) if depth else seqs.limit(0)
    at = F.pmod(F.xxhash64("contig", "pair", F.lit(seed)), F.length("seq") - insert + 1).cast("int")
    placed = spots.withColumn("at", at + 1)
    far = reverse_complement(F.expr(f"substring(seq, at + {insert - read_length}, {read_length})"))
    return placed.select("contig", "pair", F.expr(f"substring(seq, at, {read_length})").alias("seq1"), far.alias("seq2"))


def simulate_transfers(seqs: DataFrame, seed: int, length: int = 120, snp: float = 0.01, indel: float = 0.0) -> DataFrame:
    """Each contig receives a segment of the contig next in a seeded order, turned around for half of them.

    Columns: receptor, insert_locus, donor, delete_start, delete_end, reverse_flag (the truth), seq (the new recipient).
    The order is dealt into bounded groups of neighbours, so no task sorts the whole table."""
    from pyspark.sql import Window

    usable = seqs.filter(F.length("seq") >= 2 * length).withColumn("order", F.xxhash64("contig", F.lit(seed)))
    # hash groups of about a thousand contigs; neighbours are taken within a group, the last one takes the first
    usable = usable.withColumn("group", F.pmod(F.xxhash64("contig"), F.lit(64)))
    w = Window.partitionBy("group").orderBy("order", "contig")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    pair = usable.select("contig", "seq", "order", nxt("contig").alias("donor"), nxt("seq").alias("donor_seq")).filter("donor <> contig")
    at = F.pmod(F.col("order"), F.length("seq")).cast("long")
    start = F.pmod(F.xxhash64("order"), F.length("donor_seq") - length).cast("long")
    placed = pair.select("contig", "seq", "donor", at.alias("insert_locus"), start.alias("delete_start"), "donor_seq", (F.pmod("order", F.lit(2)) == 1).alias("turned"))
    piece = F.expr(f"substring(donor_seq, cast(delete_start + 1 AS int), {length})")
    mutated = with_snps(F.when(F.col("turned"), reverse_complement(piece)).otherwise(piece), snp, seed)
    mutated = with_indels(mutated, indel, seed) if indel else mutated
    built = F.concat(F.expr("substring(seq, 1, cast(insert_locus AS int))"), mutated, F.expr("substring(seq, cast(insert_locus + 1 AS int))"))
    return placed.select(
        F.col("contig").alias("receptor"), "insert_locus", "donor", "delete_start", (F.col("delete_start") + length).alias("delete_end"), F.when(F.col("turned"), "True").otherwise("False").alias("reverse_flag"), built.alias("seq")
    )


def rebuilt_recipients(events: DataFrame, refs: DataFrame, window: int = 2000) -> DataFrame:
    """event_id, seq, left_junction, right_junction and complete: the recipient about the insertion with the donor's segment
    in it, turned around for reverse events. complete is false where a contig ends within the window or segment.

    events: event_id, receptor, insert_locus, donor, delete_start, delete_end, reverse_flag; refs: contig, seq."""
    cut = lambda seq, a, b: F.substring(seq, (F.greatest(a, F.lit(0)) + 1).cast("int"), F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)).cast("int"))
    one, two = refs.select(F.col("contig").alias("receptor"), F.col("seq").alias("__r")), refs.select(F.col("contig").alias("donor"), F.col("seq").alias("__d"))
    met = events.join(one, "receptor").join(two, "donor")
    at = F.col("insert_locus")
    left, right = cut(F.col("__r"), at - window, at), cut(F.col("__r"), at, at + window)
    piece = cut(F.col("__d"), F.col("delete_start"), F.col("delete_end"))
    turned = F.when(F.col("reverse_flag") == "True", reverse_complement(piece)).otherwise(piece)
    parts = met.select("event_id", left.alias("l"), turned.alias("m"), right.alias("r"), (2 * window + F.col("delete_end") - F.col("delete_start")).alias("whole"))
    seq = F.concat("l", "m", "r")
    return parts.select(
        "event_id", seq.alias("seq"), F.length("l").cast("long").alias("left_junction"), (F.length("l") + F.length("m")).cast("long").alias("right_junction"), (F.length(seq) == F.col("whole")).alias("complete"),
    )


def verified_junctions(events: DataFrame, aligned: DataFrame, around: int = 30, coverage: float = 0.93, long: int = 8000) -> DataFrame:
    """event_id, left_ok, right_ok, covered, mapped, verified of events (event_id, left_junction, right_junction, length) on
    rebuilt recipients, by long alignments (event_id, t_start, t_end) on them.

    A junction is supported by an alignment that spans it by around bases. covered is the covered share of the inserted
    part. mapped: one alignment spans both junctions, or, on recipients longer than long, two overlapping ones do
    together. verified: one alignment supports both junctions or, on long ones, those of the two junctions overlap; and
    both are supported, enough is covered, and it is mapped."""
    from .scans import interval_union

    met = events.join(aligned, "event_id")
    spans = lambda c: (F.col("t_start") <= F.col(c) - around) & (F.col("t_end") >= F.col(c) + around)
    left, right = spans("left_junction"), spans("right_junction")
    inner = (F.col("t_start") <= F.col("left_junction")) & (F.col("t_end") >= F.col("right_junction"))
    # two that overlap span both if the farthest end of those that begin in time meets the earliest start of those that end in time
    reach = F.max(F.when(F.col("t_start") <= F.col("left_junction"), F.col("t_end")))
    begin = F.min(F.when(F.col("t_end") >= F.col("right_junction"), F.col("t_start")))
    sides = met.groupBy("event_id").agg(
        F.bool_or(left).alias("left_ok"), F.bool_or(right).alias("right_ok"), F.bool_or(left & right).alias("__one"),
        F.max(F.when(left, F.col("t_end"))).alias("__end"), F.min(F.when(right, F.col("t_start"))).alias("__start"),
        F.bool_or(inner).alias("__inner"), (begin <= reach).alias("__two"), (F.max("length") > long).alias("__long"),
    )
    union = interval_union(aligned, ["event_id"], "t_start", "t_end").join(events, "event_id")
    inside = F.greatest(F.least("t_end", "right_junction") - F.greatest("t_start", "left_junction"), F.lit(0))
    cover = union.groupBy("event_id").agg((F.sum(inside) / F.max(F.col("right_junction") - F.col("left_junction")).cast("double")).alias("covered"))
    no = F.lit(False)
    mapped = F.col("__inner") | (F.col("__long") & F.coalesce("__two", no))
    joined = F.col("__one") | (F.col("__long") & F.coalesce(F.col("__start") < F.col("__end"), no))
    out = sides.join(cover, "event_id").withColumn("mapped", mapped)
    return out.select("event_id", "left_ok", "right_ok", "covered", "mapped", (F.col("left_ok") & F.col("right_ok") & joined & F.col("mapped") & (F.col("covered") >= coverage)).alias("verified"))
