"""Evidence for the mechanism of a transfer: repeats and mobile elements at its junctions, inserted bases and homology."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import mechanism, reverse_complement
from .alignment import runs_batch
from .joins import interval_join

FLANK, LEAST_READ = 100, 50


@F.pandas_udf(T.IntegerType())
def _homology(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    return pd.Series(runs_batch(x, y)[0])


@F.pandas_udf(T.IntegerType())
def _inserted(read: pd.Series, ref: pd.Series) -> pd.Series:
    x, y = read.fillna("").tolist(), ref.fillna("").tolist()
    return pd.Series(runs_batch(x, y)[1])


def _cut(seq: Column, a: Column, b: Column) -> Column:
    """The bases a to b (0-based, half open); a start below 1 is set to 1."""
    first = F.greatest(a, F.lit(1))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(b - first, F.lit(0)).cast("int"))


def _inside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows (event_id, side) of points (event_id, side, contig, pos) that lie in an interval (contig, start, end)."""
    return interval_join(points.select("event_id", "side", "contig", "pos"), intervals.select("contig", "start", "end"), ["contig"], "pos", "start", "end", how="left_semi").select("event_id", "side")


def mechanism_evidence(events: DataFrame, tandem: DataFrame, mobile: DataFrame, refs: DataFrame, reads: DataFrame) -> DataFrame:
    """event_id, tandem, tei, inserted, homology, del_mechanism and ins_mechanism of each event.

    events: event_id, receptor, insert_locus, donor, delete_start, delete_end (ordered here). tandem and mobile: contig,
    start, end. refs: contig, seq. reads: event_id, side (start or end: the donor's end that the read supports), row_id,
    seq and strand. inserted is the longest run of read bases without a reference base at either end, by the first read
    of LEAST_READ bases or more without N, whose reference has none either. homology is the longest run without a gap in
    the alignment of the FLANK bases on both sides of the two ends, 0 if either has an N."""
    a, b = F.least("delete_start", "delete_end"), F.greatest("delete_start", "delete_end")
    e = events.select("event_id", "receptor", "insert_locus", "donor", a.alias("a"), b.alias("b"))
    points = e.select("event_id", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("donor").alias("contig"), F.col("a").alias("pos")),
        F.struct(F.lit("end").alias("side"), F.col("donor").alias("contig"), F.col("b").alias("pos")),
        F.struct(F.lit("insert").alias("side"), F.col("receptor").alias("contig"), F.col("insert_locus").alias("pos")),
    )).alias("p")).select("event_id", "p.*")
    flag = lambda found, name: found.groupBy("event_id").agg(F.bool_or(F.col("side") != "insert").alias(name), F.bool_or(F.col("side") == "insert").alias(f"ins_{name}"))
    flags = flag(_inside(points, tandem), "tandem").join(flag(_inside(points, mobile), "tei"), "event_id", "full")

    donor = e.join(refs.select(F.col("contig").alias("donor"), "seq"), "donor")
    around = lambda c: _cut(F.col("seq"), F.col(c) - FLANK, F.col(c) + FLANK)
    flanks = donor.select("event_id", around("a").alias("x"), around("b").alias("y"))
    whole = ~(F.col("x").contains("N") | F.col("y").contains("N"))
    homology = flanks.select("event_id", F.when(whole, _homology("x", "y")).otherwise(0).alias("homology"))

    at = F.when(F.col("side") == "start", F.col("a")).otherwise(F.col("b"))
    near = donor.join(reads.withColumnRenamed("seq", "read"), "event_id").filter(F.length("read") >= LEAST_READ)
    ref = _cut(F.col("seq"), at - F.length("read"), at)
    usable = near.withColumn("ref", F.when(F.col("strand") == "-", reverse_complement(ref)).otherwise(ref)).filter(~F.col("read").contains("N") & ~F.col("ref").contains("N"))
    first = usable.groupBy("event_id", "side").agg(F.min_by(F.struct("read", "ref"), "row_id").alias("r"))
    inserted = first.withColumn("n", _inserted("r.read", "r.ref")).groupBy("event_id").agg(F.max("n").alias("inserted"))

    out = e.select("event_id").join(flags, "event_id", "left").join(homology, "event_id", "left").join(inserted, "event_id", "left").fillna(False).fillna(0)
    ins = F.when(F.col("ins_tei"), "TEI").when(F.col("ins_tandem"), "VNTR").otherwise("NA")
    return out.select("event_id", "tandem", "tei", "inserted", "homology", mechanism(F.col("tei"), F.col("tandem"), F.col("inserted"), F.col("homology")).alias("del_mechanism"), ins.alias("ins_mechanism"))
