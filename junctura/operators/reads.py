"""Samples of reads: by a share or by a budget of bases, both mates or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def down_sampled(reads: DataFrame, seed: int, share: float | None = None, bases: int | None = None, name: str = "read_name", seq: str = "seq") -> DataFrame:
    """Reads whose name's seeded hash falls into a share, or into bases over all bases of the reads (all, if there are
    fewer). The choice goes by the name alone, so it does not depend on partitions, and mates stay together."""
    place = F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1_000_000))
    if bases is None:
        return reads.filter(place < int(1_000_000 * (1.0 if share is None else share)))
    total = reads.agg(F.sum(F.length(seq)).alias("__total"))
    kept = reads.crossJoin(F.broadcast(total)).filter(place < F.least(F.lit(1.0), F.lit(float(bases)) / F.col("__total")) * 1_000_000)  # one row
    return kept.drop("__total")
