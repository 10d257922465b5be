"""Checks of a run's inputs before anything is read."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Suffixes of compressed files.
COMPRESSED = (".gz", ".bz2", ".xz", ".zip", ".tar", ".tgz")


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def input_problems(spark: SparkSession, reference: str, reads: tuple[str, str], use_kmers: bool = True) -> list[str]:
    """What stands against a run, as sentences: absent files, a compressed reference (its records could not be split), reads
    of which only one is compressed, and with k-mers reads compressed in another way than gzip."""
    out = [f"{p} does not exist" for p in (reference, *reads) if not exists(spark, p)]
    packed = lambda p: p.lower().endswith(COMPRESSED)
    if packed(reference):
        out.append(f"{reference} must not be compressed")
    if packed(reads[0]) != packed(reads[1]):
        out.append("either both files of reads are compressed or none is")
    out += [f"{p} must be plain or gzip" for p in reads if use_kmers and packed(p) and not p.lower().endswith(".gz")]
    return out


def check_inputs(spark: SparkSession, reference: str, reads: tuple[str, str], use_kmers: bool = True) -> None:
    if found := input_problems(spark, reference, reads, use_kmers):
        raise ValueError("; ".join(found))
