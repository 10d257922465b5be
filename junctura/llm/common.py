"""Shared helpers: table reading, shared-folder staging and split rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, by contract: blank and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Folders made where the session names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir; where that is unset on one machine (tests), a new
    temporary one. A cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="junctura-")
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_folder = path.rpartition("/")[0]
    return out


def staged_alone(df: DataFrame, name: str) -> DataFrame:
    """staged(), with the shuffle files of the write deleted at its end instead of when the driver collects garbage: for
    jobs that write many tables in a row and read none but those again."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        return staged(df, name)
    finally:
        spark.conf.set(setting, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that staged() gave, once nothing reads them any more: what followed has been written itself."""
    for t in tables:
        if folder := t.__dict__.pop("_staged_folder", None):
            context = t.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null gives none."""
    blank = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(blank, " "), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows in an Arrow batch, so that a Python worker holds a few MB of texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pieces_of(texts: list, limit: int = 4_000_000):
    """Cuts a list of texts into runs of at most limit characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def spread(starts, lengths):
    """Indices start, start + 1, ... for each of the runs, in one flat array."""
    import numpy as np

    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - ends + lengths, lengths)


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """At most rows rows of df, spread by a seeded hash of the key; for fitting models only.

    A share a little over rows / count is taken first, so that no partition sends more than its part of the sample."""
    share = min(1.0, 1.5 * rows / max(1, df.count()))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    return df.withColumn("__place", place).filter(F.col("__place") < int(share * (1 << 30))).orderBy("__place", key).limit(rows).drop("__place")
