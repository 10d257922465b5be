"""Corpus pipeline: five operators of junctura.llm applied in turn to the documents table.

A stage takes (spark, docs, sf_dir), works on all rows of docs and returns rows with the columns of documents (the last
one adds its own); further columns are dropped, whatever their names. run() writes each stage's rows as Parquet in the
shared folder and hands the reread table on.

Cases: an empty table gives an empty one. Rows with a null text or one without letters have no language and go in the
first stage; no later stage has a rule of its own for them. A null language or source is a leaf `unknown` of the mix.
Very long texts are read whole by every stage. Repeated rows are one document after near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm import language_crf, minhash_forest, mixing, piece_bpe, repeats
from junctura.llm.common import discard, documents, small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if no language reaches this share of its words.
LEAST_LANGUAGE = 0.5
#: The mix keeps this percentage of the tokens that reach it, each document once at most.
MIX_PERCENT = 90


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    model = language_crf.fit(docs)
    told = language_crf.predict(docs, model)
    return told.filter((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id. Of rows that repeat an id the one whose
    text has the least hash stands for all."""
    kept = minhash_forest.near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(repeats.text_hash())
    return docs.join(kept, "doc_id", "left_semi").withColumn("__r", F.row_number().over(first)).filter("__r = 1").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur twice or more, in whatever document: every place of a
    passage is cut, and a document of which no word is left falls away. n_chars follows the text."""
    cut = repeats.remove_repeats(docs.select(*COLUMNS), repeats.PASSAGE, "word")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mix."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.domain_of(F.col("source")), percent=MIX_PERCENT, max_epochs=1)
    return mixed.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, the end id last, and the number of ids."""
    small_batches(spark)
    made = piece_bpe.encode_decode(docs.select(*COLUMNS), piece_bpe.model_file())
    return made.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the language model nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
