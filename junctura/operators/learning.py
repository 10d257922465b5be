"""Classification of samples from markers with pyspark.ml: folds, cohorts left out, external sets."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_table(presence: DataFrame, labels: DataFrame, markers: list[str]) -> DataFrame:
    """labels (sample, label, ...) with a 0/1 vector of the markers (a bounded list) each sample has (sample, tag)."""
    has = presence.filter(F.col("tag").isin(markers)).groupBy("sample").pivot("tag", markers).agg(F.lit(1.0))
    wide = labels.join(has, "sample", "left").fillna(0.0, markers)
    return VectorAssembler(inputCols=markers, outputCol="features").transform(wide)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """df with fold: equal shares of each class, by a seeded hash."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("fold", (F.row_number().over(w) % folds).cast("int"))


def undersampled(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows of each class as the smallest has."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    least = df.groupBy(label).count().agg(F.min("count").alias("__least"))
    return df.withColumn("__r", F.row_number().over(w)).crossJoin(F.broadcast(least)).filter("__r <= __least").drop("__r", "__least")  # one row


def auc(train: DataFrame, test: DataFrame, label: str = "label", trees: int = 30, depth: int = 5, seed: int = 0) -> float:
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability").evaluate(model.transform(test))


def cross_validated(df: DataFrame, folds: int = 5, key: str = "sample", seed: int = 0) -> list[float]:
    """The AUC of each stratified fold; training rows are undersampled to equal classes."""
    dealt = stratified_folds(df, "label", key, folds, seed).cache()
    return [auc(undersampled(dealt.filter(F.col("fold") != k), "label", key, seed), dealt.filter(F.col("fold") == k), seed=seed) for k in range(folds)]


def markers(presence: DataFrame, labels: DataFrame, n: int) -> list[str]:
    """The n tags (sample, tag) that differ most between the labels 1 and 0 (sample, label) by Fisher's test, in the order
    of p-value and tag: a bounded list of names."""
    from .stats import fisher_exact

    sizes = labels.agg(F.sum("label").cast("long").alias("__n1"), F.sum(1 - F.col("label")).cast("long").alias("__n0"))
    has = presence.join(labels.select("sample", "label"), "sample").groupBy("tag").agg(F.sum("label").cast("long").alias("a"), F.sum(1 - F.col("label")).cast("long").alias("b"))
    table = has.crossJoin(F.broadcast(sizes)).select("tag", "a", "b", (F.col("__n1") - F.col("a")).alias("c"), (F.col("__n0") - F.col("b")).alias("d"))  # one row
    return [r.tag for r in fisher_exact(table, "a", "b", "c", "d").orderBy(F.round("p_value", 12), "tag").limit(n).collect()]


def leave_one_out(presence: DataFrame, labels: DataFrame, n: int = 25, group: str = "cohort") -> tuple[dict[str, float], float]:
    """The AUC of each left-out cohort of labels (sample, group, label), and their mean weighted by size.

    Markers are chosen anew in each fold, from the cohorts that train only."""
    sizes = {r[0]: r[1] for r in labels.groupBy(group).count().collect()}  # a row for each cohort
    scores = {}
    for g in sizes:
        train = labels.filter(F.col(group) != g)
        chosen = markers(presence, train, n)
        scores[g] = auc(feature_table(presence, train, chosen), feature_table(presence, labels.filter(F.col(group) == g), chosen))
    return scores, sum(scores[g] * k for g, k in sizes.items()) / sum(sizes.values())


def validated(presence: DataFrame, labels: DataFrame, other_presence: DataFrame, other_labels: DataFrame, n: int = 25) -> DataFrame:
    """One row: auc, accuracy and false positive rate (at 0.5) on an external set, of a forest trained with its own markers.

    Both sets have label 1 for cases."""
    chosen = markers(presence, labels, n)
    model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=30, maxDepth=5, seed=0).fit(feature_table(presence, labels, chosen))
    told = model.transform(feature_table(other_presence, other_labels, chosen))
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability").evaluate(told)
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    false = F.avg(F.when(F.col("label") == 0, F.col("prediction")))
    return told.agg(F.lit(area).alias("auc"), right.alias("accuracy"), false.alias("false_positive_rate"))
