"""Column selection, scaling, folds and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def align(test: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The training columns of a test table, with a null label."""
    return test.select(*[c for c in columns if c != label], F.lit(None).cast("string").alias(label))


def center_scale(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns centred and scaled by train's mean and sample deviation; constant columns become null."""
    stats = train.agg(*[e for c in columns for e in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    rows = df.crossJoin(F.broadcast(stats))
    return rows.select(*[F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def fold_of(key: Column, k: int = 10, seed: int = 42) -> Column:
    """A row's fold from its key alone, so it doesn't depend on partitions."""
    return F.pmod(key.cast("bigint") * 7919 + seed, F.lit(k)).cast("int")


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


def _features(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def rf_cross_validated(df: DataFrame, key: str, vector: str, label: str, folds: int = 3, trees: int = 10, seed: int = 42) -> DataFrame:
    """fold, accuracy of a random forest trained on the other folds."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _features(df, vector).withColumn("__y", F.col(label).cast("double")).withColumn("fold", fold_of(F.col(key), folds, seed))
    out = None
    for k in range(folds):
        model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=5, seed=seed).fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).groupBy("fold").agg(accuracy(F.col("prediction"), F.col("__y")).alias("accuracy"))
        out = part if out is None else out.unionAll(part)
    return out


def gbt_one_vs_rest(df: DataFrame, key: str, vector: str, label: str, rounds: int = 2, seed: int = 42) -> DataFrame:
    """key, label, prediction of boosted trees, one binary model for each class."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    rows = _features(df, vector).withColumn("__y", F.col(label).cast("double"))
    model = OneVsRest(classifier=GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=seed), featuresCol="__x", labelCol="__y").fit(rows)
    return model.transform(rows).select(key, F.col("__y").alias("label"), "prediction")
