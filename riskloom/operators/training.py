"""Trained models: logistic regression on text features, Platt scaling, and the spread of an AUC over resamples."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import textmodel

WIDTH = 1 << 14
#: Chances that a Poisson(1) number is at most 0, 1, 2, ... (e^-1 times partial sums of 1/k!); beyond 8 is rarer than 1 in a million.
UP_TO = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887]


def hashed(df: DataFrame, text: Column, width: int = WIDTH) -> DataFrame:
    """df with a sparse vector `features` of the text's distinct features; null texts have only the empty text's."""
    each = df.withColumn("_f", textmodel.features(F.coalesce(text, F.lit(""))))
    return HashingTF(numFeatures=width, binary=True, inputCol="_f", outputCol="features").transform(each).drop("_f")


def fit(rows: DataFrame, label: Column, penalty: float = 0.001, rounds: int = 30) -> LogisticRegressionModel:
    """A model on `features`; rows stay spread, each round sums gradients of WIDTH numbers."""
    data = rows.select("features", label.cast("double").alias("label")).where("label is not null")
    return LogisticRegression(regParam=penalty, maxIter=rounds, standardization=False).fit(data)


def scored(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """rows with `score`, the chance of label 1."""
    return model.transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")


def platt(rows: DataFrame, score: Column, label: Column) -> tuple[float, float]:
    """Slope and offset that turn a raw score into a chance."""
    data = rows.select(array_to_vector(F.array(score.cast("double"))).alias("features"), label.cast("double").alias("label"))
    model = LogisticRegression(regParam=0.0, maxIter=50).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def threshold_at(rows: DataFrame, score: Column, positive: Column, most_false: float) -> DataFrame:
    """The threshold just above the score with ceil(n (1 - most_false)) negatives before it (the last at most)."""
    counts = rows.where(~positive).groupBy(score.alias("s")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    upto = stats.running(counts, "s", {"upto": "c"}).crossJoin(F.broadcast(total))  # one row
    return upto.where(F.col("upto") >= F.least(F.col("n"), F.ceil(F.col("n") * (1 - most_false)) + 1)).agg((F.min("s") + 1e-9).alias("threshold"))


def bootstrap_auc(rows: DataFrame, key: Column, score: Column, positive: Column, reps: int = 200, seed: int = 1) -> DataFrame:
    """rep and auc: each row counts a Poisson(1) number of times in each resample, drawn from a hash of key, rep and seed.

    Rows meet as sums for each resample and score, combined before the shuffle.
    """
    each = rows.select(key.alias("k"), score.alias("s"), positive.alias("y")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = F.pmod(F.xxhash64("k", "rep", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = F.lit(0)
    for share in UP_TO:
        drawn = drawn + (u >= share).cast("int")
    counts = each.withColumn("w", drawn).where("w > 0").groupBy("rep", "s").agg(F.sum(F.when(F.col("y"), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("y"), F.col("w")).otherwise(0)).alias("n"))
    below = counts.withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pairs = F.sum("p").cast("double") * F.sum("n")
    return below.groupBy("rep").agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(pairs, F.lit(0.0))).alias("auc"))
