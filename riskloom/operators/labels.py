"""A label store: blind labels, agreement, adjudication, export. Role filters are a convenience, not a security boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotators over the messages that both labelled; null without pairs or if chance agrees always."""
    pairs = labels.where(F.col("annotator_id") == a).select("message_id", F.col("is_scam").alias("x")).join(labels.where(F.col("annotator_id") == b).select("message_id", F.col("is_scam").alias("y")), "message_id")
    n = F.col("n").cast("double")
    got = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"), F.count_if("x").alias("px"), F.count_if("y").alias("py"))
    got = got.select("n", (F.col("same") / F.nullif(n, F.lit(0.0))).alias("po"), ((F.col("px") * F.col("py") + (n - F.col("px")) * (n - F.col("py"))) / F.nullif(n * n, F.lit(0.0))).alias("pe"))
    return got.select("n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))), 6).alias("kappa"))


def unanimous(labels: DataFrame) -> DataFrame:
    """Messages with two or more labels that agree."""
    return labels.groupBy("message_id").agg(F.count("*").alias("n"), F.min("is_scam").alias("low"), F.max("is_scam").alias("high")).where((F.col("n") >= 2) & (F.col("low") == F.col("high"))).select("message_id", F.col("low").alias("is_scam"))


def final_labels(messages: DataFrame, labels: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Each message's label and where it comes from: an adjudication, else agreement, else none yet."""
    adj = adjudications.select("message_id", F.col("is_scam").alias("adj"))
    una = unanimous(labels).withColumnRenamed("is_scam", "una")
    out = messages.select("message_id").join(adj, "message_id", "left").join(una, "message_id", "left")
    return out.select("message_id", F.coalesce("adj", "una").alias("is_scam"), F.when(F.col("adj").isNotNull(), "adjudicated").when(F.col("una").isNotNull(), "unanimous").otherwise("pending").alias("status"))


def needs_adjudication(labels: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Messages with two or more labels that differ and no adjudication."""
    split = labels.groupBy("message_id").agg(F.count("*").alias("n"), F.min("is_scam").alias("low"), F.max("is_scam").alias("high")).where((F.col("n") >= 2) & (F.col("low") != F.col("high")))
    return split.join(adjudications, "message_id", "left_anti").select("message_id", "n")


def export_rows(messages: DataFrame, splits: DataFrame, finals: DataFrame, stage: str) -> DataFrame:
    """Settled rows of a stage."""
    return messages.join(splits.where(F.col("stage") == stage).select("message_id"), "message_id").join(finals.where("status <> 'pending'"), "message_id")


def visible_labels(labels: DataFrame, role: str, who: str) -> DataFrame:
    """A labeler sees their own labels, an adjudicator all, anyone else none."""
    return labels.where(F.lit(role == "adjudicator") | (F.lit(role == "labeler") & (F.col("annotator_id") == who)))


def rejected(labels: DataFrame) -> DataFrame:
    """Rows that the store's constraints refuse: a repeated (message, annotator), or a category that contradicts the label."""
    again = labels.groupBy("message_id", "annotator_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_scam") == (F.col("attack_category") == "safe")).alias("bad"))
    return again.where("n > 1 or bad > 0").select("message_id", "annotator_id", F.when(F.col("n") > 1, "repeated").otherwise("contradiction").alias("reason"))


def disagreements(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys at which two implementations' results differ, or that only one has."""
    x = a.select(key, F.struct(*columns).alias("x"))
    y = b.select(key, F.struct(*columns).alias("y"))
    return x.join(y, key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(key)
