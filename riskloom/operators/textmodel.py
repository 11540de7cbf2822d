"""Splits by hash, and a naive Bayes text model in relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_share(key: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on salt and key only."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split(key: Column, salt: str, train: float = 0.6, validation: float = 0.2) -> Column:
    """train, validation or test; equal keys share a side."""
    h = hash_share(key, salt)
    return F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test")


def words(text: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0)))


def marks(text: Column) -> Column:
    """Flags and a length bucket, with names that no word has."""
    flags = F.filter(F.array(
        F.when(text.rlike("(?i)https?://|www[.]"), "#link"), F.when(text.rlike("[0-9]{5,}"), "#digits"), F.when(text.rlike("[£$₹]"), "#money"), F.when(text.contains("!"), "#shout"),
    ), lambda x: x.isNotNull())
    bucket = F.concat(F.lit("#len"), F.least(F.lit(9), F.floor(F.length(text) / 200)).cast("string"))
    return F.array_union(flags, F.array(bucket))


def features(text: Column) -> Column:
    """Distinct words of two letters or more, flags, and a length bucket."""
    return F.array_union(words(text), marks(text))


def ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Distinct character n-grams."""
    t = F.lower(text)
    # One pass of a pattern that looks ahead at each character: time grows with the text, not with its square.
    of = lambda n: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(low, high + 1)])))


def weights(rows: DataFrame, text: Column, positive: Column, least: int = 5) -> DataFrame:
    """feature, pos, neg, weight: log ratio of smoothed document shares, for features of `least` documents or more."""
    base = rows.select(text.alias("t"), positive.alias("y"))
    totals = base.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    each = base.select("y", F.explode(features(F.col("t"))).alias("feature")).groupBy("feature").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    kept = each.where(F.col("pos") + F.col("neg") >= least).crossJoin(F.broadcast(totals))  # one row of totals
    ratio = F.log((F.col("pos") + 1) / (F.col("p") + 2)) - F.log((F.col("neg") + 1) / (F.col("n") + 2))
    return kept.select("feature", "pos", "neg", F.round(ratio, 3).alias("weight"))


def scores(rows: DataFrame, id_col: str, text: Column, model: DataFrame, bias: Column | None = None) -> DataFrame:
    """id and the sum of its features' weights."""
    each = rows.select(id_col, F.explode(features(text)).alias("feature"))
    return each.join(model.select("feature", "weight"), "feature", "left").groupBy(id_col).agg(F.round(F.coalesce(F.sum("weight"), F.lit(0.0)) + (bias if bias is not None else F.lit(0.0)), 3).alias("score"))


def vocabulary(rows: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """feature and its number of documents, from `least` on."""
    return rows.select(F.explode(features(text)).alias("feature")).groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def select_winner(candidates: DataFrame, most_bytes: int, least_precision: float) -> DataFrame:
    """The candidate (name, bytes, precision_lo, recall, tp, fp) of best recall among those within size whose precision is proven to
    reach the floor; ties go to the smaller, then by name. No row if there is none."""
    ok = (F.col("bytes") <= most_bytes) & (F.col("tp") + F.col("fp") > 0) & (F.col("precision_lo") >= least_precision)
    return candidates.where(ok).orderBy(F.desc("recall"), "bytes", "name").limit(1)


def folds(key: Column, salt: str, n: int = 5) -> Column:
    """A fold from 0 to n - 1; equal keys share one."""
    return F.floor(hash_share(key, salt) * n).cast("int")
