"""Statistics for evaluating detectors, as Column expressions and small aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def ratio(k: Column, n: Column) -> Column:
    """k / n; null where n is 0."""
    return F.when(n != 0, k / F.when(n != 0, n))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval for k of n, within 0 and 1; null where n is 0."""
    p, d = ratio(k, n), 1 + ratio(F.lit(z * z), n)
    centre = (p + ratio(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z), 4 * n * n)) / d
    return F.when(n != 0, F.greatest(F.lit(0.0), centre - half)), F.when(n != 0, F.least(F.lit(1.0), centre + half))


def precision_at(recall: Column, false_alarm: Column, prevalence: Column) -> Column:
    """Share of true cases among the flagged at a prevalence; 0 where nothing is flagged."""
    tp, fp = recall * prevalence, false_alarm * (1 - prevalence)
    return F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / F.when(tp + fp != 0, tp + fp))


def negatives_needed(recall_low: Column, least_precision: float, prevalence: float, z: float = Z) -> Column:
    """How many negatives, none flagged, prove the precision at the prevalence; null where recall_low is 0."""
    f = recall_low * (prevalence * (1 - least_precision) / (least_precision * (1 - prevalence)))
    return F.when(recall_low > 0, F.ceil(z * z * (1 / F.when(recall_low > 0, f) - 1)))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs. Terms of the binomial tail follow one from the other by logarithms."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda a, i: F.struct(
        (a["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("term"),
        (a["sum"] + F.exp(a["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("sum"),
    )
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), zero, step)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail["sum"]))


def psi(counts: DataFrame, expected: str, actual: str, floor: float = 1e-4) -> DataFrame:
    """Population stability index of two count columns over the rows (buckets); null if either side is empty."""
    both = counts.agg(F.sum(expected).alias("_e"), F.sum(actual).alias("_a"))
    shares = counts.crossJoin(F.broadcast(both)).select(  # one row of totals
        F.greatest(ratio(F.col(expected), F.col("_e")), F.lit(floor)).alias("pe"), F.greatest(ratio(F.col(actual), F.col("_a")), F.lit(floor)).alias("pa"), "_e", "_a"
    )
    return shares.agg(F.when((F.max("_e") > 0) & (F.max("_a") > 0), F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe")))).alias("psi"))


def running(counts: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """counts with each sum (new name: column) over the rows up to and with each one in order of `order`, which is unique.

    Rows are dealt into stretches of the order by cuts of its quantiles, as many as there are shuffle partitions; each stretch is
    summed by itself, and the stretches' totals (a row each) are added.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(order).cast("timestamp") if counts.schema[order].dataType.typeName() in ("timestamp_ntz", "date") else F.col(order)
    place = counts.withColumn("_x", x.cast("double"))
    cuts = sorted(set(place.approxQuantile("_x", [i / n for i in range(1, max(2, n))], 0.01))) or [0.0]
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_x", outputCol="_part", handleInvalid="keep").transform(place)
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    within = Window.partitionBy("_part").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])  # at most n + 1 rows
    own = dealt.withColumns({k: F.sum(c).over(within) for k, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return own.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_x", "_part", *[f"_{k}" for k in sums])


def auc(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null without positives or negatives. Rows meet as counts of each score."""
    by = by or []
    counts = df.groupBy(*by, score.alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0))) if by else running(counts, "score", {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return below.groupBy(*by).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), wins / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def floor_rank(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The value with floor(q n) values before it (the last one at most), for each group; ranks come from counts of each value."""
    return _at_rank(df, value, by or [], lambda n: F.least(n, F.floor(q * n) + 1))


def ceil_rank(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The value at place ceil(q n), for each group."""
    return _at_rank(df, value, by or [], lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(q * n))))


def _at_rank(df: DataFrame, value: str, by: list[str], place) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    each = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(each)) if by else running(counts, value, {"upto": "n"})
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = upto.join(total, by) if by else upto.crossJoin(F.broadcast(total))  # one row of totals
    return joined.where(F.col("upto") >= place(F.col("total"))).groupBy(*by).agg(F.min(value).alias(value))


def confusion(df: DataFrame, flagged: Column, positive: Column, by: list | None = None) -> DataFrame:
    """tp, fp, fn, tn of each group."""
    return df.groupBy(*(by or [])).agg(
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"), F.count_if(~flagged & ~positive).alias("tn"),
    )


def rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """counts (tp, fp, fn, tn) with precision, recall and false-alarm rate and their bounds. Precision without flags is 0, and said."""
    out = counts
    for name, k, n in (("precision", F.col("tp"), F.col("tp") + F.col("fp")), ("recall", F.col("tp"), F.col("tp") + F.col("fn")), ("fpr", F.col("fp"), F.col("fp") + F.col("tn"))):
        lo, hi = wilson(k, n)
        value = ratio(k, n)
        out = out.withColumns({name: F.round(F.coalesce(value, F.lit(0.0)) if name == "precision" else value, digits), f"{name}_lo": F.round(lo, digits), f"{name}_hi": F.round(hi, digits)})
    return out.withColumn("flags_nothing", (F.col("tp") + F.col("fp")) == 0)
