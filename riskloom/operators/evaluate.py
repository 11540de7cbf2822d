"""Evaluation of detectors: confusion by slices, prevalence, thresholds, drift, comparison, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

PREVALENCES = [0.01, 0.05, 0.2, 0.5]
FEW = 30
#: The release policy. (Fixed values.)
POLICY = {"least_precision": 0.90, "prevalence": 0.01, "most_p95_ms": 50.0, "regression_alpha": 0.05, "near_jaccard": 0.85, "most_model_bytes": 250_000}


def slices(df: DataFrame, flagged: Column, positive: Column, dims: list[str]) -> DataFrame:
    """One pass over all rows and over each dimension's values: slice_dim, slice_value, confusion, rates, underpowered."""
    marked = df.select(*dims, flagged.alias("flagged"), positive.alias("positive"))
    marked = marked.groupingSets([[], *[[F.col(d)] for d in dims]], *dims).agg(
        F.count_if(F.col("flagged") & F.col("positive")).alias("tp"), F.count_if(F.col("flagged") & ~F.col("positive")).alias("fp"),
        F.count_if(~F.col("flagged") & F.col("positive")).alias("fn"), F.count_if(~F.col("flagged") & ~F.col("positive")).alias("tn"), F.grouping_id().alias("gid"),
    )
    n = len(dims)
    dim, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        own = F.col("gid") == (1 << n) - 1 - (1 << (n - 1 - i))
        dim, value = F.when(own, F.lit(d)).otherwise(dim), F.when(own, F.col(d).cast("string")).otherwise(value)
    out = stats.rates(marked.select(dim.alias("slice_dim"), value.alias("slice_value"), "tp", "fp", "fn", "tn"))
    return out.withColumn("underpowered", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") < FEW)


def at_prevalences(rated: DataFrame, prevalences: list[float] = PREVALENCES) -> DataFrame:
    """Each rated row at each prevalence: precision, and in the worst case (least recall, most false alarms)."""
    out = rated.withColumn("prevalence", F.explode(F.array(*[F.lit(p) for p in prevalences])))
    return out.withColumn("point", F.round(stats.precision_at(F.col("recall"), F.col("fpr"), F.col("prevalence")), 6)).withColumn(
        "conservative", F.round(stats.precision_at(F.col("recall_lo"), F.col("fpr_hi"), F.col("prevalence")), 6)
    )


def compare(df: DataFrame, candidate: Column, baseline: Column, truth: Column) -> DataFrame:
    """Discordant pairs of two detectors' right answers and the exact test's p."""
    counts = df.agg(F.count_if((candidate == truth) & (baseline != truth)).alias("candidate_only"), F.count_if((baseline == truth) & (candidate != truth)).alias("baseline_only"))
    return counts.withColumn("better", F.col("candidate_only") - F.col("baseline_only")).withColumn("p", F.round(stats.mcnemar(F.col("candidate_only"), F.col("baseline_only")), 6))


def drift(df: DataFrame, bucket: str, order: list[str], least: int = 40) -> DataFrame:
    """PSI of a bucket's shares between the halves by order; not measured below `least` rows.

    The halves are cut at a rank; ranks come from counts of each order value, so no single task sees all rows, and only ties at
    the cut are numbered one by one.
    """
    first = order[0]
    n = df.agg(F.count("*").alias("total"))
    per = df.groupBy(first).agg(F.count("*").alias("c"))
    upto = stats.running(per, first, {"upto": "c"}).select(first, (F.col("upto") - F.col("c")).alias("before"))
    w = Window.partitionBy(first).orderBy(*order[1:])
    ranked = df.join(upto, first).withColumn("rank", F.col("before") + F.row_number().over(w)).crossJoin(F.broadcast(n))  # one row
    counts = ranked.groupBy(bucket).agg(F.count_if(F.col("rank") <= F.floor(F.col("total") / 2)).alias("e"), F.count_if(F.col("rank") > F.floor(F.col("total") / 2)).alias("a"))
    out = stats.psi(counts, "e", "a").crossJoin(F.broadcast(n))
    return out.select("total", F.when(F.col("total") >= least, F.round("psi", 6)).alias("psi"), (F.col("total") >= least).alias("measured"))


def pick_threshold(df: DataFrame, score: Column, positive: Column, target: float) -> DataFrame:
    """The threshold of best recall whose precision's lower bound reaches the target; ties go to the higher one."""
    counts = df.groupBy(score.alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    total = counts.agg(F.sum("p").alias("positives"))
    run = stats.running(counts, "threshold", {"tp": "p", "fp": "n"}, descending=True).select("threshold", "tp", "fp").crossJoin(F.broadcast(total))  # one row
    lo, _ = stats.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    ok = run.withColumn("lo", lo).where(F.col("lo") >= target)
    best = ok.agg(F.max_by(F.struct("threshold", "tp", "fp", "positives", "lo"), F.struct("tp", "threshold")).alias("b")).where("b is not null")
    return best.select("b.threshold", "b.tp", "b.fp", F.round(F.col("b.tp") / F.col("b.positives"), 6).alias("recall"), F.round("b.lo", 6).alias("precision_lo"))


def adjusted(rated: DataFrame, policy: dict = POLICY) -> DataFrame:
    """rated rows with the verdict on precision at the policy's prevalence: met, unproven or failed."""
    at = at_prevalences(rated, [policy["prevalence"]])
    least = policy["least_precision"]
    verdict = F.when(F.col("recall").isNull() | F.col("fpr").isNull() | (F.col("point") < least), "failed").when(F.col("conservative") >= least, "met").otherwise("unproven")
    return at.withColumn("verdict", verdict)


def gate(rated: DataFrame, evidence: Column, p95_ms: Column, leaked: Column, better: Column, p: Column, policy: dict = POLICY) -> DataFrame:
    """The release decision: NO_EVIDENCE, FAIL, INCONCLUSIVE or PASS. FAIL outweighs INCONCLUSIVE."""
    at = adjusted(rated, policy)
    failed = F.col("flags_nothing") | (F.col("tp") == 0) | (F.col("verdict") == "failed") | (p95_ms > policy["most_p95_ms"]) | (leaked > 0) | ((better < 0) & (p < policy["regression_alpha"]))
    return at.withColumn("status", F.when(~evidence, "NO_EVIDENCE").when(failed, "FAIL").when(F.col("verdict") == "unproven", "INCONCLUSIVE").otherwise("PASS"))
