"""The library's own detectors over messages, one boolean column each, and how they compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import link_in
from . import evaluate, links, messages

NAMES = ["always", "never", "router", "message_flagged", "message_scam", "link_lenient", "link_strict", "either", "both"]


def flags(df: DataFrame, text_col: str, rules_col: str | None = None) -> DataFrame:
    """df with a column for each of NAMES. rules_col: what the rules and the router read, if not the text.

    router: some intent's words occur. message_*: the rules' level is not `nothing`, or is `scam`. link_*: the first link's level is
    suspicious or worse, or is `scam`; a message without a link is not flagged. either, both: of message_flagged and link_lenient.
    """
    router = messages.intent_of(F.col("prepared")).isNotNull()
    judged = lambda rows: messages.verdict(rows, rules_col or text_col).withColumn("__router", router).drop("prepared", "tokens", "evidence", "score", "family").withColumnRenamed("level", "__message")
    d = links.with_levels(df.withColumn("__link", link_in(F.col(text_col))), "__link", "__level", judged).withColumn("__level", F.coalesce("__level", F.lit("none")))
    flagged, lenient = F.col("__message") != "nothing", F.col("__level").isin("scam", "suspicious")
    made = {
        "always": F.lit(True), "never": F.lit(False), "router": F.col("__router"), "message_flagged": flagged, "message_scam": F.col("__message") == "scam",
        "link_lenient": lenient, "link_strict": F.col("__level") == "scam", "either": flagged | lenient, "both": flagged & lenient,
    }
    return d.withColumns({k: F.coalesce(made[k], F.lit(False)) for k in NAMES}).drop("__link", "__message", "__level", "__router")


def long(flagged: DataFrame, truth: str, names: list[str] | None = None) -> DataFrame:
    """detector, flagged and truth: each row of `flagged` once for each detector."""
    return flagged.select(truth, *(names or NAMES)).unpivot([truth], names or NAMES, "detector", "flagged")


def rated(flagged: DataFrame, truth: str, names: list[str] | None = None) -> DataFrame:
    """detector, confusion and rates with their bounds, in one pass over the rows."""
    y, hit = F.col(truth), F.col("flagged")
    counts = long(flagged, truth, names).groupBy("detector").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return stats.rates(counts)


def against(flagged: DataFrame, truth: str, baseline: str, names: list[str] | None = None) -> DataFrame:
    """detector, candidate_only, baseline_only, better and p: each detector's right answers against the baseline's, row by row."""
    own = [n for n in (names or NAMES) if n != baseline]
    # One pass: the counts of all detectors side by side, then one row each.
    right = lambda n: F.col(n) == F.col(truth)
    counts = flagged.agg(*[F.count_if(right(n) & ~right(baseline)).alias(f"{n}|c") for n in own], *[F.count_if(~right(n) & right(baseline)).alias(f"{n}|b") for n in own])
    rows = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"{n}|c").alias("candidate_only"), F.col(f"{n}|b").alias("baseline_only")) for n in own])
    each = counts.select(F.explode(rows).alias("r")).select("r.*")
    return each.withColumn("better", F.col("candidate_only") - F.col("baseline_only")).withColumn("p", F.round(stats.mcnemar(F.col("candidate_only"), F.col("baseline_only")), 6))


def released(flagged: DataFrame, truth: str, detector: str, baseline: str, p95_ms: float, leaked: int = 0, least_rows: int = 100, policy: dict = evaluate.POLICY) -> DataFrame:
    """One detector's report and the gate's decision on it: confusion, rates, precision at the policy's prevalence, comparison, status."""
    own = rated(flagged, truth, [detector]).drop("detector")
    other = against(flagged, truth, baseline, [detector, baseline]).select("better", "p")
    both = own.crossJoin(other)  # one row each
    n = reduce(lambda a, b: a + b, [F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return evaluate.gate(both, n >= least_rows, F.lit(p95_ms), F.lit(leaked), F.col("better"), F.col("p"), policy).withColumn("detector", F.lit(detector))
