"""The awareness survey: rules for its rows, shares with bounds, distributions and the gain of a talk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .dataset import real_date
from .privacy import small_cells

QUESTIONS = ["q1", "q2", "q3", "q4", "q5"]
#: Allowed values of each column. (Fixed values.)
ALLOWED = {
    "respondent_type": ["household", "shop"],
    "age_band": ["18-29", "30-44", "45-59", "60+"],
    "gender": ["f", "m", "o", "na"],
    "education": ["none", "primary", "secondary", "degree"],
    "occupation": ["farm", "labour", "shop", "salaried", "student", "homemaker", "retired", "other"],
    "language": ["te", "en", "hi", "ur", "other"],
    "phone": ["smartphone", "keypad", "none"],
    "uses_upi": ["y", "n"],
    "suspicious_contact": ["y", "n"],
    "lost_money": ["y", "n"],
    "amount_band": ["none", "under_1k", "1k_10k", "10k_1l", "over_1l"],
    "reported_to": ["na", "none", "bank", "1930", "police", "portal", "multiple"],
    "reported_when": ["na", "same_day", "within_3_days", "later", "never"],
    "family_victim": ["y", "n"],
    "channel": ["voice_note", "in_person", "poster", "video", "school", "other"],
    "consent_verbal": ["y", "n"],
    "talk_given": ["y", "n"],
}


def row_errors(df: DataFrame, today: str) -> DataFrame:
    """Rows (with their `line`) and `errors`, the names of the rules each breaks, joined by semicolons in the rules' order; a null breaks its column's rule.

    Of rows with one id, those after the first line are repeats. First lines come from an aggregate, so a frequent id makes no
    large group.
    """
    first = df.where(F.col("id").rlike(r"^S-\d{3,}$")).groupBy("id").agg(F.min("line").alias("_first"))
    c = F.col
    quiz = [(f"pre_{q}", c(f"pre_{q}").isin("0", "1")) for q in QUESTIONS]
    quiz += [(f"post_{q}", F.when(c("talk_given") == "y", c(f"post_{q}").isin("0", "1")).otherwise(c(f"post_{q}") == "")) for q in QUESTIONS]
    filled = (c("amount_band") != "none") & (c("reported_to") != "na") & (c("reported_when") != "na")
    untouched = (c("amount_band") == "none") & (c("reported_to") == "na") & (c("reported_when") == "na")
    rules = [
        ("id", c("id").rlike(r"^S-\d{3,}$")), ("repeat", c("_first").isNull() | (c("line") == c("_first"))), ("date", real_date(c("date"), F.lit(today))),
        ("surveyor", c("surveyor").rlike("^[A-Za-z]{2,4}$")), ("area", c("area").rlike("^[A-Za-z][A-Za-z .-]{1,38}$")),
        *[(name, c(name).isin(*values)) for name, values in ALLOWED.items()],
        ("consent", c("consent_verbal") == "y"), *quiz,
        ("loss_unfilled", (c("lost_money") != "y") | filled), ("loss_filled", (c("lost_money") != "n") | untouched),
        ("never_reported", (c("reported_to") != "none") | (c("reported_when") == "never")),
    ]
    found = F.concat_ws(";", *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return df.join(first, "id", "left").withColumn("errors", found).drop("_first")


def shares(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """measure, k, n, value, lo, hi for each measure, in one pass over the rows."""
    totals = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"k_{name}") for name, c in measures.items()])
    long = totals.select("n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"k_{m}").alias("k")) for m in measures])).alias("x")).select("x.measure", "x.k", "n")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return long.select("measure", "k", "n", F.round(stats.ratio(F.col("k"), F.col("n")), 6).alias("value"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def summary(df: DataFrame) -> DataFrame:
    """The report's shares."""
    return shares(df, {
        "smartphone": F.col("phone") == "smartphone", "uses_upi": F.col("uses_upi") == "y", "suspicious_contact": F.col("suspicious_contact") == "y",
        "lost_money": F.col("lost_money") == "y", "family_victim": F.col("family_victim") == "y", "knows_helpline": F.col("pre_q4") == "1",
    })


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """measure, value, n and `shown`, where counts from 1 to 4 are hidden; one shuffle for all columns."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return each.groupBy("measure", "value").agg(F.count("*").alias("n")).withColumn("shown", small_cells(F.col("n")))


def gain(df: DataFrame) -> DataFrame:
    """For each question, over those who attended a talk: right before and after, learned, slipped and the exact test's p."""
    talk = df.where(F.col("talk_given") == "y")
    pre, post = {q: F.col(f"pre_{q}") == "1" for q in QUESTIONS}, {q: F.col(f"post_{q}") == "1" for q in QUESTIONS}
    aggs = [F.count("*").alias("n")]
    for q in QUESTIONS:
        aggs += [F.count_if(pre[q]).alias(f"a_{q}"), F.count_if(post[q]).alias(f"b_{q}"), F.count_if(~pre[q] & post[q]).alias(f"c_{q}"), F.count_if(pre[q] & ~post[q]).alias(f"d_{q}")]
    row = lambda q: F.struct(F.lit(q).alias("question"), *[F.col(f"{x}_{q}").alias(y) for x, y in zip("abcd", ("right_before", "right_after", "learned", "slipped"))])
    long = talk.agg(*aggs).select("n", F.explode(F.array(*[row(q) for q in QUESTIONS])).alias("x")).select("n", "x.*")
    return long.withColumn("p", F.round(stats.mcnemar(F.col("learned"), F.col("slipped")), 6))


def mean_scores(df: DataFrame) -> DataFrame:
    """Attendees and their mean score before and after."""
    score = lambda side: reduce(lambda a, b: a + b, [F.col(f"{side}_{q}").cast("int") for q in QUESTIONS])
    talk = df.where(F.col("talk_given") == "y")
    return talk.agg(F.count("*").alias("attended"), F.round(F.avg(score("pre")), 6).alias("mean_before"), F.round(F.avg(score("post")), 6).alias("mean_after"))
