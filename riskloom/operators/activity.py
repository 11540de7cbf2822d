"""What the tool is doing: events with named fields only, counts, frequent rules, latency against its budget, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds and levels an event may have. (Fixed values.)
KINDS = ["message", "link", "qr", "ocr", "followup", "faq", "unanswered", "voice", "error", "model"]
LEVELS = ["scam", "suspicious", "unverified", "official", "nothing"]
SLUG = "^[a-z][a-z0-9-]{0,31}$"
BUDGET_MS, LEAST_SAMPLES, CAPACITY, MOST_RULES, MOST_MS = 50.0, 5, 300, 12, 600_000


def known(c: Column, allowed: list[str] | None) -> Column:
    """A slug; one that is not in the list is `other`; null for anything that is no slug."""
    slug = F.when(c.rlike(SLUG), c)
    return slug if allowed is None else F.when(slug.isNotNull() & ~slug.isin(*allowed), "other").otherwise(slug)


def clean(df: DataFrame, families: list[str] | None = None, rules: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """event_id, ts and only the named fields of events (kind, level, family, rules, ms, code); rows of an unknown kind go.

    Times are cut to the minute, milliseconds rounded to hundredths and limited to ten minutes, rules to the first twelve known.
    """
    ms = F.col("ms").cast("double")
    ok = F.transform(F.col("rules"), lambda x: known(x, rules))
    return df.where(F.col("kind").isin(*KINDS)).select(
        "event_id", F.date_trunc("minute", "ts").cast(df.schema["ts"].dataType).alias("ts"), "kind", F.when(F.col("level").isin(*LEVELS), F.col("level")).alias("level"), known(F.col("family"), families).alias("family"),
        F.slice(F.filter(ok, lambda x: x.isNotNull()), 1, MOST_RULES).alias("rules"),
        F.when((ms >= 0) & ~F.isnan(ms) & (ms != float("inf")), F.least(F.floor(ms * 100 + 0.5) / 100, F.lit(float(MOST_MS)))).alias("ms"), known(F.col("code"), codes).alias("code"),
    )


def summary(events: DataFrame) -> DataFrame:
    """section, key, n: events by kind, level, family, rule and error code, in one shuffle of pre-summed counts."""
    judged = F.col("kind").isin("message", "link", "qr")
    entry = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    error = F.when((F.col("kind") == "error") | ((F.col("kind") == "model") & F.col("code").isNotNull()), F.coalesce("code", F.lit("unknown")))
    single = F.array(entry("kind", F.col("kind")), entry("level", F.when(judged, F.col("level"))), entry("family", F.when(judged, F.col("family"))), entry("error", error))
    per_rule = F.when(judged, F.transform("rules", lambda r: entry("rule", r)))
    entries = F.concat(single, F.coalesce(per_rule, F.array().cast("array<struct<section:string,key:string>>")))
    return events.select(F.explode(F.filter(entries, lambda x: x["key"].isNotNull())).alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n"))


def flagged_share(events: DataFrame) -> DataFrame:
    """Verdicts and the share of them that are scam or suspicious, to three digits; null without verdicts."""
    judged = events.where(F.col("kind").isin("message", "link", "qr"))
    return judged.agg(F.count("*").alias("verdicts"), F.count_if(F.col("level").isin("scam", "suspicious")).alias("_f")).select(
        "verdicts", F.when(F.col("verdicts") > 0, F.floor(1000 * F.col("_f") / F.nullif(F.col("verdicts"), F.lit(0)) + 0.5) / 1000).alias("flagged_share")
    )


def top_rules(events: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent rules, ties by name: the report's limit."""
    return summary(events).where("section = 'rule'").select(F.col("key").alias("rule"), "n").orderBy(F.desc("n"), "rule").limit(n)


def latest(events: DataFrame, n: int = CAPACITY) -> DataFrame:
    """The last n events, the buffer's size."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def latency(events: DataFrame) -> DataFrame:
    """samples, p50, p95, p99 (the value with floor(q n) before it), the greatest, and the state of the service level.

    Events meet as counts of each value, ranked within whole milliseconds; only the at most 600,001 counts of whole milliseconds
    meet in one task.
    """
    values = events.where(F.col("kind").isin("message", "link") & F.col("ms").isNotNull()).groupBy(F.floor("ms").alias("b"), "ms").agg(F.count("*").alias("n"))
    per = values.groupBy("b").agg(F.sum("n").alias("c"))
    before = per.select("b", (F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    upto = values.join(before, "b").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.least(F.col("samples"), F.floor(q * F.col("samples")) + 1), F.col("ms")))
    out = upto.crossJoin(F.broadcast(total)).agg(F.coalesce(F.max("samples"), F.lit(0)).alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("ms").alias("most"))
    status = F.when(F.col("samples") < LEAST_SAMPLES, "not-enough-data").when(F.col("p95") <= BUDGET_MS, "met").otherwise("breached")
    return out.withColumn("status", status)


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int = 60) -> DataFrame:
    """key, began, ended, events of runs without a pause of gap_minutes or more.

    Rows are summed to minutes first: a pause within a minute is never a break, and a key's window then grows with minutes, not rows.
    """
    minutes = df.groupBy(key, F.to_date(ts).alias("_d"), F.hour(ts).alias("_h"), F.minute(ts).alias("_m")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_a")
    pause = F.col("_a") - F.lag("_b").over(w)
    opens = F.when(pause.isNull() | (pause >= F.make_dt_interval(mins=F.lit(gap_minutes))), 1).otherwise(0)
    run = minutes.withColumn("_o", opens).withColumn("_s", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_s").agg(F.min("_a").alias("began"), F.max("_b").alias("ended"), F.sum("_n").alias("events")).drop("_s")
