"""Validation of labelled-message rows: one error code for each rule a row breaks, statistics, stage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedup_key, let
from ..session import written
from .privacy import pii_flags

#: Enumerations of the labelled-message table. (Fixed values.)
LANGUAGES = ["en", "hi", "hinglish"]
CATEGORIES = ["upi_collect", "digital_arrest", "kyc_pan_block", "job_fraud", "electricity_disconnect", "investment_scam", "loan_app", "sextortion", "sim_swap", "other_scam", "safe"]
PLATFORMS = ["sms", "whatsapp", "telegram", "email", "social_media", "advisory_quote", "other"]
#: Least rows, shares (percent) and rows of each category for a stage. (Fixed values.)
STAGES = {"s0": {"rows": 200, "language": 15.0, "safe": 25.0, "obfuscated": 5.0, "category": 0}, "s1": {"rows": 1000, "language": None, "safe": 25.0, "obfuscated": 10.0, "category": 20}}
TARGET_MIX = {"en": 30.0, "hi": 40.0, "hinglish": 30.0}
TOLERANCE = 5.0


def real_date(c: Column, today: Column) -> Column:
    """An ISO date that exists and isn't after today."""
    return F.coalesce(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull() & (c <= today), F.lit(False))


def row_errors(df: DataFrame, today: str) -> DataFrame:
    """line and code for each broken rule. df: line and the eight columns, all strings. Repeats point at the first line."""
    c = F.col
    shape = c("id").rlike("^[A-Za-z0-9_-]+$")
    flags = pii_flags(c("raw_text_scrubbed"))
    rules = {
        "bad_id": ~shape, "short_text": F.length(F.trim("raw_text_scrubbed")) < 10,
        **{f"pii_{k}": v for k, v in flags.items()},
        "bad_language": ~c("language_tag").isin(*LANGUAGES), "bad_is_scam": ~c("is_scam").isin("0", "1"), "bad_category": ~c("attack_category").isin(*CATEGORIES),
        "scam_safe": (c("is_scam") == "1") & (c("attack_category") == "safe"), "safe_scam": (c("is_scam") == "0") & c("attack_category").isin(*CATEGORIES[:-1]),
        "bad_platform": ~c("source_platform").isin(*PLATFORMS), "bad_date": ~real_date(c("date_received"), F.lit(today)), "bad_obfuscation": ~c("contains_obfuscation").isin("true", "false"),
        "at_not_marked": c("raw_text_scrubbed").contains("@") & (c("contains_obfuscation") != "true"),
    }
    given = lambda rules: F.filter(F.array(*[F.when(v, k) for k, v in rules.items()]), lambda x: x.isNotNull())
    # What a row tells of itself is found in one reading of the texts; ids, digests of keys and codes go on.
    kept = written(df.select("line", "id", shape.alias("shape"), key_digest(c("raw_text_scrubbed")).alias("key"), given(rules).alias("codes")))
    # A row repeats an id or key unless it is the first line of it: least lines are combined before the shuffle, and rows meet them.
    first = lambda k: kept.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("line").alias(f"first_{k}"))
    marked = kept.join(first("id"), "id", "left").join(first("key"), "key", "left")
    again = {"duplicate_id": c("shape") & (c("line") > c("first_id")), "duplicate_text": c("line") > c("first_key")}
    return marked.select("line", F.explode(F.concat("codes", given(again))).alias("code"))


def key_digest(text: Column) -> Column:
    """The digest of a text's key, made once; null if the key has fewer than ten characters."""
    return let(dedup_key(text), lambda k: F.when(F.length(k) >= 10, F.unhex(F.sha2(k, 256))))


def dedup_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key's first id and the group's size, for texts whose key has ten characters or more."""
    # Written, as both sides of the join and the filters below it would each make the keys again.
    keyed = written(df.select(id_col, key_digest(F.col(text_col)).alias("key"))).where("key is not null")
    groups = keyed.groupBy("key").agg(F.min(id_col).alias("first_id"), F.count("*").alias("size"))
    return keyed.join(groups, "key").select(id_col, "first_id", "size")


def stage_problems(stats: DataFrame, stage: str) -> DataFrame:
    """What a dataset lacks for a stage. stats: one row of rows, safe, obfuscated, and maps language and category to counts."""
    cfg, c = STAGES[stage], F.col
    share = lambda n: 100 * n / F.nullif(c("rows"), F.lit(0))
    of = lambda m, k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(0))
    checks = [F.when(c("rows") < cfg["rows"], "rows")]
    for lang, target in TARGET_MIX.items():
        pct = share(of(c("language"), lang))
        checks.append(F.when(pct < cfg["language"] if cfg["language"] is not None else F.abs(pct - target) > TOLERANCE, f"language:{lang}"))
    if cfg["category"]:
        checks += [F.when(of(c("category"), k) < cfg["category"], f"category:{k}") for k in CATEGORIES[:-1]]
    checks += [F.when(share(c("safe")) < cfg["safe"], "safe"), F.when(share(c("obfuscated")) < cfg["obfuscated"], "obfuscated")]
    return stats.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))


def dominant_sources(df: DataFrame, source: str, share: float = 0.4, least: int = 50) -> DataFrame:
    """Sources with more than `share` of at least `least` rows."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("rows") >= least) & (F.col("n") > share * F.col("rows")))  # one row of totals


def next_id(df: DataFrame, id_col: str, prefix: str, width: int = 4) -> DataFrame:
    """The next id in sequence."""
    last = F.max(F.try_to_number(F.regexp_extract(id_col, f"^{prefix}([0-9]+)$", 1), F.lit("9999999999")).cast("long"))
    return df.agg(F.concat(F.lit(prefix), F.lpad((F.coalesce(last, F.lit(0)) + 1).cast("string"), width, "0")).alias("next_id"))


def statistics(df: DataFrame) -> DataFrame:
    """dim, value, n, first and last date of all rows and of each language, category, source and obfuscation mark, in one pass."""
    dims = ["language_tag", "attack_category", "source_platform", "contains_obfuscation"]
    day = F.try_to_date("date_received", "yyyy-MM-dd")
    got = df.select(*dims, day.alias("day")).groupingSets([[], *[[F.col(d)] for d in dims]], *dims).agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.grouping_id().alias("gid"))
    dim, value, most = F.lit("all"), F.lit("all"), len(dims)
    for i, d in enumerate(dims):
        own = F.col("gid") == (1 << most) - 1 - (1 << (most - 1 - i))
        dim, value = F.when(own, F.lit(d)).otherwise(dim), F.when(own, F.col(d)).otherwise(value)
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select(dim.alias("dim"), value.alias("value"), "n", text("first"), text("last"))


def external(df: DataFrame, id_col: str, text_col: str, label_col: str, positive: str, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of an outside corpus that may judge a detector, and how many are lost on the way.

    Texts with one key are one row, the first by id, and are dropped if their labels differ; excluded classes are dropped then.
    The rows: id, y. The counts: what, n. Keys go as digests.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.unhex(F.sha2(dedup_key(F.col(text_col)), 256)).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("label").alias("label"), F.max("label").alias("other"), F.min("id").alias("id"))
    clash, out = ~F.col("label").eqNullSafe(F.col("other")), F.col("label").isin(*excluded)
    kept = groups.where(~clash & ~out).select("id", (F.col("label") == positive).alias("y"))
    total = lambda c, k: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k)
    one = F.lit(1)
    counts = groups.agg(
        total("rows", "input"), total(F.when(clash, one), "conflicting_groups"), total(F.when(~clash, one), "after_conflicts_and_repeats"), total(F.when(~clash & out, one), "excluded"),
        total(F.when(~clash & ~out & (F.col("label") == positive), one), "positive"), total(F.when(~clash & ~out & (F.col("label") != positive), one), "negative"),
    )
    return kept, counts.unpivot([], counts.columns, "what", "n")
