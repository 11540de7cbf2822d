"""A linear model of domain names: features, hashed n-grams, bins, scores, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, urls

BUCKETS = 1 << 14
KEYWORDS = ["account", "bank", "free", "login", "offer", "pay", "secure", "update", "verify", "win"]


def name_of(registrable: Column) -> Column:
    return F.element_at(F.split(registrable, "[.]"), 1)


def ending_of(registrable: Column) -> Column:
    return F.array_join(F.slice(F.split(registrable, "[.]"), F.lit(2), F.size(F.split(registrable, "[.]"))), ".")


def numbers(name: Column, registrable: Column) -> dict[str, Column]:
    """What can be counted of a name."""
    n = F.length(name)
    runs = lambda p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(name, F.lit(p), F.lit(0)), F.length)), F.lit(0))
    count = lambda p: F.regexp_count(name, F.lit(p))
    chars = F.filter(F.split(name, ""), lambda x: x != "")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.nullif(n, F.lit(0))
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))
    return {
        "length": n, "digits": count("[0-9]"), "digit_share": F.coalesce(count("[0-9]") / F.nullif(n, F.lit(0)), F.lit(0.0)), "hyphens": count("-"), "entropy": entropy,
        "vowel_share": F.coalesce(count("[aeiou]") / F.nullif(count("[a-z]"), F.lit(0)), F.lit(0.0)), "letter_run": runs("[a-z]+"), "digit_run": runs("[0-9]+"),
        "consonant_run": runs("[bcdfghjklmnpqrstvwxyz]+"), "distinct": F.size(F.array_distinct(chars)), "parts": count("[^-]+"),
        "keywords": sum((F.when(name.contains(k), 1).otherwise(0) for k in KEYWORDS), F.lit(0)), "starts_digit": name.rlike("^[0-9]").cast("int"),
        "suffix_labels": F.size(F.split(registrable, "[.]")) - 1, "suffix_length": F.length(ending_of(registrable)),
    }


def grams(name: Column, low: int = 1, high: int = 5) -> Column:
    """Distinct n-grams of ^name$."""
    t = F.concat(F.lit("^"), name, F.lit("$"))
    of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substr(t, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of)))


def buckets(name: Column, n: int = BUCKETS) -> Column:
    """Distinct hash buckets of the n-grams."""
    return F.array_distinct(F.transform(grams(name), lambda g: urls.fnv1a(g) % n))


def in_scope(df: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows (host, registrable) with a plain ASCII name with letters, no address and not under a hosting platform (registrable)."""
    host = F.col("host")
    plain = df.where(host.rlike("^[a-z0-9.-]+$") & host.rlike("[a-z]") & host.contains(".") & ~host.rlike("^(?:0x[0-9a-f]+|[0-9]+)(?:[.](?:0x[0-9a-f]+|[0-9]+))*$"))
    return plain.join(platforms.select("registrable").distinct(), "registrable", "left_anti")


def ranked(df: DataFrame, key: str, by: str, salt: str = "rank") -> DataFrame:
    """key, by and rank (from 1) by descending `by` (whole numbers); ties in the order of a hash of salt and key, the greater first.

    Ranks are running sums over stretches of the order, so no task sees all rows.
    """
    h = F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256)
    part = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(15,0)")
    order = (F.col(by).cast("decimal(22,0)") * F.lit(1 << 48).cast("decimal(15,0)")).cast("decimal(38,0)") + part(1)
    rows = df.select(key, by, order.cast("decimal(38,0)").alias("__order"), F.lit(1).alias("__one"))
    return stats.running(rows, "__order", {"rank": "__one"}, descending=True).select(key, by, F.col("rank").cast("long").alias("rank"))


def rank_bands(rows: DataFrame, key: str, bands: list[tuple[int, int, int]], salt: str = "draw") -> DataFrame:
    """key, rank and band of n rows of each band (from, to, n) of ranks, those of the least hash of salt and key. Draws do not depend
    on how rows are dealt out; a band's candidates are cut to n in each task before they meet."""
    band = F.coalesce(*[F.when(F.col("rank").between(low, high), F.lit(i)) for i, (low, high, _) in enumerate(bands)])
    most = F.element_at(F.array(*[F.lit(n) for _, _, n in bands]), F.col("band") + 1)
    drawn = rows.withColumn("band", band).where("band is not null").withColumn("__h", F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256))
    n = F.row_number().over(Window.partitionBy("band").orderBy("__h", key))
    return drawn.withColumn("__n", n).where((F.col("__n") <= max(n for _, _, n in bands)) & (F.col("__n") <= most)).select(key, "rank", "band")


def edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Values at place floor(i n / bins) of the sorted values, i from 1 to bins - 1; places come from counts of each value."""
    counts = df.groupBy(value).agg(F.count("*").alias("c"))
    upto = stats.running(counts, value, {"upto": "c"})
    wanted = df.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i"), "n").select("i", F.floor(F.col("i") * F.col("n") / bins).alias("place"))
    met = upto.join(F.broadcast(wanted), F.col("upto") > F.col("place"))  # bins - 1 rows
    return met.groupBy("i").agg(F.min(value).alias("edge"))


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many edges lie below x."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: x > e))


def platforms(df: DataFrame, least: int = 50) -> DataFrame:
    """Registrable domains with at least `least` different hosts."""
    return df.groupBy("registrable").agg(F.count_distinct("host").alias("hosts")).where(F.col("hosts") >= least)


def without_conflicts(df: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """registrable, y, source: names whose labels agree, the first source's row; names of `other` only where df has none."""
    kept = df.groupBy("registrable").agg(F.count_distinct("y").alias("labels"), F.min("y").alias("y"), F.min("source").alias("source")).where("labels = 1").drop("labels")
    if other is None:
        return kept
    return kept.unionByName(other.join(df.select("registrable").distinct(), "registrable", "left_anti").groupBy("registrable").agg(F.min("y").alias("y"), F.min("source").alias("source")))


def side(name: Column) -> Column:
    """train, validation or test (70, 15, 15) by the name's hash."""
    h = urls.fnv1a(name) % 100
    return F.when(h < 70, "train").when(h < 85, "validation").otherwise("test")


def weights(df: DataFrame, least: int = 2) -> DataFrame:
    """bucket and smoothed log ratio of its names' labels, as a whole number of twentieths; small ones are pruned. df: name, y."""
    base = df.select("name", "y")
    totals = base.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    each = base.select("y", F.explode(buckets(F.col("name"))).alias("bucket")).groupBy("bucket").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).where(F.col("pos") + F.col("neg") >= least)
    w = F.log((F.col("pos") + 1) / (F.col("p") + 2)) - F.log((F.col("neg") + 1) / (F.col("n") + 2))
    return each.crossJoin(F.broadcast(totals)).select("bucket", w.alias("w")).where("abs(w) >= 0.1").select("bucket", F.floor(F.col("w") * 20 + 0.5).cast("int").alias("q"))  # one row of totals


def scores(hosts: DataFrame, model: DataFrame) -> DataFrame:
    """name and z of each different name: sum of its buckets' weights over the root of their number."""
    each = hosts.select("name").distinct().withColumn("b", buckets(F.col("name"))).select("name", F.size("b").alias("n"), F.explode("b").alias("bucket"))
    return each.join(model, "bucket", "left").groupBy("name").agg((F.coalesce(F.sum("q"), F.lit(0)) / 20.0 / F.sqrt(F.max("n"))).alias("z"))


def calibrated(z: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * z + b)))


def band(p: Column, high: float, elevated: float) -> Column:
    return F.when(p >= high, "high").when(p >= elevated, "elevated").otherwise("low")
