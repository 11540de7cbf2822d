"""Where results come from: fingerprints of tables whatever their order of rows, records of a run's inputs, and what changed since.

Policy as a table of numbers, each violation a row, and the exit status that a decision means.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the release policy and the open interval that each must lie in (null: no bound). (Fixed values.)
BOUNDS = [("least_precision", 0.0, 1.0), ("prevalence", 0.0, 1.0), ("regression_alpha", 0.0, 1.0), ("near_jaccard", 0.0, 1.0), ("most_p95_ms", 0.0, None), ("most_model_bytes", 0.0, None)]
#: A row's text: its columns by name, in the order of names, as text; a null is told from an empty text.
BETWEEN, NULL = "\x1f", "\x00"


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's columns in the order of their names."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL))) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws(BETWEEN, *parts), 256)


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """name, rows and digest: sums of the rows' digests in four parts, so neither the order of rows nor their partitions count,
    repeated rows do, and no row leaves its task but as a sum."""
    d = df.select(row_digest(df).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(15,0)")).cast("string")
    sums = d.agg(F.count("*").alias("rows"), *[F.coalesce(part(i), F.lit("0")).alias(f"p{i}") for i in range(4)])
    return sums.select(F.lit(name).alias("name"), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("digest"))


def record(tables: dict[str, DataFrame], settings: dict | None = None) -> DataFrame:
    """name, rows and digest of each table and, as rows without a count, of each setting."""
    out = [table_digest(df, name) for name, df in tables.items()]
    if settings:
        spark = next(iter(tables.values())).sparkSession
        rows = [(k, None, json.dumps(v, sort_keys=True, default=str)) for k, v in settings.items()]
        out.append(spark.createDataFrame(rows, "name string, rows long, text string").select("name", "rows", F.sha2("text", 256).alias("digest")))
    return reduce(DataFrame.unionByName, out)


def changes(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """name and problem of what is not as it was recorded: changed, missing or unrecorded."""
    a = recorded.select("name", F.struct("rows", "digest").alias("was"))
    b = now.select("name", F.struct("rows", "digest").alias("is"))
    both = a.join(b, "name", "full_outer")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was.digest") != F.col("is.digest"), F.when(F.col("was.rows") != F.col("is.rows"), "rows changed").otherwise("content changed"))
    return both.select("name", problem.alias("problem")).where("problem is not null")


def run_key(recorded: DataFrame) -> DataFrame:
    """key: one digest of a whole record, by which a run's stages are found again."""
    rows = F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest")))  # a row for each table or setting
    return recorded.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("key"))


def policy_problems(policies: DataFrame, key: list[str]) -> DataFrame:
    """key, field and problem (missing, not a number, out of bounds, unknown) of policies given as rows: key, field, value (text)."""
    spark = policies.sparkSession
    bounds = F.broadcast(spark.createDataFrame(BOUNDS, "field string, low double, high double"))  # six rows
    number = F.expr("try_cast(value as double)")
    asked = policies.select(*key).distinct().crossJoin(bounds)
    given = policies.groupBy(*key, "field").agg(F.max("value").alias("value"))
    told = asked.join(given, [*key, "field"], "left")
    outside = F.isnan(number) | (number <= F.col("low")) | (F.col("high").isNotNull() & (number >= F.col("high")))
    problem = F.when(F.col("value").isNull(), "missing").when(number.isNull(), "not a number").when(outside, "out of bounds")
    unknown = given.join(bounds.select("field"), "field", "left_anti").select(*key, "field", F.lit("unknown").alias("problem"))
    return told.select(*key, "field", problem.alias("problem")).where("problem is not null").unionByName(unknown)


def exit_status(status: Column, report: bool = False, strict: bool = False) -> Column:
    """0 or 1 for a decision: a failure always stops; missing evidence does unless only a report is asked for; what is unproven does if strict."""
    return F.when(status == "PASS", 0).when(status == "INCONCLUSIVE", int(strict)).when(status == "NO_EVIDENCE", int(not report)).otherwise(1)


def main(spark: SparkSession, decisions: DataFrame, report: bool = False, strict: bool = False) -> int:
    """The exit status of a run: the worst one of its decisions (status); a run without decisions has no evidence."""
    worst = decisions.agg(F.max(exit_status(F.col("status"), report, strict)).alias("x")).first()["x"]
    return int(not report) if worst is None else int(worst)
