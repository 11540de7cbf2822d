"""Checks of published figures: formulas over other figures, periods that follow one another, registry order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A formula may hold names, numbers, arithmetic signs, parentheses and round().
FORMULA = re.compile(r"(\s|[A-Za-z_]\w*|\d+(\.\d+)?|[-+*/(),])+")


def check_derived(df: DataFrame, key: list[str], formulas: dict[str, str], tolerance: float = 1e-9) -> DataFrame:
    """key, figure, stored, computed, agrees: each figure beside its formula over the row's other columns. A formula outside arithmetic fails; one that has no value (division by zero) disagrees."""
    for f in formulas.values():
        names = set(re.findall(r"[A-Za-z_]\w*", f)) - {"round"}
        if not FORMULA.fullmatch(f) or not names <= set(df.columns):
            raise ValueError(f"not a formula over the columns: {f!r}")
    guarded = {k: re.sub(r"/\s*([A-Za-z_]\w*)", r"/ nullif(\1, 0)", f) for k, f in formulas.items()}
    each = F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).cast("double").alias("stored"), F.expr(f).cast("double").alias("computed")) for k, f in guarded.items()])
    out = df.select(*key, F.explode(each).alias("x")).select(*key, "x.*")
    return out.withColumn("agrees", F.coalesce(F.abs(F.col("stored") - F.col("computed")) <= tolerance, F.lit(False)))


def check_periods(df: DataFrame, n: str, begin: str, end: str, days: str) -> DataFrame:
    """Numbered periods with what is wrong with each: number, length, or a start that is not the day after the last one's end.

    Periods are few (weeks or months of a campaign), so one ordered window sees them.
    """
    w = Window.orderBy(n)
    problem = F.concat_ws(";", F.when(F.col(n) != F.row_number().over(w), "number"), F.when(F.datediff(end, begin) + 1 != F.col(days), "days"), F.when(F.datediff(begin, F.lag(end).over(w)) != 1, "gap"))
    return df.withColumn("problems", problem)


def check_registry(df: DataFrame, n: str, day: str, digest: str) -> DataFrame:
    """Registry entries in order: dates never fall, digests are 64 hexadecimal digits. A registry holds one row a release, so one window sees it."""
    w = Window.orderBy(n)
    return df.withColumn("problems", F.concat_ws(";", F.when(F.col(day) < F.lag(day).over(w), "order"), F.when(~F.coalesce(F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")))


def resolve_points(points: DataFrame, figures: DataFrame, key: str, value: str) -> DataFrame:
    """points with `value` and `missing`: what each point of a series refers to among the figures (one row a key), or that there is none."""
    return points.join(figures.select(key, value, F.lit(True).alias("__there")), key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there")
