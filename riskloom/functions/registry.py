"""What users add or call by name: detectors, and the library's functions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as store
from ..operators import privacy

#: SQL functions: name, parameters, type and body. The key is the one of text.dedup_key.
FUNCTIONS = {
    "normalize_for_dedup": ("t string", "string", r"trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\\[[^\\]]*\\]', ''), '[0-9]+', '#'), '\\s+', ' '))"),
    "wilson_low": ("k double, n double", "double", "case when n > 0 then greatest(0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) end"),
    "wilson_high": ("k double, n double", "double", "case when n > 0 then least(1, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) end"),
}


def pii_body() -> str:
    """The rules of what a masked text must not hold, as one SQL expression over t: names of those that it breaks."""
    left, word = privacy.LEFT, privacy.WORD
    q = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    suffixes, allowed = (", ".join(f"'{x}'" for x in xs) for xs in (privacy.SUFFIXES, privacy.PLACEHOLDERS))
    personal = f"exists(zip_with(regexp_extract_all(t, {q(privacy.ADDRESS_ONCE)}, 1), regexp_extract_all(t, {q(privacy.ADDRESS_ONCE)}, 2), (x, y) -> x <> '' and (lower(y) in ({suffixes}) or x rlike '[0-9._-]' or contains(y, '.'))), z -> z)"
    checks = {
        "digits": "t rlike '[0-9](?:[ -]?[0-9]){8,}'", "handle": f"contains(t, '@') and t rlike {q(privacy.HANDLE)}", "address": f"contains(t, '@') and {personal}", "pan": f"t rlike {q(f'(?<!{word})[A-Z]{{5}}[0-9]{{4}}[A-Z](?!{word})')}",
        "unknown_placeholder": f"size(array_except(regexp_extract_all(t, {q('\\[([^\\]]*)\\]')}, 1), array({allowed}))) > 0", "glued": f"t rlike {q('\\[[A-Z_]+\\][A-Za-z0-9_]')}",
    }
    return f"filter(array({', '.join(f'case when {c} then {chr(39)}{k}{chr(39)} end' for k, c in checks.items())}), x -> x is not null)"


def register_label_store(spark: SparkSession, messages: DataFrame, labels: DataFrame, adjudications: DataFrame, splits: DataFrame, prefix: str = "") -> list[str]:
    """The label store in SQL: views messages, labels, adjudications, splits and final_labels (each after the prefix), the function
    cohen_kappa(a, b) of two annotators' names and the table function export_rows(stage); names of the functions."""
    views = {"messages": messages, "labels": labels, "adjudications": adjudications, "splits": splits, "final_labels": store.final_labels(messages, labels, adjudications)}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store.export_rows(messages, splits, views["final_labels"], "").schema.fields)
    spark.sql(f"""create or replace temporary function {prefix}cohen_kappa(a string, b string) returns double return (
        with p as (select x.is_scam as x, y.is_scam as y from {prefix}labels x join {prefix}labels y on x.message_id = y.message_id where x.annotator_id = a and y.annotator_id = b),
        s as (select count(*) as n, count_if(x = y) / nullif(count(*), 0) as po, (count_if(x) * count_if(y) + count_if(not x) * count_if(not y)) / nullif(cast(count(*) as double) * count(*), 0) as pe from p)
        select max(case when pe < 1 then (po - pe) / (1 - pe) end) from s)""")
    spark.sql(f"""create or replace temporary function {prefix}export_rows(wanted string) returns table ({columns}) return
        select m.message_id, f.is_scam, f.status from {prefix}messages m join {prefix}splits s on s.message_id = m.message_id and s.stage = wanted join {prefix}final_labels f on f.message_id = m.message_id where f.status <> 'pending'""")
    return [f"{prefix}cohen_kappa", f"{prefix}export_rows"]


def register_functions(spark: SparkSession) -> list[str]:
    """The functions above as temporary SQL functions of the session; their names."""
    every = FUNCTIONS | {"pii_check": ("t string", "array<string>", pii_body())}
    for name, (params, kind, body) in every.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {kind} return {body}")
    return list(every)


class Detectors:
    """Named detectors: functions from a text column to a boolean one (built-in expressions or Pandas UDFs)."""

    def __init__(self):
        self.known: dict[str, Callable[[Column], Column]] = {"always": lambda c: F.lit(True), "never": lambda c: F.lit(False)}

    def add(self, name: str, detector: Callable[[Column], Column]) -> None:
        if name in self.known:
            raise ValueError(f"{name!r} is a detector already")
        self.known[name] = detector

    def flags(self, df: DataFrame, text_col: str, names: list[str] | None = None) -> DataFrame:
        """df with a boolean column for each detector; a detector's null counts as not flagged."""
        chosen = list(self.known) if names is None else names
        return df.withColumns({name: F.coalesce(self.known[name](F.col(text_col)).cast("boolean"), F.lit(False)) for name in chosen})
