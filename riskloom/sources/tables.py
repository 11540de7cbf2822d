"""Readers of the tables, and of text formats with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the labelled-message CSV, in order. (Fixed values.)
HOLDOUT_COLUMNS = ["id", "raw_text_scrubbed", "language_tag", "is_scam", "attack_category", "source_platform", "date_received", "contains_obfuscation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV (doubled quotes, line ends within quotes, any line end, byte-order mark) with exactly these columns, all strings.

    A header that differs fails; a row of another width has its text in _corrupt_record.
    """
    schema = strings([*columns, "_corrupt_record"])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", encoding="UTF-8")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with minimal quotes and doubled quotes; by default an existing path is not overwritten."""
    df.write.csv(path, header=True, quote='"', escape='"', mode=mode)


def write_template(spark: SparkSession, path: str, columns: list[str] | None = None) -> None:
    """A CSV with a header only."""
    write_csv(spark.createDataFrame([], strings(columns or HOLDOUT_COLUMNS)).coalesce(1), path)


def read_tab_labels(spark: SparkSession, path: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of label, tab, text (later tabs belong to the text): rows with a known label, and the lines rejected."""
    lines = spark.read.text(path)
    at = F.instr("value", "\t")
    parsed = lines.select(F.lower(F.trim(F.substring_index("value", "\t", 1))).alias("label"), F.expr("substring(value, instr(value, '\t') + 1)").alias("text"), "value")
    good = (at > 0) & F.col("label").isin(*labels)
    return parsed.where(good).select("label", "text"), parsed.where(~good).select("value")


def read_labelled_csv(spark: SparkSession, path: str, label_column: str, text_column: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """label and text of a CSV whose header names the columns in any case: rows with a known label, and the others."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = {c.strip().lower(): c for c in df.columns}
    missing = [c for c in (label_column, text_column) if c.lower() not in names]
    if missing:
        raise ValueError(f"the header has no column {', '.join(missing)}")
    label = F.lower(F.trim(F.col(f"`{names[label_column.lower()]}`")))
    rows = df.select(label.alias("label"), F.col(f"`{names[text_column.lower()]}`").alias("text"))
    known = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    return rows.where(known), rows.where(~known)


def read_ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """rank and domain of a two-column CSV without header."""
    return spark.read.schema("rank long, domain string").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None, name_pattern: str | None = None) -> DataFrame:
    """path, length and content of files, up to a size and by name; the digest pins what was read."""
    df = spark.read.format("binaryFile").load(path)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    if name_pattern is not None:
        df = df.where(F.element_at(F.split("path", "/"), -1).rlike(name_pattern))
    return df.withColumn("sha256", F.sha2("content", 256))


def read_zip_entries(files: DataFrame, most_bytes: int = 1 << 26) -> DataFrame:
    """path, entry, content of the zip archives in files(path, content); an entry over most_bytes or damaged has null content, and a
    damaged or missing archive is a row without an entry."""

    def entries(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(raw or b""))
                except zipfile.BadZipFile:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.string()), pa.array([None], pa.binary())], ["path", "entry", "content"])
                    continue
                for info in archive.infolist():
                    try:
                        got = archive.read(info) if info.file_size <= most_bytes else None
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                        got = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info.filename]), pa.array([got], pa.binary())], ["path", "entry", "content"])

    return files.select("path", "content").mapInArrow(entries, "path string, entry string, content binary")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table: validated rows, registry entries."""
    df.write.mode("append").parquet(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a Markdown table; more than `most` rows fail, as none may be left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: aggregate it first, or raise `most`")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)])
