"""Keys of texts are made in one reading of the table."""

from pyspark.sql import functions as F

from riskloom.operators import dataset
from riskloom.plans import datasets as plan

SMALL = "/root/testdata/sf0.001"


def readings(df):
    """How often a plan still makes keys or reads the documents."""
    p = df._jdf.queryExecution().executedPlan().toString()
    return p.count("FileScan"), p.count("sha2(")


def test_groups_of_keys(spark):
    assert readings(plan.dedup_first_line(spark, SMALL)) == (0, 0)
    rows = [(1, "short"), (2, "A longer text 12"), (3, None), (4, "a longer  text 7"), (5, "short"), (6, "another longer text")]
    got = dataset.dedup_groups(spark.createDataFrame(rows, "i long, t string"), "i", "t")
    assert sorted(map(tuple, got.collect())) == [(2, 2, 2), (4, 2, 2), (6, 6, 1)]


def test_row_errors_read_texts_once(spark):
    assert readings(plan.holdout_validate(spark, SMALL)) == (0, 0)
    base = {"language_tag": "en", "is_scam": "0", "attack_category": "safe", "source_platform": "sms", "date_received": "2024-02-01", "contains_obfuscation": "false"}
    rows = [(1, "a", "short"), (2, "a", "A longer text here"), (3, "b", "a longer text  here"), (4, None, "short"), (5, "c c", None), (6, "c c", "one more longer text")]
    df = spark.createDataFrame(rows, "line long, id string, raw_text_scrubbed string").withColumns({k: F.lit(v) for k, v in base.items()})
    got = sorted(map(tuple, dataset.row_errors(df, "2024-02-20").collect()))
    assert got == [(1, "short_text"), (2, "duplicate_id"), (3, "duplicate_text"), (4, "short_text"), (5, "bad_id"), (6, "bad_id")]
