"""Operators on events, the survey, figures, pictures, speech, formats, streams and training, on small fixtures."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from riskloom.functions import formats, speech
from riskloom.operators import activity, facts, pictures, survey, training
from riskloom.plans import activity as plans
from riskloom.streaming import activity as stream

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "d", "want"), [(0, 0, "0"), (999, 0, "999"), (1000, 0, "1,000"), (101928, 0, "1,01,928"), (-12345678.5, 2, "-1,23,45,678.50"), (10**12, 0, "10,00,00,00,00,000"), (float("inf"), 0, None), (None, 0, None)])
def test_indian_groups(spark, n, d, want):
    assert one(spark, formats.indian(F.lit(n).cast("double"), d)) == want


def test_other_formats(spark):
    assert one(spark, formats.rupees_compact(F.lit(79700))) == "₹79,700"
    assert one(spark, formats.rupees_compact(F.lit(116000))) == "₹1.16 Lakh"
    assert one(spark, formats.rupees_compact(F.lit(25000000))) == "₹2.50 Cr"
    assert one(spark, formats.rupees_compact(F.lit(-1))) is None
    assert one(spark, formats.stat(F.lit(22845), "inr_cr")) == "₹22,845 Cr"
    assert one(spark, formats.clock(F.lit("00:07"))) == "12:07 am" and one(spark, formats.clock(F.lit("24:00"))) is None
    with pytest.raises(ValueError):
        formats.stat(F.lit(1), "none such")


def test_clean_drops_free_text(spark):
    rows = [(1, datetime.datetime(2024, 1, 1, 5, 6, 7), "message", "scam", "call me on 98", ["urgency", "Free Text!", "odd"], 12.345, None), (2, None, "nonsense", None, None, None, None, None), (3, None, "ocr", "safe", None, None, -1.0, "x")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, level string, family string, rules array<string>, ms double, code string")
    got = {r["event_id"]: r for r in activity.clean(df, ["otp"], ["urgency"], ["y"]).collect()}
    assert set(got) == {1, 3}
    assert got[1]["ts"] == datetime.datetime(2024, 1, 1, 5, 6) and got[1]["family"] is None and got[1]["rules"] == ["urgency", "other"]
    assert got[1]["ms"] in (12.34, 12.35) and got[3]["level"] is None and got[3]["ms"] is None and got[3]["code"] == "other"
    assert activity.latency(activity.clean(df.limit(0))).first().asDict() == {"samples": 0, "p50": None, "p95": None, "p99": None, "most": None, "status": "not-enough-data"}


def test_sessions_break_at_the_gap(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [("a", base + datetime.timedelta(seconds=s)) for s in (0, 0, 3599, 7199, 7200, 10900)]
    got = activity.sessions(spark.createDataFrame(rows, "k string, t timestamp_ntz"), "k", "t").orderBy("began").collect()
    assert [r["events"] for r in got] == [3, 2, 1]


def test_survey_rules_tell_nulls_and_repeats(spark):
    df = plans.answers(spark, SF)
    clean = survey.row_errors(df, plans.TODAY).where("errors = ''")
    assert clean.count() > 0
    row = clean.limit(1).drop("errors")
    both = row.unionByName(row.withColumn("line", F.col("line") + 1000)).unionByName(row.withColumn("line", F.lit(9).cast("long")).withColumn("id", F.lit("S-999")).withColumn("gender", F.lit(None).cast("string")))
    assert sorted(r["errors"] for r in survey.row_errors(both, plans.TODAY).collect()) == ["", "gender", "repeat"]
    assert survey.mean_scores(df.limit(0)).first()["attended"] == 0


def test_facts(spark):
    df = spark.createDataFrame([("a", 10, 4, 6), ("b", 0, 0, 1)], "k string, n long, c long, rest long").withColumn("share", F.try_divide("c", "n"))
    got = {(r["k"], r["figure"]): r["agrees"] for r in facts.check_derived(df, ["k"], {"rest": "n - c", "share": "c / n"}).collect()}
    assert got == {("a", "rest"): True, ("a", "share"): True, ("b", "rest"): False, ("b", "share"): False}
    for bad in ("n; drop", "exists(n)", "other + 1"):
        with pytest.raises(ValueError):
            facts.check_derived(df, ["k"], {"rest": bad})
    weeks = spark.createDataFrame([(1, "2024-01-01", "2024-01-07", 7), (2, "2024-01-08", "2024-01-13", 7), (4, "2024-01-15", "2024-01-21", 7)], "n int, a string, b string, d int").selectExpr("n", "date(a) a", "date(b) b", "d")
    assert [r["problems"] for r in facts.check_periods(weeks, "n", "a", "b", "d").orderBy("n").collect()] == ["", "days", "number;gap"]
    log = spark.createDataFrame([(1, "2024-01-02", "a" * 64), (2, "2024-01-01", "z")], "n int, day string, digest string")
    assert [r["problems"] for r in facts.check_registry(log, "n", "day", "digest").orderBy("n").collect()] == ["", "order;digest"]


def test_picture_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + b"\0" * 12
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    heads = [png, gif, jpeg, webp, b"short", b"plain text, not a picture", None, png[:20]]
    df = spark.createDataFrame(list(enumerate(heads)), "i int, content binary")
    got = [(r["width"], r["height"]) for r in pictures.with_size(df, "content").orderBy("i").collect()]
    assert got == [(640, 480), (7, 9), (40, 30), (100, 50), *[(None, None)] * 4]
    assert one(spark, pictures.plan(F.lit(0), F.lit(5))) is None
    big = one(spark, pictures.plan(F.lit(4000), F.lit(3000)))
    assert big["shrunk"] and big["width"] * big["height"] <= 2_810_000
    assert one(spark, pictures.plan(F.lit(20000), F.lit(20000)))["refused"]


def test_speech_keeps_words_and_limits(spark):
    text = "Call 1930 now! See https://x.example/a \U0001f600 or cybercrime.gov.in…\n• 1.5 lakh lost?! " + "word, " * 60 + "end। नमस्ते।"
    df = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "x" * 500), (4, "?!... --")], "i int, t string")
    got = {r["i"]: r["chunks"] for r in speech.chunks(df, "t").collect()}
    assert got[1] == got[2] == got[4] == []
    assert all(len(c) <= 160 for c in got[0] + got[3]) and "".join(got[3]) == "x" * 500
    assert got[0][0] == "Call 1930 now!" and "a link" in " ".join(got[0]) and "cybercrime.gov.in" in " ".join(got[0]) and "\U0001f600" not in " ".join(got[0])
    assert " ".join(got[0]).split() == one(spark, speech.clean(F.lit(text))).split()


def test_stream_goes_on_where_it_stopped_and_answers_late_events(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    at = lambda m: base + datetime.timedelta(minutes=m)
    schema = "user_id long, event_id long, ts timestamp_ntz, verdict string"
    batches = [[(1, 1, at(0), "scam"), (1, 2, at(30), None), (2, 3, at(30), None)], [(1, 4, at(59), None), (1, 5, at(61), None), (1, 6, at(20), "suspicious"), (1, 7, at(25), None)], [(1, 8, at(75), None), (1, 9, at(81), None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = stream.read_events(spark, f"{tmp_path}/in", schema)
        out = stream.run_available(stream.remembered(events, "user_id"), f"{tmp_path}/out")
    got = {r["event_id"]: r["remembered"] for r in out.collect()}
    assert got == {1: None, 2: "scam", 3: None, 4: "suspicious", 5: "suspicious", 6: "scam", 7: "suspicious", 8: "suspicious", 9: None}


def test_training(spark):
    rows = [(i, "win a prize now" if i % 2 else "lunch at noon today", i % 2) for i in range(200)] + [(900, None, 0), (901, "", 0)]
    df = training.hashed(spark.createDataFrame(rows, "i long, t string, y int"), F.col("t"), 256)
    scored = training.scored(df, training.fit(df, F.col("y")))
    assert scored.where("i < 200").agg(F.min(F.when(F.col("y") == 1, F.col("score"))) > F.max(F.when(F.col("y") == 0, F.col("score")))).first()[0]
    slope, _ = training.platt(scored.where("i % 10 < 9").withColumn("y", F.when(F.col("i") % 7 == 0, 1 - F.col("y")).otherwise(F.col("y"))), F.col("score"), F.col("y"))
    assert slope > 0
    aucs = [r["auc"] for r in training.bootstrap_auc(scored, F.col("i"), F.col("score"), F.col("y") == 1, 20).collect()]
    assert len(aucs) == 20 and min(aucs) > 0.99
    negatives = spark.createDataFrame([(float(i), 0) for i in range(100)] + [(500.0, 1)], "s double, y int")
    assert training.threshold_at(negatives, F.col("s"), F.col("y") == 1, 0.05).first()["threshold"] == pytest.approx(95.0)
