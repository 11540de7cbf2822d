"""Parts that no query calls, on small cases."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import assistant, dataset, facts, labels, links, messages, privacy, textmodel
from riskloom.sources import tables


def column(spark, values, expression, kind="string"):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("x", expression).orderBy("i").collect()]


def test_names_terms_and_keywords(spark):
    said = ["Hi, my name is rita.", "I am fine", "this is JOHN", "call me", None]
    assert column(spark, said, text.introduced_name(F.col("v"), ["fine"])) == ["Rita", None, "John", None, None]
    assert column(spark, ["Ask Rita Rao or RITA RAO", "a.b ax b", None], privacy.mask_terms(F.col("v"), ["rita rao", "a.b"], "NAME")) == ["Ask [NAME] or [NAME]", "[NAME] ax b", None]
    with pytest.raises(ValueError):
        privacy.mask_terms(F.lit(""), ["x"], "NAME")
    assert column(spark, ["an otp now", "hotpot", f"o{text.ANY}p", "otps", "the otp"], F.col("v").rlike(text.keyword("otp"))) == [True, False, True, False, True]
    assert column(spark, ["investing"], F.col("v").rlike(text.keyword("invest", prefix=True))) == [True]
    assert column(spark, ["abca", "é𝒳é", "ab", None], textmodel.ngrams(F.col("v"), 3, 3)) == [["abc", "bca"], ["é𝒳é"], [], None]


def test_normalised_texts(spark):
    cases = [("U P I and K.Y.C, o-t-p", "UPI and KYC, otp"), ("a b cd", "a b cd"), ("p@ssw0rd", f"p{text.ANY}ssw{text.ANY}rd"), ("pay 1500 to A1B0C3", "pay 1500 to A1B0C3"), ("Rs 1930", "Rs 1930"), ("раураl", "paypal"), ("ОТР", "OTP"), ("x­y​z", "xyz"), ("खाता ५", "खाता ५"), ("ﬁne ＡＢ", "fine AB")]
    once = column(spark, [a for a, _ in cases], text.normalise(F.col("v")))
    assert once == [b for _, b in cases]
    assert column(spark, once, text.normalise(F.col("v"))) == once


def test_quiz_speech_ids_and_constraints(spark):
    answers = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "person string, question int, option string")
    key = spark.createDataFrame([(1, "x"), (2, "y")], "question int, correct string")
    assert {r["person"]: (r["score"], r["message"]) for r in assistant.quiz_scores(answers, key, {0: "try again", 2: "well done"}).collect()} == {"a": (2, "well done"), "b": (0, "try again")}
    agents = ["x Edg/1 Chrome/2 Safari/3", "Chrome/2 Safari/3", "Safari/3", "curl", "OPR/1 Chrome/2"]
    assert column(spark, agents, assistant.speech_provider(F.col("v"))) == ["edge", "google", "apple", "none", "none"]
    ids = spark.createDataFrame([("m1",), ("m0041",), ("other",), (None,)], "id string")
    assert dataset.next_id(ids, "id", "m").first()["next_id"] == "m0042" and dataset.next_id(ids.limit(0), "id", "m").first()["next_id"] == "m0001"
    lab = spark.createDataFrame([(1, "a", True, "kyc"), (1, "a", True, "kyc"), (2, "a", True, "safe"), (3, "a", False, "safe")], "message_id int, annotator_id string, is_scam boolean, attack_category string")
    assert {r["message_id"]: r["reason"] for r in labels.rejected(lab).collect()} == {1: "repeated", 2: "contradiction"}


def test_outside_corpus_loses_conflicts_and_excluded_classes(spark):
    rows = [(1, "Win 5 now", "bad"), (2, "win 77 now", "bad"), (3, "hello  there", "good"), (4, "Hello there", "bad"), (5, "offer", "spam"), (6, "fine", "good"), (7, None, "good")]
    kept, counts = dataset.external(spark.createDataFrame(rows, "id int, t string, label string"), "id", "t", "label", "bad", ["spam"])
    assert sorted(map(tuple, kept.collect())) == [(1, True), (6, False), (7, False)]
    assert {r["what"]: r["n"] for r in counts.collect()} == {"input": 7, "conflicting_groups": 1, "after_conflicts_and_repeats": 4, "excluded": 1, "positive": 1, "negative": 2}


def test_reports_cards_points_and_old_verdicts(spark):
    d = messages.told(messages.verdict(spark.createDataFrame([(1, "Share your PIN now"), (2, "lunch")], "i int, text string"), "text"))
    made = d.select("i", assistant.report_text(F.col("level"), F.col("name"), F.col("score"), F.transform("evidence", lambda e: e["quote"]), F.lit(""), F.col("advice")).alias("r"))
    got = {r["i"]: r["r"].split("\n") for r in made.collect()}
    assert got[1][0].startswith("Looks like a theft of a code or PIN (scam") and got[1][-1] == assistant.ROUTES and len(got[2]) == 2
    families = spark.createDataFrame([(k, *v) for k, v in messages.ABOUT_FAMILIES.items()], "family string, name string, intent string, advice string")
    assert assistant.cards(families, "UPI Fraud").count() == 2 and assistant.cards(families).count() == len(messages.ABOUT_FAMILIES) and "report" in assistant.cards(families).first()["prefill"]
    points = facts.resolve_points(spark.createDataFrame([(1, "a"), (2, "b")], "p int, k string"), spark.createDataFrame([("a", None)], "k string, v int"), "k", "v")
    assert {r["p"]: r["missing"] for r in points.collect()} == {1: False, 2: True}
    assert column(spark, ["official", "unverified", "suspicious", "scam"], links.legacy_verdict(F.lit("link"), F.col("v"))) == ["safe", "caution", "caution", "danger"]
    assert column(spark, ["unverified"], links.legacy_verdict(F.lit("text"), F.col("v"))) == ["caution"]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,google.com\n2,example.org\n")
    assert sorted(map(tuple, tables.read_ranked_domains(spark, f"{tmp_path}/r.csv").collect())) == [(1, "google.com"), (2, "example.org")]
    (tmp_path / "c.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert tables.read_json(spark, f"{tmp_path}/c.json", "a int, b string").collect() == [(1, "x")]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    tables.append_rows(df, f"{tmp_path}/t")
    tables.append_rows(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    tables.write_json_report(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").collect() == [(1, "x")]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_json_report(df, f"{tmp_path}/j")
    (tmp_path / "q.csv").write_bytes("﻿a,b\r\n\"x, \"\"y\"\"\",\"line\nend\"\r\n\r\nshort\r\none,two,three\r\n".encode())
    rows = tables.read_csv(spark, f"{tmp_path}/q.csv", ["a", "b"]).collect()
    assert rows[0][:2] == ('x, "y"', "line\nend") and sum(r["_corrupt_record"] is not None for r in rows) == 2
    assert tables.markdown(df) == "| a | b |\n|---|---|\n| 1 | x |"
