"""Rules read whole messages; a query reads beginnings only where its SQL does."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from riskloom.operators import detectors, messages
from riskloom.plans import catalogue

FILLER = "the minutes of the meeting are attached and lunch is at noon. " * 80
ENDS = [
    "Please share the OTP now. kisi ko mat batana.", "Your OTP is 4. kisi ko mat batana.", "Do not tell anyone. I transferred 5,000 rupees by mistake, please return the money.", "pay 500 to release the parcel within 10 minutes",
    "p@ssword bhejo, warna khata band hoga. do not tell anyone your pin. keep it secret", "see https://sbi-kyc-verify.xyz/login immediately", "i lost money, is it safe?", "",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(i, turn, "user", (FILLER if turn == 1 else "") + end) for i, end in enumerate(ENDS) for turn in (1, 2)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["rules_fired", "rule_weights", "message_verdict", "detector_flags", "secrecy_guard", "message_link_verdict"])
def test_long_messages_give_the_sql_rows(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
    got, want = catalogue.QUERIES[name](spark, folder), con.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    cols = sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_what_stands_at_the_end_counts(spark, folder):
    d = spark.read.parquet(f"{folder}/conversations.parquet")
    e = messages.verdict(d, "text").select("conv_id", "turn", "level", F.transform("evidence", lambda x: x["rule"]).alias("rules"))
    got = {(r["conv_id"], r["turn"]): (r["level"], r["rules"]) for r in e.collect()}
    assert all(got[i, 1] == got[i, 2] for i in range(len(ENDS))) and got[0, 1][0] == "scam"
    flags = {(r["conv_id"], r["turn"]): tuple(r[n] for n in detectors.NAMES) for r in detectors.flags(d, "text").collect()}
    assert all(flags[i, 1] == flags[i, 2] for i in range(len(ENDS))) and flags[0, 1][3:5] == (True, True)


def test_many_demands_in_one_message(spark):
    n = 2000
    text = "do not tell anyone. kisi ko mat batana. urgent! " * n + "your otp is 4. keep it secret. evariki cheppakandi."
    e = messages.evidence(spark.createDataFrame([(text,)], "text string"), "text").first()["evidence"]
    assert {r["rule"]: (r["quote"], r["count"]) for r in e} == {"secrecy": ("do not tell anyone", 3), "urgency": ("urgent", 1)}


def test_verdicts_of_the_end(spark, folder):
    got = {(r["conv_id"], r["turn"]): (r["score"], r["level"], r["family"]) for r in catalogue.QUERIES["message_verdict"](spark, folder).collect()}
    assert all(got[i, 1] == got[i, 2] for i in range(len(ENDS))) and got[0, 1][1] == "scam"


def test_quotes_of_the_end(spark, folder):
    got = sorted((r["conv_id"], r["turn"], r["rule"], r["quote"], r["count"]) for r in catalogue.QUERIES["rule_weights"](spark, folder).where("quoted and turn < 3").collect())
    assert [(i, *x) for i, t, *x in got if t == 1] == [(i, *x) for i, t, *x in got if t == 2] and len(got) > 10


def test_rules_of_the_end(spark, folder):
    got = {(r["conv_id"], r["turn"]): r["rules"] for r in catalogue.QUERIES["rules_fired"](spark, folder).collect()}
    assert all(got[i, 1] == got[i, 2] for i in range(len(ENDS))) and "ask-secret" in got[0, 1]
