"""Python steps in the plans of queries, and patterns that run only where they can fit."""

import re
from functools import reduce

from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import messages
from riskloom.plans import messages as plan

SMALL = "/root/testdata/sf0.001"


def steps(df):
    """The Python steps of a plan, and how many functions each evaluates."""
    lines = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    return [len(set(re.findall(r"pythonUDF\d+#\d+", line.rsplit("[", 1)[1]))) for line in lines]


def test_texts_judged_once_are_composed_once(spark):
    # The verdicts' composition and phrases, and the topic's composition; one copy of the text each.
    assert steps(plan.followup_replies(spark, SMALL)) == [1, 1, 1]
    assert steps(plan.followup_asof(spark, SMALL)) == [1, 1]


def test_rules_run_once_below_an_explode(spark):
    # Two for the turns, two for the planted ones.
    assert steps(plan.rule_weights(spark, SMALL)) == [1, 1, 1, 1]


def test_questions_are_composed_once(spark):
    # One for the turns, one for the planted ones, and the entries' words.
    assert steps(plan.knowledge_reach(spark, SMALL)) == [1, 1, 1]


def test_guards_change_nothing(spark):
    made = [
        "please do not tell anyone", "keep this secret", "get it: my-app_1.apk now", "earn 5 % daily returns", "your private video. pay or we send it. leak it", "by mistake sent rs 500 to you, return it", "transferred 5 by mistake rupees your refund the money",
        "scan this qr code to receive rs 50", "scan to get money", "power line will be cut, call", "gas stopped pay", "your parcel at customs held", "courier pending", "hotpot", "an otp", f"my o{text.ANY}p", f"{text.ANY}pi and q{text.ANY}", "lost money paid", "emi", "", None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*made, *plan.OPENINGS])], "i int, v string").withColumn("p", messages.prepared(F.col("v"))).localCheckpoint()
    p = F.col("p")
    for rule in messages.NEEDS:
        fits = p.rlike(messages.bounded(messages.RULES[rule][2][0]))
        rows = df.select(fits.alias("fits"), messages.may_fit(p, rule).alias("may")).collect()
        assert any(r["fits"] for r in rows) and all(r["may"] for r in rows if r["fits"]), rule
        assert not all(r["may"] for r in rows if r["may"] is not None), rule
    words = [w for _, ws in messages.INTENTS for w in ws]
    same = reduce(lambda a, b: a & b, [text.has_keyword(p, w).eqNullSafe(p.rlike(text.keyword(w))) for w in words])
    assert df.where(~same).count() == 0
