"""Cross-validation against a plain loop, suggestions, segments, detectors and SQL functions."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from riskloom.functions import registry
from riskloom.functions.text import dedup_key
from riskloom.operators import assistant, selection


def share(key, salt):
    return int(hashlib.sha256(f"{salt}|{key}".encode()).hexdigest()[:8], 16) / 4294967296


def lower_bound(k, n, z=1.96):
    p = k / n
    return max(0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def test_cross_validation_is_the_plain_loop(spark):
    words = ["alpha", "bravo", "cargo", "delta", "echoe", "fox", "golf", "hotel"]
    rows = [(i, " ".join([words[(i * k + k * k) % 8] for k in range(1, 7)] + (["prize"] if i % 3 == 0 and i % 10 else []) + [chr(97 + i % 26) * 3, chr(97 + i // 26) * 4]), i % 3 == 0) for i in range(240)]
    df = spark.createDataFrame(rows, "i long, t string, y boolean")
    got = selection.cross_validate(selection.prepared(df, "i", F.col("t"), F.col("y"), "s"), [0.6], least=2).first()

    def features(t):
        return set(re.findall("[a-z]{2,}", t.lower())) | {f"#len{min(9, len(t) // 200)}"}

    tally, without = dict.fromkeys(("tp", "fp", "fn", "tn"), 0), 0
    for f in range(5):
        rest = [(t, y) for _, t, y in rows if int(share(t, "s|cv") * 5) != f]
        fitting, inner = [r for r in rest if share(r[0], "s|inner") >= 0.25], [r for r in rest if share(r[0], "s|inner") < 0.25]
        p, n = sum(y for _, y in fitting), sum(not y for _, y in fitting)
        w = {}
        for x in set().union(*(features(t) for t, _ in fitting)):
            a, b = sum(y and x in features(t) for t, y in fitting), sum(not y and x in features(t) for t, y in fitting)
            if a + b >= 2:
                w[x] = round(math.log((a + 1) / (p + 2)) - math.log((b + 1) / (n + 2)), 3)
        score = lambda t: round(sum(w.get(x, 0) for x in features(t)), 3)  # noqa: B023, E731
        best = None
        for s in sorted({score(t) for t, _ in inner}):
            tp, fp = sum(y and score(t) >= s for t, y in inner), sum(not y and score(t) >= s for t, y in inner)
            if lower_bound(tp, tp + fp) >= 0.6 and (best is None or (tp, s) > best):
                best = (tp, s)
        if best is None:
            without += 1
            continue
        for _, t, y in rows:
            if int(share(t, "s|cv") * 5) == f:
                tally[("tp" if y else "fp") if score(t) >= best[1] else ("fn" if y else "tn")] += 1
    assert {k: got[k] for k in tally} == tally and got["without_threshold"] == without and tally["tp"] > 0


def test_leaked_keys_lie_in_two_folds(spark):
    rows = [(i, f"one two three four five six seven eight nine ten {w}") for i, w in enumerate(["red", "green", "blue", "black", "white", "grey", "pink"])] + [(99, "something else that is far from all of them")]
    base = selection.prepared(spark.createDataFrame(rows, "i long, t string").withColumn("y", F.lit(True)), "i", F.col("t"), F.col("y"), "s")
    folds = {r["key"]: r["fold"] for r in base.collect()}
    near = {r["key"] for r in selection.leaked(base, 0.8).collect()}
    assert near == {k for k, f in folds.items() if k.startswith("one") and any(g != f for m, g in folds.items() if m.startswith("one"))}


def test_cross_validation_shuffles_no_texts(spark):
    rows = spark.range(50).select(F.col("id").alias("i"), F.concat_ws(" ", F.lit("some words of a text"), F.col("id")).alias("t"), (F.col("id") % 2 == 0).alias("y"))
    base = selection.prepared(rows, "i", F.col("t"), F.col("y"), "s")
    plan = selection.cross_validate(base, [0.6], near=base.select("key").where("id = 7"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"Join LeftAnti|Join Inner", line)]
    assert any("digest" in line for line in joins) and not any(re.search(r"\b(?:key|feature)#", line) for line in joins)


def test_suggestions_fill_up_with_starters(spark):
    q = spark.createDataFrame([(1, "refund"), (1, "refund"), (1, "bank"), (2, "nothing"), (3, "start")], "key long, word string")
    e = spark.createDataFrame([("money", 5, "refund"), ("banks", 6, "bank"), ("other", 7, "bank"), ("s1", 8, "start")], "entry string, ord int, word string")
    w = spark.createDataFrame([("refund", 3.0), ("bank", 2.0), ("start", 1.0)], "word string, idf double")
    got = {}
    for r in assistant.suggestions(q, e, w, ["s0", "s1", "s2"]).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(r["entry"])
    assert got == {1: ["money", "banks", "other"], 2: ["s0", "s1", "s2"], 3: ["s1", "s0", "s2"]}


def test_segments(spark):
    df = spark.createDataFrame([(1, "pay now or lose it"), (2, "no such words"), (3, None)], "k int, t string")
    got = {r["k"]: r["segments"] and [tuple(s) for s in r["segments"]] for r in assistant.segments(df, "k", "t", [("lose it", "threat"), ("now", "urgency")]).collect()}
    assert got == {1: [("pay ", None), ("now", "urgency"), (" or ", None), ("lose it", "threat")], 2: None, 3: None}
    overlap = assistant.segments(df.where("k = 1"), "k", "t", [("pay now", "a"), ("now or", "b")]).first()
    assert overlap["segments"] is None


def test_sql_functions_and_detectors(spark):
    assert "normalize_for_dedup" in registry.register_functions(spark)
    df = spark.createDataFrame([("Call  [PHONE] 1930 NOW ",), ("",), (None,)], "t string")
    assert df.select(F.expr("normalize_for_dedup(t)").eqNullSafe(dedup_key(F.col("t"))).alias("same")).where("not same").count() == 0
    low, high = spark.sql("select wilson_low(8, 10), wilson_high(8, 10)").first()
    assert abs(low - lower_bound(8, 10)) < 1e-9 and low < 0.8 < high <= 1
    d = registry.Detectors()
    d.add("shout", lambda c: c.contains("NOW"))
    assert [tuple(r)[1:] for r in d.flags(df, "t").collect()] == [(True, False, True), (True, False, False), (True, False, False)]
