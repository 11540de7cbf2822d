"""Knowledge matching against a plain greedy loop; patterns that nothing can reach."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from riskloom.operators import assistant, knowledge, lexicon

ENTRIES = {"a": ["pay/send money + link/url", "refund~ + slow"], "b": ["money + money"], "c": ["link + fake/real/is it real"], "d": ["the + of"], "e": ["transferred + back"], "f": ["upi pin/pin + receive"], "g": ["scam~"]}


def weight(words, entries):
    used = defaultdict(set)
    for e, patterns in entries.items():
        for w in " / ".join(patterns).replace("+", "/").replace("/", " ").split():
            used[w.rstrip("~")].add(e)
    idf = [0 if w in knowledge.STOP else math.log(len(entries) / len(used[w])) for w in (x.rstrip("~") for x in words)]
    return max(2.2, max(idf) + 0.4 * (len(words) - 1)) if len(words) > 1 else max(idf) or 0.25


def same(token, word):
    if word.endswith("~"):
        return token.startswith(word[:-1])
    return token == word or (min(len(token), len(word)) >= 5 and lexicon.folded(token) == lexicon.folded(word))


def plain(tokens, entries):
    """entry: best score, group by group: the weightiest alternative that is free, at its first place."""
    out = {}
    for e, patterns in entries.items():
        for p in patterns:
            used, score, rare = set(), 0.0, False
            for group in p.split(" + "):
                best = None
                for alt in group.split("/"):
                    words = alt.split()
                    at = next((i for i in range(len(tokens) - len(words) + 1) if all(i + j not in used and same(tokens[i + j], w) for j, w in enumerate(words))), None)
                    w = weight(words, entries)
                    if at is not None and (best is None or w > best[0]):
                        best = (w, at, len(words))
                if best is None:
                    break
                used |= set(range(best[1], best[1] + best[2]))
                score, rare = score + best[0] ** 2, rare or best[0] >= knowledge.DISTINCTIVE
            else:
                if rare:
                    out[e] = max(out.get(e, 0), round(score, 6))
    return out


def test_matching_against_a_plain_loop(spark):
    r = random.Random(5)
    words = ["pay", "send", "money", "link", "url", "refunds", "slow", "fake", "real", "is", "it", "the", "of", "transferred", "transfered", "back", "upi", "pin", "receive", "scammer", "other"]
    asked = [[r.choice(words) for _ in range(r.randrange(1, 8))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, t array<string>")
    met = knowledge.met_patterns(df, ["i"], "t", ENTRIES)
    got = defaultdict(list)
    for row in knowledge.rank(met, ["i"]).orderBy("i", "rank").collect():
        got[row["i"]].append((row["entry"], row["score"], row["margin"]))
    for i, tokens in enumerate(asked):
        want = sorted(plain(tokens, ENTRIES).items(), key=lambda x: (-x[1], list(ENTRIES).index(x[0])))
        assert [(e, s) for e, s, _ in got[i]] == want, tokens
        assert [m for *_, m in got[i]] == [round(a[1] - b[1], 6) for a, b in zip(want, want[1:])] + [None] * bool(want)
    # One word cannot meet two groups, and two equal words can.
    assert "b" not in plain(["money"], ENTRIES) and not [e for row, e in enumerate(asked) if e == ["money"] and got[row]]


def test_what_nothing_reaches(spark):
    dead = {(r["entry"], r["filled"]) for r in knowledge.dead_patterns(spark, ENTRIES).collect()}
    assert ("d", "the of") in dead and not {e for e, _ in dead} & {"a", "c", "e", "f", "g"}
    assert knowledge.dead_patterns(spark).count() == 0 and len(knowledge.ENTRIES) >= 60
    df = spark.createDataFrame([(1, ["scammers"]), (2, ["link", "fake"])], "i int, t array<string>")
    met = knowledge.met_patterns(df, ["i"], "t", ENTRIES)
    assert {r["entry"] for r in knowledge.unreached(spark, met, ENTRIES).collect()} == set(ENTRIES) - {"c", "g"}
    assert {r["entry"]: r["questions"] for r in knowledge.reach(spark, met, ["i"], ENTRIES).where("questions > 0").collect()} == {"c": 1, "g": 1}
    assert knowledge.met_patterns(df.limit(0), ["i"], "t").collect() == []


def test_own_entries_answer_their_questions(spark):
    asked = [("what is digital arrest?", "arrest-video"), ("can u tell me is the link fake", "link-check"), ("How do I report a fraud online?", "report-online"), ("who made this app", "tool-maker"), ("Part-time job pay genuine?", "job-task"), ("ＯＴＰ shared!", "otp-shared")]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "i int, text string").withColumn("t", knowledge.tokens(F.col("text")))
    best = {r["i"]: r["entry"] for r in knowledge.rank(knowledge.met_patterns(df, ["i"], "t"), ["i"]).where("rank = 1").collect()}
    assert best == {i: e for i, (_, e) in enumerate(asked)}
    shapes = df.select(knowledge.askable(F.col("t"), assistant.is_question(F.col("text"))).alias("ok")).collect()
    assert all(r["ok"] for r in shapes)
    long = spark.createDataFrame([("word " * 25,), ("",), (None,), ("Your bill of the month is due on Friday at the bank",)], "text string")
    assert not any(r["ok"] for r in long.select(knowledge.askable(knowledge.tokens(F.col("text")), assistant.is_question(F.col("text"))).alias("ok")).collect())
