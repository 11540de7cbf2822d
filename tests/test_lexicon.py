"""Phrases in tokens: the automaton and the join against a plain search, wildcards, numbers, order, three scripts."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.functions.text import ANY
from riskloom.operators import lexicon, messages

ROWS = [("a", 0, "pay now"), ("a", 1, "pay now please"), ("a", 2, "pin"), ("a", 3, "pan"), ("b", 0, "now"), ("b", 1, "within # hours"), ("b", 2, "#"), ("c", 0, "khata band"), ("c", 1, "खाता बंद"), ("c", 2, "మీరు గెలిచారు"), ("c", 3, "now now")]


def same(token, word):
    t, w = lexicon.folded(token), lexicon.folded(word)
    if word == "#":
        return bool(re.fullmatch("[0-9]+", token))
    return len(t) == len(w) and all(x in (y, ANY) for x, y in zip(t, w))


def plain(tokens, rows):
    """The first phrase by ord of each list at each place."""
    out = {}
    for name, order, phrase in sorted(rows, key=lambda r: r[1]):
        words = phrase.split()
        for i in range(len(tokens) - len(words) + 1):
            if all(same(t, w) for t, w in zip(tokens[i:], words)):
                out.setdefault((i, name), (order, len(words)))
    return sorted((i, name, *v) for (i, name), v in out.items())


def texts(n):
    r = random.Random(3)
    words = ["pay", "now", "please", "pin", f"p{ANY}n", f"{ANY * 3}", "within", "12", "7", "hours", f"h{ANY}urs", "khata", "kata", "band", "bandh", "खाता", "बंद", "మీరు", "గెలిచారు", "other", "#"]
    return [[r.choice(words) for _ in range(r.randrange(9))] for _ in range(n)] + [[], None]


def test_automaton_against_a_plain_search():
    lists = texts(400)
    got = lexicon.Automaton(ROWS).find(pa.array(lists, pa.list_(pa.string())))
    assert len(got) == len(lists)
    for tokens, hits in zip(lists, got.to_pylist()):
        assert sorted((h["start"], h["id"], h["ord"], h["words"]) for h in hits) == plain(tokens or [], ROWS)
    part = pa.array(lists, pa.list_(pa.string())).slice(7, 50)  # a slice begins inside its buffers
    assert lexicon.Automaton(ROWS).find(part).to_pylist() == got.slice(7, 50).to_pylist()
    assert lexicon.Automaton([]).find(pa.array(lists, pa.list_(pa.string()))).to_pylist() == [[]] * len(lists)


@pytest.mark.parametrize("most", [50, 0])
def test_phrase_hits_by_automaton_and_by_join(spark, most):
    lists = texts(120)
    df = spark.createDataFrame(list(enumerate(lists)), "i int, tokens array<string>")
    lex = spark.createDataFrame(ROWS, "id string, ord int, phrase string")
    text = {(n, o): p for n, o, p in ROWS}
    got = lexicon.phrase_hits(df, ["i"], "tokens", lex, most)
    assert got.columns == ["i", "pos", "id", "phrase"]
    assert sorted(map(tuple, got.collect())) == sorted((i, at, n, text[n, o]) for i, t in enumerate(lists) for at, n, o, _ in plain(t or [], ROWS))


def test_own_lists():
    rows = lexicon.phrases()
    assert len(rows) > 500 and len({(k, p) for k, _, p in rows}) == len(rows)
    scripts = {s for _, _, p in rows for s in ("latin" if re.search("[a-z]", p) else "", "deva" if re.search("[ऀ-ॿ]", p) else "", "telugu" if re.search("[ఀ-౿]", p) else "") if s}
    assert scripts == {"latin", "deva", "telugu"}
    for _, _, p in rows:  # every phrase is made of whole tokens and finds itself
        assert re.findall(lexicon.TOKEN, p.replace("#", "7")) == p.replace("#", "7").split(), p
    hits = lexicon.own_automaton().find(pa.array([p.replace("#", "7").split() for _, _, p in rows])).to_pylist()
    assert all(any(h["id"] == k and h["start"] == 0 for h in found) for (k, _, _), found in zip(rows, hits))
    for rule, (_, _, patterns, lists) in messages.RULES.items():
        assert set(lists) <= set(lexicon.PATTERNS) and (patterns or lists or rule.startswith("ask-"))


def test_expand():
    assert lexicon.expand("a (b|c d) [e|f] g") == ["a b g", "a b e g", "a b f g", "a c d g", "a c d e g", "a c d f g"]
    with pytest.raises(ValueError):
        lexicon.expand("(a|b|c|d|e|f|g|h)" * 4)


DISGUISED = [
    ("please forward the o t p now", {"ask-secret"}), ("p@ssword bhejo", {"ask-credential"}), ("ｓｈａｒｅ your ＯＴＰ", {"ask-secret"}), ("u​rgent: cl@im your pr1ze and c@ll us b4ck", {"prize", "urgency", "callback"}),
    ("уоu wоn", {"prize"}), ("खाता बंद, तुरंत केवाईसी अपडेट करें", {"threat", "urgency", "kyc"}), ("మీరు గెలిచారు", {"prize"}), ("Stay, on this call!", {"stay-on-call"}), ("khaata bandh hoga", {"threat"}), ("n e v e r share your pin", set()),
    ("send your O-T-P, acc0unt bl0cked", {"ask-secret", "threat"}), ("ТURANT", {"urgency"}), ("pay 15000 on 10-10, room A4 or C3PO", set()), ("the p!n|up board is in the hall", set()), ("your otp is 4. kisi ko mat batana", set()), ("kisi ko mat batana. hello", {"secrecy"}),
]


def test_disguised_messages(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DISGUISED)], "i int, text string")
    e = messages.evidence(df, "text")
    got = {r["i"]: {x["rule"] for x in r["evidence"]} for r in e.collect()}
    assert got == {i: want for i, (_, want) in enumerate(DISGUISED)}
    assert e.where(~messages.quotes_hold(e)).count() == 0
    quotes = {r["i"]: {x["rule"]: x["quote"] for x in r["evidence"]} for r in e.collect()}
    assert quotes[7] == {"stay-on-call": "stay, on this call"} and quotes[3]["prize"] == f"cl{ANY}im your pr{ANY}ze"
    assert messages.evidence(df.limit(0), "text").collect() == []
    assert df.select(messages.intent(F.col("text")).alias("k")).where("k = 'otp'").count() >= 4


def test_hits_do_not_depend_on_slices_nor_memory_on_the_batch():
    found = lexicon.Automaton([("a", 0, "stay on call"), ("b", 0, "call"), ("a", 1, "# days")])
    row = ["please", "stay", "on", "call", "5", "days"]
    lists = pa.array([row, None, [], ["call"] * 9, row[2:]] * 40, pa.list_(pa.string()))
    whole = found.find(lists).to_pylist()
    assert len(whole) == 200 and whole[0] == found.find(lists.slice(0, 1)).to_pylist()[0] and len(whole[0]) == 3
    assert all(found.find(lists, most).to_pylist() == whole for most in (1, 7, 50)) and len(found.find(lists.slice(0, 0))) == 0
    many = pa.array([["call", "x", "y", "z"] * 100] * 4000, pa.list_(pa.string()))
    tracemalloc.start()
    found.find(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 1.6 million tokens
