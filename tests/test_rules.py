"""The rule engine, masking, readers, ordered sums and the domain model on small cases."""

import re
import time
import zipfile

import pytest
import numpy as np
from pyspark.sql import functions as F

from riskloom.functions import stats
from riskloom.operators import assistant, domain_model, leakage, messages, names, privacy
from riskloom.sources import tables

#: Text and the rules that must and must not fire. Own wording.
CASES = [
    ("Please share your OTP with our agent to get the refund.", {"ask-secret"}, set()),
    ("Never share your PIN with anyone, bank staff included.", set(), {"ask-credential", "ask-secret"}),
    ("Do not share your OTP or PIN.", set(), {"ask-credential", "ask-secret"}),
    ("otp bhejo jaldi warna account band ho jayega", {"ask-secret", "threat"}, set()),
    ("OTP bejo abhi", {"ask-secret"}, set()),
    ("otp share na karen", set(), {"ask-secret"}),
    ("Send me your card number and CVV today", {"ask-credential"}, set()),
    ("Share the OTP with the delivery agent at your door.", set(), {"ask-secret"}),
    ("Share the OTP now. A delivery agent is near.", {"ask-secret"}, set()),
    ("Your OTP is 4821. Do not tell anyone.", set(), {"secrecy"}),
    ("Share your OTP now. Do not tell anyone.", {"secrecy", "ask-secret"}, set()),
    ("Stay on the call. Do not tell anyone.", {"secrecy", "stay-on-call"}, set()),
    ("kisi ko mat batana, police se bol raha hu", {"secrecy", "authority"}, set()),
    ("Rs 500 sent by mistake to you, please return the money", {"wrong-transfer"}, set()),
    ("Rs 500 sent by mistake, they will return the money to you", set(), {"wrong-transfer"}),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)] + [(99, None), (98, "")], "i int, text string")
    got = {r["i"]: {e["rule"] for e in r["evidence"] or []} for r in messages.evidence(df, "text").collect()}
    for i, (text, must, never) in enumerate(CASES):
        assert must <= got[i] and not never & got[i], (text, got[i])
    assert got[99] == got[98] == set()
    assert messages.evidence(df, "text").where(~messages.quotes_hold(messages.evidence(df, "text"))).count() == 0
    levels = {r["i"]: r["level"] for r in messages.verdict(df, "text").collect()}
    assert levels[1] == levels[2] == "nothing" and levels[6] == "scam"
    with_link = messages.verdict(df.where("i = 1"), "text", F.lit("scam")).first()
    assert (with_link["level"], with_link["family"]) == ("scam", "kyc")
    assert {r["intent"] for r in messages.told(messages.verdict(df, "text")).where("i = 6").collect()} == {"OTP Scam"}


MASKED = [
    ("call +49 30 1234567 or 9876543210", "call [PHONE] or [PHONE]"), ("a/c 123456789 and 1234 5678 9012 3456, id 2345 6789 0123", "a/c [ACCOUNT] and [CARD], id [ID_NUMBER]"),
    ("otp is 482913, write to a.b@mail.example.org. Pay shop1@okaxis or rita@ybl now", "otp is [OTP], write to [EMAIL]. Pay [UPI] or [UPI] now"), ("me @ home, see @some_name.", "me @ home, see [HANDLE]."),
    ("PAN ABCDE1234F, card XXXX 1234", "PAN [PAN], card [ACCOUNT]"), ("toll-free 1800 123 4567, 0801234567 and 91 98765 43210", "toll-free [PHONE], [PHONE] and [PHONE]"), ("12345678 stays", "12345678 stays"),
]


def test_masking(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MASKED)] + [(99, None)], "i int, text string")
    got = {r["i"]: r for r in privacy.left_over(privacy.scrub(df, "text")).collect()}
    for i, (_, want) in enumerate(MASKED):
        assert got[i]["masked"] == want and sum(got[i]["counts"].values()) == want.count("[")
    assert got[99]["masked"] is None and got[0]["left_over"] == []
    twice = privacy.scrub(privacy.scrub(df, "text").select("i", F.col("masked").alias("text")), "text")
    assert all(r["masked"] == r["text"] for r in twice.collect())


def test_readers_and_report(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_bytes('﻿a,b\r\n1,"x ""y"",\nz"\r\n2,\r\n'.encode())
    rows = tables.read_csv(spark, str(path), ["a", "b"]).select("a", "b").collect()
    assert [tuple(r) for r in rows] == [("1", 'x "y",\nz'), ("2", None)]
    tables.write_template(spark, str(tmp_path / "template"), ["p", "q"])
    with pytest.raises(Exception):
        tables.write_template(spark, str(tmp_path / "template"), ["p", "q"])
    with pytest.raises(ValueError):
        tables.markdown(spark.range(5), 4)
    assert tables.markdown(spark.range(2), 2).count("\n") == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inner.txt", "hello")


def test_ordered_sums(spark):
    rows = [(float(i * 37 % 101), i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "x double, n int")
    for down in (False, True):
        got = {r["x"]: r["s"] for r in stats.running(df, "x", {"s": "n"}, down).collect()}
        total = 0
        for x, n in sorted(rows, reverse=down):
            total += n
            assert got[x] == total
    assert stats.running(df.limit(0), "x", {"s": "n"}).count() == 0


def test_dialogue_graph_goes_on_to_its_end(spark):
    edges = spark.createDataFrame([("f", f"n{i}", f"n{i + 1}") for i in range(20)] + [("f", "n20", "n0"), ("f", "away", "far")], "flow string, node string, next string")
    assert assistant.reachable(edges, "n0").count() == 21


def test_near_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 7)
    texts = [" ".join(chr(97 + (i + k) % 26) + chr(97 + (i + k) // 26) for k in range(12)) for i in range(60)]
    keyed = leakage.keyed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    ids = {bytes(r["key"]): r["id"] for r in keyed.collect()}
    got = {tuple(sorted((ids[bytes(r["a"])], ids[bytes(r["b"])]))) for r in leakage.similar_keys(keyed, 0.8).collect()}
    sets = [set(t.split()) for t in texts]
    assert got == {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}


def test_near_keys_meet_on_parts(spark):
    rng = np.random.default_rng(5)
    sets = []
    for n in [*range(4, 40), 90, 91, 300]:
        base = [f"w{x}" for x in rng.choice(5000, n, replace=False)]
        for lost in (0, 1, n // 12, n // 6):
            sets.append(base[lost:] + [f"v{x}" for x in rng.choice(5000, lost // 2, replace=False)])
    keyed = spark.createDataFrame([(i, f"k{i}", s, i % 2 == 0) for i, s in enumerate(sets)], "id long, name string, words array<string>, side boolean")
    keyed = keyed.select("id", leakage.digest(F.col("name")).alias("key"), F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"), "side")
    own = [set(s) for s in sets]
    alike = lambda i, j: len(own[i] & own[j]) / len(own[i] | own[j])
    true = {(i, j): alike(i, j) for j in range(len(own)) for i in range(j) if min(len(own[i]), len(own[j])) >= 4}
    pairs = lambda df: sorted(tuple(sorted((r["ca"]["id"], r["cb"]["id"]))) for r in df.collect())
    assert pairs(leakage.similar_keys(keyed.drop("side"), 0.7, ("id",))) == sorted(p for p, x in true.items() if x >= 0.7)
    assert pairs(leakage.similar_keys(keyed, 0.85, ("id", "side"))) == sorted(p for p, x in true.items() if x >= 0.85 and (p[0] - p[1]) % 2)
    # Shuffled rows: far fewer than tokens, and few of the sets that share common tokens meet.
    apart = [[f"common{k}" for k in range(10)] + [f"own{i}_{k}" for k in range(40)] for i in range(200)]
    far = spark.createDataFrame([(i, s) for i, s in enumerate(apart)], "h long, words array<string>").select("h", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"), F.lit(False).alias("side"))
    sigs = leakage.signatures(far, 0.85)
    assert sigs.count() < 200 * 50 / 2 and sigs.groupBy("sig").count().where("count > 20").count() == 0


def test_sealed_rows_meet_the_first_near_row(spark):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    row = lambda i, drop: (i, " ".join(w for w in words if w not in drop))
    dev = leakage.keyed(spark.createDataFrame([row(5, []), row(3, ["wa"]), row(4, ["wb"]), (9, None)], "id long, text string"), "id", "text")
    sealed = leakage.keyed(spark.createDataFrame([row(1, ["wc"]), row(2, []), row(7, words[:9]), row(8, ["wc"]), (6, None)], "id long, text string"), "id", "text")
    assert {tuple(r) for r in leakage.find(dev, sealed).collect()} == {(2, 5, "exact"), (1, 3, "near"), (8, 3, "near")}
    assert {r["id"] for r in leakage.independent(sealed.select("id", "key", "tokens"), dev).collect()} == {6, 7}


def test_only_rows_that_may_leak_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"{chr(97 + x // 676)}{chr(97 + x // 26 % 26)}{chr(97 + x % 26)}" for x in rng.choice(17000, n, replace=False))
    texts = [text(n) for n in [1, 3, 4, 5, 12, 40, 90, 300] * 50]
    near = [" ".join(t.split()[len(t.split()) // 12 :]) + (" more" if len(t.split()) > 20 else "") for t in texts[:40]]
    keyed = lambda rows: leakage.keyed(spark.createDataFrame([*rows, (9999, None)], "id long, text string"), "id", "text")
    dev, sealed = keyed(enumerate(texts)), keyed(enumerate([*near, text(50), ""], 1000))
    alike = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    true = {(1000 + i, min(d), k) for i, t in enumerate(near) for d, k in [([j for j, x in enumerate(texts) if x == t], "exact"), ([j for j, x in enumerate(texts) if t not in texts and min(len(x.split()), len(t.split())) >= 4 and alike(x, t) >= 0.85], "near")] if d}
    assert {k for _, _, k in true} == {"exact", "near"}
    asked, own = [], leakage.similar_keys
    monkeypatch.setattr(leakage, "similar_keys", lambda keys, *a: asked.append(keys.count()) or own(keys, *a))
    assert {(s, texts.index(texts[d]), k) for s, d, k in leakage.find(dev, sealed).collect()} == {(s, texts.index(texts[d]), k) for s, d, k in true}
    assert asked[0] < 150  # of 400 dev keys and 42 others
    # A sketch that is full lets all rows pass.
    assert leakage.may_meet(dev, sealed, 0.85, 64).count() == 400


def test_personal_data_of_long_runs(spark):
    """Flags as the plain patterns give them, and runs are read once: from each character anew, the long ones would take minutes."""
    parts = ["a", "@", ".", "_", "-", "1", " ", "\n", "é", "ybl", "com", "[", "@@", "9876543210", "[PAN]"]
    rng = np.random.default_rng(11)
    texts = [None, "", *["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3000)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    flags = privacy.pii_flags(F.col("t"))
    got = {r["i"]: (r["handle"], r["address"]) for r in rows.select("i", *[flags[k].alias(k) for k in ("handle", "address")]).collect()}
    handle = re.compile(r"(?:^|[^A-Za-z0-9._-])@[A-Za-z0-9.-]")
    personal = lambda x, y: x != "" and (y.lower() in privacy.SUFFIXES or re.search("[0-9._-]", x) or "." in y)
    assert got == {i: (None, None) if t is None else (bool(handle.search(t)), any(personal(*m) for m in re.findall(privacy.ADDRESS, t))) for i, t in enumerate(texts)}
    masked = {r["i"]: (r["masked"], r["counts"]) for r in privacy.scrub(rows, "t").collect()}
    plain = F.col("t")
    for label, pattern, before in privacy.MASKS:
        plain = F.regexp_replace(plain, pattern, f"{before}[{label}]")
    assert {i: m for i, (m, _) in masked.items()} == {r["i"]: r["m"] for r in rows.select("i", plain.alias("m")).collect()}
    assert all(bool(c) == (m != texts[i]) for i, (m, c) in masked.items() if m is not None) and masked[0] == (None, {})
    long = spark.createDataFrame([("x" * 300_000 + " a@b",)], "t string")
    began = time.perf_counter()
    assert long.select(privacy.pii_flags(F.col("t"))["address"].alias("f")).first()["f"] is False
    assert time.perf_counter() - began < 10


def test_domain_model(spark):
    bad = [f"{a}-{b}{i}" for i in range(8) for a in ("secure", "login", "verify") for b in ("bank", "pay", "kyc")]
    good = [f"{a}{b}{'x' * (i % 3)}" for i in range(8) for a in ("garden", "river", "music") for b in ("house", "times", "club")]
    rows = [(n, f"{n}.{'top' if k % 3 else 'com'}", True) for k, n in enumerate(dict.fromkeys(bad))] + [(n, f"{n}.{'org' if k % 3 else 'com'}", False) for k, n in enumerate(dict.fromkeys(good))]
    df = spark.createDataFrame(rows, "name string, registrable string, y boolean")
    model, weights = domain_model.train(df, domain_model.layout(df, 3, 5))
    assert model.endings == ["com", "org", "top"] and domain_model.problems(model, weights) == []
    scored = domain_model.scores(df, model, weights).join(df, ["name", "registrable"])
    assert stats.auc(scored, F.col("z"), F.col("y")).first()["auc"] > 0.95
    model = domain_model.calibrate(scored, model, 0.01, 0.1)
    banded = domain_model.banded(scored, model)
    assert {r["band"] for r in banded.where("y").collect()} & {"high", "elevated"} and banded.where("band <> 'none' and not y").count() <= 0.15 * len(good)
    assert domain_model.at_threshold(scored, model.thresholds["elevated"]).first()["recall"] > 0.5
    print_1 = domain_model.fingerprint(model, weights)
    assert print_1 == domain_model.fingerprint(model, weights.repartition(3)) != domain_model.fingerprint(model, weights.withColumn("q", F.col("q") + 1))
    assert domain_model.problems(model, weights.limit(0)) == ["weights are missing"]
    assert domain_model.ending_place(model) is not None and names.band is not None
