"""Lineage, policy, exit status, stages of a run, the label store in SQL, damaged events, readers, the name model in verdicts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.functions import registry
from riskloom.operators import assistant, benchmark, detectors, domain_model, evaluate, labels, lineage, links, names, selection
from riskloom.sources import tables
from riskloom.streaming import activity as stream


def test_fingerprints_do_not_depend_on_order_but_on_every_value(spark):
    rows = [(1, "a", None), (2, "b", 1.5), (2, "b", 1.5), (3, "", 0.0)]
    df = spark.createDataFrame(rows, "i int, t string, x double")
    one = lambda d: lineage.table_digest(d, "t").first()["digest"]
    base = one(df)
    assert base == one(df.repartition(3)) == one(df.orderBy(F.desc("i"))) == one(df.select("x", "t", "i"))
    others = [df.limit(3), df.distinct(), df.withColumn("t", F.upper("t")), df.fillna({"x": 0.0}), df.withColumnRenamed("t", "u"), df.union(df)]
    assert len({base, *map(one, others)}) == len(others) + 1
    a, b = (lineage.record({"t": d, "same": df}, {"policy": p}) for d, p in ((df, {"k": 1}), (df.withColumn("i", F.col("i") + 1), {"k": 2})))
    assert {tuple(r) for r in lineage.changes(a, b).collect()} == {("t", "content changed"), ("policy", "content changed")}
    assert {tuple(r) for r in lineage.changes(a, b.where("name <> 'same'").union(lineage.table_digest(df, "new"))).collect()} >= {("same", "missing"), ("new", "unrecorded")}
    assert lineage.changes(a, a).count() == 0 and lineage.run_key(a).first()[0] != lineage.run_key(b).first()[0]
    assert lineage.table_digest(df.limit(0), "t").first()["rows"] == 0


def test_policy_and_exit_status(spark):
    good = {**{k: str(v) for k, v in evaluate.POLICY.items()}}
    rows = [(1, k, v) for k, v in good.items()] + [(2, k, v) for k, v in (good | {"prevalence": "1", "near_jaccard": "x", "most_p95_ms": "-1", "colour": "red"}).items() if k != "least_precision"]
    got = lineage.policy_problems(spark.createDataFrame(rows, "p int, field string, value string"), ["p"])
    assert {tuple(r) for r in got.collect()} == {(2, "prevalence", "out of bounds"), (2, "near_jaccard", "not a number"), (2, "most_p95_ms", "out of bounds"), (2, "colour", "unknown"), (2, "least_precision", "missing")}
    of = lambda *s, **k: lineage.main(spark, spark.createDataFrame([(x,) for x in s], "status string"), **k)
    assert [of("PASS"), of("PASS", "FAIL"), of("INCONCLUSIVE"), of("INCONCLUSIVE", strict=True), of("NO_EVIDENCE"), of("NO_EVIDENCE", report=True), of("FAIL", report=True)] == [0, 1, 0, 1, 1, 0, 1]
    assert lineage.main(spark, spark.createDataFrame([], "status string")) == 1


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7))  # noqa: E731  keys have no digits
    texts = [(i, f"win a prize {word(i)} now claim it {word(i + 31)}" if i % 2 else f"see you at lunch {word(i)} in the garden {word(i + 31)}", i % 2) for i in range(200)]
    base = selection.prepared(spark.createDataFrame(texts, "id int, text string, y int"), "id", F.col("text"), F.col("y") == 1, "t")
    near = base.select("key").limit(0)
    folder = f"{tmp_path}/store"
    told, first = benchmark.run(base, near, folder, margins=(0.5, 0.9))
    rows = {(r["candidate"], r["margin"]): r for r in told.collect()}
    assert set(first.made) == {"features", "sizes", "scores", "ranked"} and {c for c, _ in rows} == set(benchmark.CANDIDATES)
    assert sum(r["winner"] for r in rows.values()) == 1 and all(r["recall"] > 0.9 for r in rows.values())
    assert min(r["bytes"] for r in rows.values()) == next(r["bytes"] for r in rows.values() if r["winner"]) or len({r["recall"] for r in rows.values()}) > 1
    again, second = benchmark.run(base.repartition(3), near, folder, margins=(0.5, 0.9))
    assert second.made == [] and sorted(map(str, again.collect())) == sorted(map(str, told.collect()))
    _, other = benchmark.run(base.where("id <> 7"), near, folder, margins=(0.5, 0.9))
    assert other.key != first.key and other.made
    none, _ = benchmark.run(base, near, folder, margins=(0.5, 0.9), policy={"most_model_bytes": 10})
    assert none.where("winner").count() == 0 and none.where("not over_budget").count() == 0


def test_label_store_in_sql(spark):
    lab = spark.createDataFrame([(m, a, (m * k) % 3 == 0) for m in range(30) for a, k in (("a", 1), ("b", 2 if m % 4 else 1))], "message_id int, annotator_id string, is_scam boolean")
    msg, adj = lab.select("message_id").distinct(), spark.createDataFrame([(1, True)], "message_id int, is_scam boolean")
    splits = msg.withColumn("stage", F.when(F.col("message_id") < 10, "s0").otherwise("s1"))
    assert registry.register_label_store(spark, msg, lab, adj, splits, "t_") == ["t_cohen_kappa", "t_export_rows"]
    want = labels.kappa(lab, "a", "b").first()["kappa"]
    assert spark.sql("select round(t_cohen_kappa('a', 'b'), 6) as k").first()["k"] == want
    assert spark.sql("select t_cohen_kappa('a', 'nobody') as k").first()["k"] is None
    for stage in ("s0", "s1", "none"):
        own = labels.export_rows(msg, splits, labels.final_labels(msg, lab, adj), stage)
        assert sorted(map(tuple, spark.sql(f"select * from t_export_rows('{stage}')").collect())) == sorted(map(tuple, own.select("message_id", "is_scam", "status").collect()))
    registry.register_functions(spark)
    got = spark.sql("select pii_check('call 98765 43210 or [PHONE]x [WHO] a.b@c @me ABCDE1234F') as p, pii_check('clean [OTP] text') as q, pii_check(null) as r").first()
    assert got["p"] == ["digits", "handle", "address", "pan", "unknown_placeholder", "glued"] and got["q"] == [] and not got["r"]


def test_reachable_nodes_in_fewest_steps(spark):
    edges = spark.createDataFrame([("f", "s", "a"), ("f", "a", "b"), ("f", "b", "s"), ("f", "b", "c"), ("f", "s", "c"), ("f", "x", "a"), ("f", "c", None), ("g", "s", "s"), ("h", "a", "b")], "flow string, node string, next string")
    assert sorted(map(tuple, assistant.reachable(edges, "s").collect())) == [("f", "a", 1), ("f", "b", 2), ("f", "c", 1), ("f", "s", 0), ("g", "s", 0)]
    assert assistant.reachable(edges.limit(0), "s").count() == 0


def test_damaged_lines_are_kept_beside_the_events(spark, tmp_path):
    lines = ['{"event_id": 1, "ts": "2024-01-01T10:00:00", "event_type": "view", "value": 2}', '{"event_id": 2, "event_type": null}', "", "{", "[1]", '"text"', '{"event_id": "x"}', '{"value": 3}', '{"event_id": 4, "value": "much"}', '{"event_id": 5, "more": {"a": 1}}']
    spark.createDataFrame([(x,) for x in lines[:6]] + [(None,)], "line string").write.parquet(f"{tmp_path}/in/a")
    source = lambda: spark.readStream.schema("line string").parquet(f"{tmp_path}/in/*")
    good, bad = stream.run_with_dead_letters(source(), folder=f"{tmp_path}/out")
    assert sorted(r["event_id"] for r in good.collect()) == [1, 2] and bad.count() == 5
    spark.createDataFrame([(x,) for x in lines[6:]], "line string").write.parquet(f"{tmp_path}/in/b")
    good, bad = stream.run_with_dead_letters(source(), folder=f"{tmp_path}/out")  # goes on with what is new
    assert sorted(r["event_id"] for r in good.collect()) == [1, 2, 5]
    assert sorted(str(r["line"]) for r in bad.collect()) == sorted([*lines[2:6], "None", *lines[6:9]])


def test_readers_return_what_they_cannot_use(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text("Text,LABEL\nhello,ham\n\"a, b\",Spam\nodd,unknown\nnothing,\n", encoding="utf-8")
    good, bad = tables.read_labelled_csv(spark, str(csv), "label", "text", ["ham", "spam"])
    assert sorted(map(tuple, good.collect())) == [("ham", "hello"), ("spam", "a, b")]
    assert sorted(map(tuple, bad.collect()), key=str) == sorted([("unknown", "odd"), (None, "nothing")], key=str)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("x.txt", "text")
    files = spark.createDataFrame([("good", whole.getvalue()), ("cut", whole.getvalue()[:20]), ("none", b""), ("null", None)], "path string, content binary")
    got = sorted(((r["path"], r["entry"], None if r["content"] is None else bytes(r["content"])) for r in tables.read_zip_entries(files).collect()), key=str)
    assert got == sorted([("good", "x.txt", b"text"), ("cut", None, None), ("none", None, None), ("null", None, None)], key=str)


def test_name_model_lifts_unexplained_addresses_only(spark, tmp_path):
    bad = [f"{a}{b}{i}.site" for i in range(12) for a in ("qx", "zv") for b in ("kk", "ww")]
    good = [f"{a}{b}{'n' * (i % 4)}.org" for i in range(12) for a in ("garden", "river") for b in ("house", "times")]
    rows = spark.createDataFrame([(n, n.split(".")[0], True) for n in bad] + [(n, n.split(".")[0], False) for n in dict.fromkeys(good)], "registrable string, name string, y boolean")
    model = domain_model.layout(rows, 3, 5)
    weights = domain_model.counted(rows, model)
    assert domain_model.problems(model, weights) == []
    scored = domain_model.scores(rows, model, weights).join(rows.select("registrable", "y"), "registrable")
    assert scored.where("y").agg(F.min("z")).first()[0] > scored.where("not y").agg(F.max("z")).first()[0]
    high = domain_model.high_names(scored, 0.0)
    df = spark.createDataFrame([("https://qxkk1.site/",), ("https://gardenhouse.org/",), ("https://sbi.co.in/",), ("http://sbi-kyc-verify.xyz/login",), ("https://unknown.net/",)], "link string")
    levels = lambda h: {r["link"]: r["level"] for r in links.judged(df, "link", h).collect()}
    without, with_model = levels(None), levels(high)
    changed = {k for k in without if without[k] != with_model[k]}
    assert changed == {"https://qxkk1.site/"} and without["https://qxkk1.site/"] == "unverified" and with_model["https://qxkk1.site/"] == "suspicious"
    version = domain_model.publish(model, weights, f"{tmp_path}/models")
    assert domain_model.publish(model, weights.repartition(3), f"{tmp_path}/models") == version
    held, stored = domain_model.read(spark, f"{tmp_path}/models", version)
    assert held == model and sorted(map(tuple, stored.collect())) == sorted(map(tuple, weights.select("feature", "q").collect()))
    stored.limit(1).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{tmp_path}/models/weights/{version}")
    with pytest.raises(ValueError):
        domain_model.read(spark, f"{tmp_path}/models", version)
    # Trained weights tell unseen names better than their length does.
    side = rows.withColumn("side", names.side(F.col("name")))
    best = domain_model.grid(side.where("side = 'train'"), side.where("side <> 'train'"), (3,), (0.003,), 5)[0]
    alone = {r["what"]: r["auc"] for r in domain_model.baselines(side.where("side <> 'train'")).collect()}
    assert best["auc"] > 0.9 and best["auc"] >= alone["hyphens"]


def test_scope_and_rank_bands(spark):
    df = spark.createDataFrame([("a.host.com", "host.com"), ("10.0.0.1", "0.1"), ("ok.net", "ok.net"), ("ünï.net", "ünï.net"), ("0x7f", "0x7f"), ("b.host.com", "host.com")], "host string, registrable string")
    assert {r["host"] for r in names.in_scope(df, names.platforms(df, 2)).collect()} == {"ok.net"}
    hosts = spark.createDataFrame([(f"h{i}", max(1, 300 // (i + 1))) for i in range(400)], "host string, pages int")
    a = names.ranked(hosts, "host", "pages")
    rows = a.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 401)) and [r["pages"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r["pages"] for r in rows), reverse=True)
    draw = lambda d: sorted(map(tuple, names.rank_bands(names.ranked(d, "host", "pages"), "host", [(1, 10, 4), (11, 100, 200), (101, 400, 7)]).collect()))
    got = draw(hosts)
    assert got == draw(hosts.repartition(7)) and [sum(b == k for _, _, b in got) for k in range(3)] == [4, 90, 7]


def test_redirects_and_short_links_by_form(spark):
    cases = [("https://a.com/x?go=https%3A%2F%2Fevil.net%2Fp", "https://evil.net/p"), ("https://a.com/x?u=https://b.a.com/", None), ("https://a.com/search?q=https://evil.net/", None), ("https://a.com/?one=https://a.com/&two=http://b.org/z", "http://b.org/z"), ("https://a.com/?x=evil.net", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, link string")
    got = {r["i"]: r["t"] for r in df.select("i", links.target_of(F.col("link")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]
    short = {"https://bit.ly/a1B": True, "https://t.co/Xy": True, "https://example.org/a1": False, "https://x.y.com/a1": False, "https://abc.de/about": False, "https://abc.de/a1?x=1": False}
    d = links.flagged(spark.createDataFrame([(k,) for k in short], "link string"), "link")
    assert {r["link"]: r["shortener"] for r in d.collect()} == short


def test_detectors_in_one_pass(spark):
    df = spark.createDataFrame([("Share your PIN and OTP now", True), ("see https://sbi-kyc-verify.xyz/login", True), ("lunch at noon", False), (None, False)], "text string, y boolean")
    f = detectors.flags(df, "text")
    got = {r["text"]: r for r in f.collect()}
    assert got["Share your PIN and OTP now"]["message_scam"] and not got["Share your PIN and OTP now"]["link_lenient"]
    assert got["see https://sbi-kyc-verify.xyz/login"]["link_strict"] and got["see https://sbi-kyc-verify.xyz/login"]["either"] and not got["see https://sbi-kyc-verify.xyz/login"]["both"]
    assert not any(got["lunch at noon"][n] for n in detectors.NAMES if n != "always") and got[None]["always"] and not got[None]["either"]
    rated = {r["detector"]: r for r in detectors.rated(f, "y").collect()}
    assert (rated["either"]["tp"], rated["either"]["fp"]) == (2, 0) and rated["never"]["flags_nothing"] and rated["always"]["fp"] == 2
    assert {r["detector"] for r in detectors.against(f, "y", "router").collect()} == set(detectors.NAMES) - {"router"}


def test_messages_without_a_link_do_not_meet_in_one_task(spark):
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    rows = [(i, None if i == 0 else "Share your OTP now" if i % 9 else "Look at http://sbi-kyc-verify.xyz/login") for i in range(400)]
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        flagged = detectors.flags(spark.createDataFrame(rows, "i int, text string").repartition(4), "text").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted(r["i"] for r in flagged) == list(range(400))
    assert {r["i"] for r in flagged if r["link_strict"]} == set(range(9, 400, 9)) and all(r["message_flagged"] for r in flagged if r["i"] % 9)
    assert len({r["task"] for r in flagged if r["i"] % 9}) == 4
