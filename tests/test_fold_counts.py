"""Benchmark runs write counts of features, not rows of them, and weigh texts alike by either way."""

from pyspark.sql import functions as F

from riskloom.operators import benchmark, selection, textmodel


def rows(spark, n=160):
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7))
    texts = [(i, f"win a prize {word(i)} now" if i % 3 else f"see you at lunch {word(i)} in the garden!", i % 3 > 0) for i in range(n)] + [(n, "", True), (n + 1, None, True)]
    return selection.prepared(spark.createDataFrame(texts, "id int, t string, y boolean"), "id", F.col("t"), F.col("y"), "s")


def test_stored_features_are_counts(spark, tmp_path):
    base = rows(spark)
    _, stages = benchmark.run(base, base.select("key").limit(0), f"{tmp_path}/store", margins=(0.5,))
    stored = spark.read.parquet(f"{stages.folder}/{stages.key}/features")
    kinds = sum(base.select(F.explode(part(F.col("t"))).alias("x")).distinct().count() for part in benchmark.PARTS.values())
    assert stored.count() == kinds


def test_candidates_by_parts_and_by_functions_agree(spark, tmp_path):
    base, near = rows(spark), rows(spark).select("key").limit(0)
    tilde = lambda t: F.concat(textmodel.words(t), F.transform(textmodel.ngrams(t, 3, 3), lambda g: F.concat(F.lit("~"), g)))
    plain = {"words": textmodel.words, "words_flags": textmodel.features, "trigrams": benchmark.PARTS["trigrams"], "words_trigrams": tilde}
    told = [sorted(map(str, benchmark.run(base, near, f"{tmp_path}/{k}", c, margins=(0.5, 0.8))[0].collect())) for k, c in (("parts", benchmark.CANDIDATES), ("plain", plain))]
    assert told[0] == told[1] and len(told[0]) == 8


def test_many_weights_meet_by_a_shuffle(spark):
    base, parts = rows(spark), [textmodel.words, textmodel.marks]
    weights = selection.fold_weights(selection.identified(base), selection.fold_counts(base, parts), 2)
    sent, met = (selection.fold_sums(base, weights, parts, most=most) for most in (1 << 20, 3))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, sent.collect())) == sorted(map(str, met.collect())) and sent.count() > 200


def test_cross_validation_shuffles_no_rows_of_features(spark):
    base = rows(spark)
    near = base.select("key").where("id % 40 = 1")
    digests = near.select(selection.leakage.digest(F.col("key")).alias("digest"))
    told = [selection.cross_validate(base, [0.6], least=2, near=x) for x in (near, digests)]
    assert "hashpartitioning(g#" not in told[0]._jdf.queryExecution().executedPlan().toString()
    assert told[0].collect() == told[1].collect() != selection.cross_validate(base, [0.6], least=2).collect()
