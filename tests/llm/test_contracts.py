"""Columns and digests of the registered queries, and the dynamic programmes against enumeration."""

import hashlib
import math
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common, langid, pii, queries

TEXTS = ["the cat sat on the mat with them", "der hund und die katze sind nicht im haus", "le chat est dans la maison avec nous", "el perro y la gata no estan en la casa", None, "", "12 !!", "mail a.b@c.de or call +49 30 1234567, ip 10.0.0.1, card 4111 1111 1111 1111", "call me 49 30 1234567 now"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, TEXTS[i % len(TEXTS)], ("en", "de", "fr", "es", None)[i % 5], f"s{i % 2}", "x") for i in range(60)] + [(None, "the dog", "en", None, "x"), (7, TEXTS[0], "en", "s0", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(210)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


COLUMNS = {
    "op1_bpe_tree": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_fingerprint_lcp": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_maxent_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_simhash_pigeonring": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_prefix_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_pii_semicrf": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_quality_fm": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == COLUMNS[name]
    got = df.collect()
    if name == "op7_prefix_forest":
        x = {i: np.array([i % 7, 1.0, i]) for i in range(210)}
        for q in (0, 100, 200):
            want = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
            have = [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert have == want
        return
    assert len(got) == 62 and sorted(r["doc_id"] is None for r in got)[-1] is True
    mod = {"op3_language_id": (4, 2), "op4_maxent_lm": (10, 0), "op9_quality_fm": (5, 0)}.get(name)
    for r in got:
        text = "the dog" if r["doc_id"] is None else TEXTS[r["doc_id"] % len(TEXTS)]
        if mod and r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod[0] == mod[1])
        if name == "op3_language_id":
            assert (r["lang_pred"] == "und") == (not re.search("[a-z]", text or "")) and 0 <= r["score"] <= 1
        if name == "op9_quality_fm":
            assert r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
        if name == "op8_pii_semicrf" and r["doc_id"] not in (None, 7):  # two texts have id 7
            base = [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text or "")]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]


def segmentations(n, cands):
    """All ways to cut n tokens into candidate spans and single tokens: lists of (i, j, kind, features)."""
    if n == 0:
        yield []
        return
    for rest in segmentations(n - 1, cands):
        yield rest
    for i, kinds, f in cands.get(n, ()):
        for rest, k in product(segmentations(i, cands), kinds):
            yield [*rest, (i, n, k, f)]


def worth(field, spans, margin):
    return sum(field.w[k, f].sum() - margin for _, _, k, f in spans) + field.side * sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("text", ["call 49 30 1234567 now", "bob at x.de or al@b.co", "+1 (555) 123-4567", "4111 1111 1111 1111"])
def test_dynamic_programmes_against_enumeration(text):
    rng = np.random.default_rng(len(text))
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    cands = pii.candidates(text, tokens)
    for _ in range(5):
        field = pii.Field()
        field.w, field.fitted = rng.normal(size=field.w.shape), True
        every = list(segmentations(len(tokens), cands))
        best = max(every, key=lambda s: worth(field, s, pii.MARGIN))
        got = field.decode(text, 0, len(text), [])
        want = [(pii.KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k, _ in best]
        score = lambda spans: worth(field, [next((i, j, pii.KINDS.index(k), f) for j, own in cands.items() for i, _, f in own if tokens[i][0] == a and tokens[j - 1][1] == b) for k, a, b in spans], pii.MARGIN)
        assert math.isclose(score(got), score(want), abs_tol=1e-9)
        grad, want_grad = np.zeros_like(field.w), np.zeros_like(field.w)
        field.gradient(len(tokens), field.scores(cands), set(), grad)
        p = np.exp([worth(field, s, 0.0) for s in every])
        for s, share in zip(every, p / p.sum()):
            for _, _, k, f in s:
                np.subtract.at(want_grad[k], f, share)
        assert np.allclose(grad, want_grad)


def test_margins_against_plain_sums():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in (1, 2, 3, 40, 0, 7)]
    x = rng.random((8, sum(langid.SIZES))).astype(np.float32)
    model = langid.Model(x, ["en", "de", "fr", "es"] * 2)
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    plain = langid.frequencies(data, ends) @ np.concatenate(model.weights) + model.bias
    assert np.allclose(model.margins(data, ends), plain, atol=1e-4)


def test_hot_keys_join_as_others_do(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").select("k", "id", "m").collect()))
    assert sorted(map(tuple, common.join_hot(left, right, "k", "n").select("k", "id", "m").collect())) == want
    assert common.join_hot(left, right.where("k % 2 = 1"), "k", "n", "left").count() == 1000
