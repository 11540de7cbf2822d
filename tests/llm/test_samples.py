"""Samples are of rows, not of all rows that share an id; vectors are hashed about their mean."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, langid, quality

EN, DE = "the cat sat on the mat with the dog and them", "der hund und die katze sind nicht im haus und hier"


def test_language_sample_takes_no_other_rows_of_an_id(spark, monkeypatch):
    rows = [(1, EN, "en"), (2, DE, "de"), (2, DE, "de"), (None, EN + " too", "en")] + [(1, f"zzz qqq {i}", None) for i in range(300)] + [(1, f"xx {i}", "xx") for i in range(300)]
    seen = {}

    class Model:
        def __init__(self, x, labels):
            seen["labels"] = sorted(labels)

    monkeypatch.setattr(langid, "Model", Model)
    langid.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id", per_language=20)
    assert seen["labels"] == ["de", "en", "en"] + ["xx"] * 20


def test_quality_sample_has_one_row_for_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good text here")] * 200 + [(1, f"good {i}") for i in range(200)] + [(2, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, x, y: seen.append((len(x), y.tolist())))
    quality.fit_quality(docs, labels, F.lit(True))
    assert seen == [(3, [1.0, 0.0, 0.0])]


@pytest.mark.parametrize("shift,scale", [(0, 1), (20, 1), (3, 0.01), (0, 1000)])
def test_recall_does_not_depend_on_where_vectors_lie(spark, shift, scale):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(6000, 32)) + shift) * scale
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10].tolist()) & got[q])
    assert hit >= 0.9 * 10 * 60
