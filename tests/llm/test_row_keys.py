"""Rows with null or repeated ids are rows of their own."""

import pytest

from riskloom.llm import mixing, simhash

DOCS = "doc_id long, text string, source string"
TEXTS = [" ".join(f"{w}{k}" for k in range(12)) for w in ("alpha", "brick", "cloud", "dune", "ember")]


def test_rows_with_null_or_repeated_ids_are_kept(spark):
    rows = [(None, TEXTS[0], "a"), (None, TEXTS[1], "a"), (None, TEXTS[1], "b"), (7, TEXTS[2], "a"), (7, TEXTS[3], "a"), (8, TEXTS[3], "a"), (None, TEXTS[2], "a"), (None, None, "a"), (9, "", "b"), (7, TEXTS[4], "a"), (3, TEXTS[4], "a")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "text").collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept)) == sorted([(0, TEXTS[0]), (0, TEXTS[1]), (7, TEXTS[2]), (7, TEXTS[3]), (9, ""), (3, TEXTS[4])])


@pytest.mark.parametrize("same", [None, 5])
def test_mix_of_rows_without_own_id(spark, same):
    rows = [(same, " ".join(f"{s}{i}w{k}" for k in range(10)), s) for s in "ab" for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs).groupBy("source", "text").count().collect()
    assert {s: sum(r["count"] for r in got if r["source"] == s) for s in "ab"} == {"a": 14, "b": 6}
    again = mixing.mixed(docs.repartition(5)).groupBy("source", "text").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
