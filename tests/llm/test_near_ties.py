"""Neighbours among many ties, and among vectors that rounding can hardly tell apart."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import ann


def test_ties_go_to_the_smaller_id(spark):
    rows = [(int(i), [float(k == d) for d in range(150)]) for k, i in enumerate(np.random.default_rng(0).permutation(150))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 140).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [*range(10)] * 10


def test_close_vectors_far_from_zero(spark):
    steps = np.random.default_rng(1).permutation(200)
    rows = [(i, [1e8, 1e8 + float(s) * 2**-20]) for i, s in enumerate(steps)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 200, 20):
        want = sorted((abs(int(s) - int(steps[q])), i) for i, s in enumerate(steps) if i != q)[:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in want]
