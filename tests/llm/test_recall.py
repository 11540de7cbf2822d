"""Recall of the prefix forest against brute force where it prunes, and how many vectors a query is compared with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann

N, ASK = 24_000, 200


def vectors(kind: str) -> np.ndarray:
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, 64))
    if kind == "clustered":
        x = rng.normal(size=(240, 64))[rng.integers(0, 240, N)] + 0.35 * x
    return np.round(x / np.linalg.norm(x, axis=1)[:, None], 6)


def candidate_rows(spark, rows, total):
    points = ann.cut(ann.hashed(ann.distinct_vectors(rows, 10)).withColumn("pid", F.monotonically_increasing_id()))
    return ann.candidates(*ann.dealt(points, total), ann.TREES * 11 + ann.GOAL * total ** (2 / 3))


@pytest.mark.parametrize("kind", ["clustered", "unstructured"])
def test_recall_where_the_forest_prunes(spark, kind):
    x = vectors(kind)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asks = np.arange(0, N, ASK)
    got: dict[int, list[int]] = {}
    for r in ann.nearest(df, F.col("vec_id") % ASK == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = 0
    for q in asks.tolist():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10].tolist()) & set(got[q]))
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % ASK == 0).alias("asks"), F.col("vec_id").cast("string").alias("key"))
    each = candidate_rows(spark, rows, N).groupBy("pid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pids")))).alias("n"))
    n, most = each.agg(F.avg("n"), F.max("n")).first()
    print(f"{kind}: recall {hit / (10 * len(asks)):.3f}, compared {n / N:.3f} (at most {most / N:.3f})")
    assert hit >= 0.9 * 10 * len(asks) and n < 0.5 * N
