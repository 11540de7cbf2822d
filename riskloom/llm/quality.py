"""Quality scores by a factorisation machine.

Features: hashed words (relative frequencies), statistics of a text's structure, and its length as metadata. All pairs of
features interact through vectors of rank K; by the sum-of-squares identity, half of (sum of v x)^2 - sum of (v x)^2, a text
is scored in time linear in its words. The machine is fitted by Adam on a bounded sample of labelled rows.

Null texts count as empty; an empty text has its structure statistics only and is scored like any other. Equal texts have
equal scores. Without labelled rows, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, passes, prepare, quoted, utf8, with_arrow, word_hashes, word_spans

#: The machine is fitted on so many labelled rows of either label at most: those whose id hashes lowest.
SAMPLE_PER_LABEL = 1500
BITS, RANK = 14, 8
#: Structure statistics, after the hashed words.
STATS = ["upper", "digit", "mark", "high", "space", "lines", "word_length", "one_letter", "marked_words", "distinct", "length"]
SIZE = (1 << BITS) + len(STATS)

KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 mark, 4 not ASCII, 5 space, 6 line end
KIND[65:91] = 1
KIND[48:58] = 2
for _b in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
    KIND[_b] = 3
KIND[128:] = 4
KIND[[32, 9, 11, 12, 13]] = 5
KIND[10] = 6


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the sparse feature matrix, by row."""
    n = len(ends) - 1
    size = np.maximum(np.diff(ends), 1)
    row_of = np.repeat(np.arange(n), np.diff(ends))
    kinds = np.bincount(row_of * 7 + KIND[data], minlength=7 * n).reshape(n, 7) / size[:, None]
    starts, stops, words = word_spans(data, ends)
    h = (word_hashes(LOWER[data], starts, stops) >> np.uint64(64 - BITS)).astype(np.int64)
    doc = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1)
    key, count = np.unique((doc << BITS) | h, return_counts=True)
    rows, cols = key >> BITS, key & ((1 << BITS) - 1)
    length = stops - starts
    marked = KIND[data[stops - 1]] == 3 if len(stops) else np.zeros(0, bool)
    stats = np.stack([
        *(kinds[:, k] for k in range(1, 7)),
        np.bincount(doc, length, n) / many / 10, np.bincount(doc, length == 1, n) / many, np.bincount(doc, marked, n) / many,
        np.bincount(rows, minlength=n) / many, np.log1p(np.diff(ends)) / 12,
    ], axis=1)
    s = len(STATS)
    return (
        np.concatenate([rows, np.repeat(np.arange(n), s)]), np.concatenate([cols, np.tile(np.arange(1 << BITS, SIZE), n)]),
        np.concatenate([count / many[rows], stats.ravel()]).astype(np.float64),
    )


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
        self.fitted = False

    def raw(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[cols] * x[:, None]
        total = np.stack([np.bincount(rows, vx[:, k], n) for k in range(RANK)], axis=1)
        squares = np.bincount(rows, np.einsum("ij,ij->i", vx, vx), n)
        return self.bias + np.bincount(rows, self.w[cols] * x, n) + 0.5 * ((total**2).sum(axis=1) - squares), total

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, l2: float = 1e-5) -> None:
        """Adam over batches in a fixed order; y is 0 or 1."""
        if not len(y):
            return
        self.fitted = True
        rng = np.random.default_rng(11)
        params = [self.w, self.v]
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = np.log(share / (1 - share))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                rows = np.repeat(np.arange(len(own)), [len(docs[k][0]) for k in own])
                cols = np.concatenate([docs[k][0] for k in own])
                x = np.concatenate([docs[k][1] for k in own])
                z, total = self.raw(rows, cols, x, len(own))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                gx = g[rows] * x
                grads = [np.bincount(cols, gx, SIZE) + l2 * self.w, np.stack([np.bincount(cols, gx * (total[rows, k] - self.v[cols, k] * x), SIZE) for k in range(RANK)], axis=1) + l2 * self.v]
                t += 1
                self.bias -= rate * g.sum()
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for p, d, a, b in zip(params, grads, m, s):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= step * a / (np.sqrt(b) + 1e-8)

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        if not self.fitted:
            return np.full(n, 0.5)
        z, _ = self.raw(*features(data, ends), n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """A machine fitted on at most per_label rows of either label; only their sparse features reach the driver."""
    prepare(docs.sparkSession)
    own = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    chosen = None
    for y in (0, 1):
        some = own.where(F.col("y") == y).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(per_label).select("id", "y")
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.where(train).select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(chosen.distinct()), "id")

    def make(texts):
        out = []
        for i, j in passes(texts):
            r, c, x = features(*utf8(texts.slice(i, j - i)))
            order = np.argsort(r, kind="stable")
            at = np.searchsorted(r[order], np.arange(j - i + 1))
            out += [(c[o].astype(np.int32).tobytes(), x[o].astype(np.float32).tobytes()) for o in (order[at[k] : at[k + 1]] for k in range(j - i))]
        return pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())

    # Of rows with one id, that with the least digest stands for all: an id is one labelled row, however often it is repeated.
    told = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    least = F.broadcast(told.groupBy("id", "y").agg(F.min("digest").alias("digest")))  # at most per_label rows of either label
    rows = told.join(least, ["id", "y", "digest"])
    got = with_arrow(rows, ["text"], [T.StructField("c", T.BinaryType()), T.StructField("x", T.BinaryType())], make, ["id", "y"]).dropDuplicates(["id", "y"]).collect()
    got = sorted((r["id"], r["y"], r["c"], r["x"]) for r in got)
    machine = Machine()
    machine.fit([(np.frombuffer(c, np.int32), np.frombuffer(x, np.float32).astype(np.float64)) for _, _, c, x in got], np.array([y for _, y, _, _ in got], dtype=float))
    return machine


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the score (0 to 1) of each whole text."""
    prepare(docs.sparkSession)

    def run(texts):
        got = [machine.score(*utf8(texts.slice(i, j - i))) for i, j in passes(texts)]
        return [pa.array(np.concatenate([np.zeros(0), *got]), pa.float64())]

    return with_arrow(docs, [text_col], [T.StructField("score", T.DoubleType())], run, keep)
