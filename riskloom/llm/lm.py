"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the context, times that of its leaf given context and class, times its share
of the leaf. Both softmaxes (CLASSES classes, CLASSES leaves in each) are maximum-entropy models whose features are hashed: the
word before, the two words before (n-grams), and the word before the last (a skip). The most frequent words have leaves of
their own; the others share leaves by hash, within which smoothed training counts decide; one leaf is for words that training
did not see, one type of which the vocabulary has (as in the base score).

Counts come from all training tokens (a shuffle by token). The weights are trained by distributed gradient updates: in each
round every partition takes AdaGrad steps over all its training tokens of that round, and the updates, weighed by tokens, are
summed block by block. Each training document belongs to one round, so every training token is used.

For scores, the counts of the HEAD most frequent tokens go to all tasks (a bounded table); a document's other tokens are joined
with the count table. Null texts count as empty, which still have their end. Repeated rows are scored alike. Without training
rows every word is unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, prepare, quoted

CLASSES, OWN, ROUNDS = 16, 128, 2
LEAVES = CLASSES * CLASSES
UNKNOWN_LEAF = LEAVES - 1
#: Rows of hashed weights for each softmax, the tokens of a gradient step, its rate, and the tokens of a task's Counter.
ROWS, STEP, RATE, COUNTED = 1 << 14, 8192, 0.25, 400_000
#: Most tokens whose counts are sent to all tasks.
HEAD = 200_000
#: The end of a text: no word, as it holds a space.
END = b"\n"
ALPHA = 0.1
ONES = np.ones(CLASSES, np.float32)
LANES = np.arange(CLASSES)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary) and its count n over all rows of docs; tasks add up before the shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > COUNTED:
                    yield from flush(seen)
                    seen = Counter()
        yield from flush(seen)

    def flush(seen):
        keys, n = list(seen), list(seen.values())
        for i in range(0, len(keys), 16384):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 16384], pa.binary()), pa.array(n[i : i + 16384], pa.int64())], ["token", "n"])

    return docs.select(quoted(text_col).cast("string").alias("text")).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def spread(hashed: np.ndarray) -> np.ndarray:
    """Shared leaves of words by hash: those after OWN, but for the last."""
    return OWN + (hashed >> np.uint64(40)).astype(np.int64) % (UNKNOWN_LEAF - OWN)


class Head:
    """Counts and leaves of frequent words, and what the whole vocabulary's counts say."""

    def __init__(self, counts: DataFrame, most: int = HEAD):
        band = F.floor(F.log2("n") * 16)
        got = sorted(counts.groupBy(band.alias("band")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).collect(), key=lambda r: -r["band"])
        self.types, self.tokens = sum(r["types"] for r in got), sum(r["tokens"] for r in got)
        once, total, floor = sum(r["once"] for r in got), 0, 1 << 62
        for r in got:
            if total + r["types"] > most:
                break
            total, floor = total + r["types"], r["least"]
        top = counts.where(F.col("n") >= floor).toArrow()
        pairs = sorted(zip(top["n"].to_pylist(), top["token"].to_pylist()), key=lambda x: (-x[0], x[1]))
        self.words = [w for _, w in pairs]
        self.counts = np.array([n for n, _ in pairs], dtype=np.float64)
        # A tail token stands for an unknown one as often as unknown words are likely (the share of words seen once).
        tail = self.tokens - self.counts.sum()
        self.hidden = min(0.5, once / tail) if tail else 0.0
        self.mass = np.zeros(LEAVES)
        self.kinds = np.zeros(LEAVES)
        shared = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in self.words[:OWN]], "token binary")), "token", "left_anti") if self.words else counts

        def leaves(batches):
            n, k = np.zeros(LEAVES), np.zeros(LEAVES)
            for b in batches:
                leaf = spread(hash_words(b.column(0).to_pylist()))
                n += np.bincount(leaf, b.column(1).to_numpy(), LEAVES)
                k += np.bincount(leaf, minlength=LEAVES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES)), pa.array(n), pa.array(k)], ["leaf", "n", "k"])

        for r in shared.select("token", "n").mapInArrow(leaves, "leaf bigint, n double, k double").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
            self.mass[r["leaf"]], self.kinds[r["leaf"]] = r["n"], r["k"]
        for i, c in enumerate(self.counts[:OWN]):
            self.mass[i], self.kinds[i] = c, 1

    def ready(self) -> None:
        """Look-up tables, made in each worker once."""
        if not hasattr(self, "place"):
            self.place = {w: i for i, w in enumerate(self.words)}
            self.hashes = hash_words(self.words)
            self.leaf = spread(self.hashes)
            self.leaf[:OWN] = np.arange(min(OWN, len(self.words)))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of all tokens in order: place in the head (-1: none), hash; where each text ends; the words."""
        self.ready()
        each = [words_of(t) for t in texts]
        words = list(chain.from_iterable(each))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        h = self.hashes[at] if len(self.words) else np.zeros(len(at), np.uint64)
        rare = np.flatnonzero(at < 0)
        h[rare] = hash_words([words[i] for i in rare.tolist()])
        return at, h, np.cumsum([len(w) for w in each]), words


def hash_words(words: list[bytes]) -> np.ndarray:
    low, high = (np.fromiter(map(f, words), np.uint64, len(words)) for f in (zlib.crc32, zlib.adler32))
    return mix(low | high << np.uint64(32))


class Model:
    """Weights of the two softmaxes; row 0.. of each feature are shared by hash. Row 0 and rows 0..15 are the biases."""

    def __init__(self):
        self.top = np.zeros((ROWS, CLASSES), np.float32)
        self.low = np.zeros((ROWS, CLASSES), np.float32)

    @staticmethod
    def rows(h: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        """64-bit features of each token's context: bias, word before, two before, skip. A text's start is a word of its own."""
        start = np.uint64(0x5851F42D4C957F2D)
        first = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        one = np.empty_like(h)
        one[1:] = h[:-1]
        one[first] = start
        two = np.empty_like(h)
        two[1:] = one[:-1]
        two[first] = start
        return [one * np.uint64(0x9E3779B97F4A7C15), mix(one * np.uint64(3) + two * np.uint64(0xC2B2AE3D27D4EB4F)), two * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1234567)]

    @staticmethod
    def bucket(f: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        x = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(salt).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return CLASSES + (((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)) * np.uint64(ROWS - CLASSES) >> np.uint64(30)).astype(np.int64)

    @staticmethod
    def softmax(w: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        """Sums of weights beyond 60 count as 60, so that no exponential overflows."""
        z = np.take(w, at[0], axis=0)
        for a in at[1:]:
            z += np.take(w, a, axis=0)
        np.exp(np.clip(z, -60, 60, out=z), out=z)
        z *= np.reciprocal(z @ ONES)[:, None]
        return z

    def places(self, feats: list[np.ndarray], cls: np.ndarray | None) -> list[np.ndarray]:
        n = len(feats[0])
        if cls is None:
            return [np.zeros(n, np.int64), *(self.bucket(f, 0) for f in feats)]
        return [cls, *(self.bucket(f, cls + 1) for f in feats)]

    def log_leaf(self, feats: list[np.ndarray], leaf: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token's leaf; of the unknown leaf for the tokens numbered in more."""
        n = np.arange(len(leaf))
        top = self.softmax(self.top, self.places(feats, None))
        cls = leaf // CLASSES
        low = self.softmax(self.low, self.places(feats, cls))
        out = np.log10(np.maximum(top[n, cls].astype(np.float64) * low[n, leaf % CLASSES], 1e-30))
        if not len(more):
            return out, np.zeros(0)
        some = [f[more] for f in feats]
        last = np.full(len(more), UNKNOWN_LEAF // CLASSES)
        low = self.softmax(self.low, self.places(some, last))
        return out, np.log10(np.maximum(top[more, CLASSES - 1].astype(np.float64) * low[:, CLASSES - 1], 1e-30))

    def train(self, feats: list[np.ndarray], leaf: np.ndarray, memory: list[np.ndarray]) -> None:
        """One AdaGrad step on some tokens."""
        n, cls = np.arange(len(leaf)), leaf // CLASSES
        for w, total, at, want in ((self.top, memory[0], self.places(feats, None), cls), (self.low, memory[1], self.places(feats, cls), leaf % CLASSES)):
            g = self.softmax(w, at)
            g[n, want] -= 1
            g /= np.float32(64)
            flat = g.ravel().astype(np.float64)
            for a in at:
                # Rows that occur, and the sum of each one's gradients.
                seen = np.zeros(ROWS, bool)
                seen[a] = True
                rows = np.flatnonzero(seen)
                place = np.empty(ROWS, np.int64)
                place[rows] = np.arange(0, len(rows) * CLASSES, CLASSES)
                grad = np.bincount((place[a][:, None] + LANES).ravel(), flat, len(rows) * CLASSES).astype(np.float32).reshape(-1, CLASSES)
                t = np.take(total, rows, axis=0)
                t += grad * grad
                total[rows] = t
                t += np.float32(1e-4)
                grad /= np.sqrt(t, out=t)
                grad *= np.float32(RATE)
                w[rows] = np.take(w, rows, axis=0) - grad


BLOCK = 128


def train_round(docs: DataFrame, model: Model, head, text_col: str, lane_count: int = 32) -> Model:
    """The model after each partition's steps over docs, averaged by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((model.top, model.low))

    def run(batches):
        own = Model()
        own.top, own.low = (w.copy() for w in sent.value)
        memory, tokens = [np.zeros_like(own.top), np.zeros_like(own.low)], 0
        h = head.value
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 64):
                at, hashed, stops, _ = h.ids(texts[i : i + 64])
                leaf = np.where(at >= 0, h.leaf[at] if len(h.words) else 0, spread(hashed))
                rare = np.flatnonzero(at < 0)
                hide = (mix(hashed[rare] + rare.astype(np.uint64)) >> np.uint64(40)).astype(np.float64) / (1 << 24) < h.hidden
                leaf[rare[hide]] = UNKNOWN_LEAF
                feats = own.rows(hashed, stops)
                for k in range(0, len(leaf), STEP):
                    own.train([f[k : k + STEP] for f in feats], leaf[k : k + STEP], memory)
                tokens += len(leaf)
        if tokens:
            base = np.concatenate(sent.value)
            change = (np.concatenate([own.top, own.low]) - base).reshape(-1, BLOCK * CLASSES)
            k = len(change)
            lane = pa.array(np.full(k, tokens % lane_count, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), lane, pa.array(np.full(k, float(tokens))), pa.array([(r.astype(np.float64) * tokens).tobytes() for r in change], pa.binary())], ["block", "lane", "tokens", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * CLASSES)
        for s in t["sums"]:
            total += np.frombuffer(s.as_py())
        return pa.table({"block": t["block"][:1], "lane": t["lane"][:1], "tokens": [sum(t["tokens"].to_pylist())], "sums": pa.array([total.tobytes()], pa.binary())}, schema=pa.schema([("block", pa.int32()), ("lane", pa.int32()), ("tokens", pa.float64()), ("sums", pa.binary())]))

    shape = "block int, lane int, tokens double, sums binary"
    updates = docs.select(quoted(text_col).cast("string").alias("text")).mapInArrow(run, shape)
    whole = updates.groupBy("block", "lane").applyInArrow(add, shape).groupBy("block").applyInArrow(add, shape).collect()
    out = Model()
    both = np.concatenate([model.top, model.low]).astype(np.float64).reshape(-1, BLOCK * CLASSES)
    for r in whole:
        both[r["block"]] += np.frombuffer(bytes(r["sums"])) / r["tokens"]
    both = both.reshape(-1, CLASSES).astype(np.float32)
    out.top, out.low = both[:ROWS].copy(), both[ROWS:].copy()
    return out


def score_text(docs: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score of each row; the model learns from rows that train holds for."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"), train.alias("train"))
    counts = cut(count_tokens(rows.where("train")))
    known = Head(counts)
    head = spark.sparkContext.broadcast(known)
    model = Model()
    for k in range(rounds if known.tokens else 0):
        model = train_round(rows.where("train").where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(rounds)) == k), model, head, "text")
    weights = spark.sparkContext.broadcast(model)
    scale = np.log10(known.tokens + ALPHA * (known.types + 1))

    def run(batches):
        h, m = head.value, weights.value
        h.ready()
        # A word's share of its leaf.
        share = np.log10((h.counts + ALPHA) / (h.mass[h.leaf] + ALPHA * h.kinds[h.leaf])) if len(h.words) else np.zeros(0)
        base = np.log10(h.counts + ALPHA) - scale
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                at, hashed, stops, words = h.ids(texts[i : i + 64])
                rare = np.flatnonzero(at < 0)
                leaf = np.where(at >= 0, h.leaf[at] if len(h.words) else 0, spread(hashed))
                logs, unknown = [], []
                feats = m.rows(hashed, stops)
                for k in range(0, len(leaf), STEP):
                    a, u = m.log_leaf([f[k : k + STEP] for f in feats], leaf[k : k + STEP], rare[(rare >= k) & (rare < k + STEP)] - k)
                    logs.append(a)
                    unknown.append(u)
                log, unknown = np.concatenate(logs), np.concatenate(unknown)
                common = at >= 0
                own = np.where(common, share[at] + log if len(share) else 0.0, 0.0)
                first = np.concatenate([[0], stops[:-1]])
                sums = lambda x: np.add.reduceat(x, first)
                # A text's different rare words, with the sums over where they stand. (Sums of nothing are whole numbers to numpy.)
                names, ends, own_place = [], [0], np.empty(len(rare), np.int64)
                for lo, hi in zip(np.searchsorted(rare, first).tolist(), np.searchsorted(rare, stops).tolist()):
                    place = {}
                    for p, r in enumerate(rare[lo:hi].tolist(), lo):
                        own_place[p] = place.setdefault(words[r], len(names) + len(place))
                    names.extend(place)
                    ends.append(len(names))
                tf, seen, unseen = (np.bincount(own_place, x, len(names)) for x in (None, log[rare], unknown))
                leaves = np.empty(len(names), np.int32)
                leaves[own_place] = leaf[rare]
                fields = [pa.array(names, pa.binary()), pa.array(tf.astype(np.int64)), pa.array(seen.astype(np.float64)), pa.array(unseen.astype(np.float64)), pa.array(leaves)]
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(TAIL_ARROW.value_type)))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, 64), pa.array(np.diff(np.concatenate([[0], stops]))), pa.array(sums(common.astype(np.int64))),
                    pa.array(sums(np.where(common, base[at] if len(base) else 0.0, 0.0))), pa.array(sums(own)), tail,
                ], ["id", "n_tokens", "n_known", "base", "score", "tail"])

    shape = T.StructType([rows.schema["id"], *T._parse_datatype_string(f"n_tokens bigint, n_known bigint, base double, score double, tail {TAIL}").fields])
    scored = cut(rows.select("id", "text").mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("x")).select("row", "x.*")
    mass = F.array(*[F.lit(float(a + ALPHA * b)) for a, b in zip(known.mass, known.kinds)])
    joined = tail.join(counts, "token", "left")
    within = F.log10((F.col("n") + ALPHA) / F.element_at(mass, F.col("leaf") + 1))
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + ALPHA) - float(scale))).alias("b"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("seen") + F.col("tf") * within).otherwise(F.col("unseen"))).alias("s"),
    )
    whole = scored.drop("tail").join(more, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(int(known.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )


TAIL = "array<struct<token: binary, tf: bigint, seen: double, unseen: double, leaf: int>>"
TAIL_ARROW = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int64()), ("seen", pa.float64()), ("unseen", pa.float64()), ("leaf", pa.int32())]))
