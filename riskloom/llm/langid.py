"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family (one against the rest) picks the family; within it one-versus-one
machines vote between its languages. Features are relative frequencies of hashed byte 1-, 2- and 3-grams of the lower-cased
text in which all that is no letter has become a space, so a text's margins are sums of looked-up weights and whole texts are
scored in linear time.

Null texts and texts without a letter are `und` with score 0; so is every text when no row has a label. Equal texts have
equal predictions. Ties go to the language that comes first by code point.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, passes, prepare, quoted, utf8, with_arrow

#: Language codes by family. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
}

#: The model is fitted on so many rows of each language at most: those whose id hashes lowest.
SAMPLE_PER_LANGUAGE = 400
BITS2, BITS3 = 11, 12
SIZES = (256, 1 << BITS2, 1 << BITS3)
OTHER = np.array([32 if b < 128 and not chr(b).isalpha() else b for b in range(256)], dtype=np.uint8)


def grams(data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the hashed gram at each byte, and each text's first and last place."""
    b = OTHER[data].astype(np.uint32)
    h2 = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS2)
    h3 = (b[:-2] * np.uint32(0xC2B2AE3D) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(32 - BITS3)
    lo = ends[:-1]
    return [(h, np.minimum(lo, len(h)), np.clip(ends[1:] - n, lo, len(h)).clip(min=0)) for n, h in enumerate((b, h2, h3))]


def frequencies(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Dense feature rows, one for each text."""
    n = np.maximum(np.diff(ends), 1)[:, None]
    out = [np.stack([np.bincount(h[i:j], minlength=size) for i, j in zip(lo, np.maximum(lo, hi))]) if len(ends) > 1 else np.zeros((0, size)) for (h, lo, hi), size in zip(grams(data, ends), SIZES)]
    return (np.concatenate(out, axis=1) / n).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps; weights, bias, and a scale for the margin."""
    n, d = x.shape
    mean = x.mean(axis=0, dtype=np.float64)
    z = x - mean.astype(np.float32)  # the one copy of the sample, in single precision as the features are
    sd = np.sqrt(np.einsum("ij,ij->j", z, z).astype(np.float64) / n) + 1e-5
    z /= sd.astype(np.float32)
    times = lambda m, v: (m @ v.astype(np.float32)).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    power = np.ones(d) / np.sqrt(d)
    for _ in range(10):
        power = times(z.T, times(z, power))
        power /= np.linalg.norm(power) + 1e-12
    top = float(np.linalg.norm(times(z, power)) ** 2) / n * 2 + 2
    step = 1 / (2 * top * max(weight) * n / 1 + 1e-3)
    w, b, lam = np.zeros(d), 0.0, 1e-3 / c
    vw, vb = w.copy(), b
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (times(z, vw) + vb))
        g = -2 * weight * y * gap
        nw, nb = vw - step * (times(z.T, g) + lam * vw), vb - step * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    margins = y * (times(z, w) + b)
    return w / sd, b - float((w / sd) @ mean), 2.0 / max(1e-3, float(np.median(margins)))


class Model:
    """languages; machines: (kind, positive, negative) with one column of weights each."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        known = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
        self.family = {lang: known.get(lang, lang) for lang in self.languages}
        self.families = sorted(set(self.family.values()))
        got = np.array(labels, dtype=object)
        fam = np.array([self.family[g] for g in labels], dtype=object)
        self.machines: list[tuple[str, str, str]] = []
        fitted = []
        if len(self.families) == 2:
            self.machines.append(("family", *self.families))
            fitted.append(svm(x, np.where(fam == self.families[0], 1.0, -1.0)))
        elif len(self.families) > 2:
            for f in self.families:
                self.machines.append(("family", f, ""))
                fitted.append(svm(x, np.where(fam == f, 1.0, -1.0)))
        for f in self.families:
            for a, b in combinations([g for g in self.languages if self.family[g] == f], 2):
                own = (got == a) | (got == b)
                self.machines.append(("pair", a, b))
                fitted.append(svm(x[own], np.where(got[own] == a, 1.0, -1.0)))
        n = len(fitted)
        w = np.stack([f[0] for f in fitted], axis=1).astype(np.float32) if n else np.zeros((sum(SIZES), 0), np.float32)
        self.weights = np.split(w, np.cumsum(SIZES)[:-1])
        self.bias = np.array([f[1] for f in fitted])
        self.scale = np.array([f[2] for f in fitted])

    def margins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros((len(ends) - 1, len(self.machines)))
        for (h, lo, hi), w in zip(grams(data, ends), self.weights):
            run = np.zeros((len(h) + 1, w.shape[1]))
            np.cumsum(w[h], axis=0, dtype=np.float64, out=run[1:])
            total += run[np.maximum(lo, hi)] - run[lo]
        return total / np.maximum(np.diff(ends), 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(ends) - 1
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        p = 1 / (1 + np.exp(-np.clip(self.margins(data, ends) * self.scale, -30, 30)))
        family = np.zeros((n, len(self.families)))
        pairs: dict[str, list[tuple[int, str, str]]] = {}
        for k, (kind, a, b) in enumerate(self.machines):
            if kind == "pair":
                pairs.setdefault(self.family[a], []).append((k, a, b))
            elif b:
                family[:, 0], family[:, 1] = p[:, k], 1 - p[:, k]
            else:
                family[:, self.families.index(a)] = p[:, k]
        if len(self.families) == 1:
            family[:] = 1
        best = family.argmax(axis=1)
        out, score = np.empty(n, dtype=object), family[np.arange(n), best]
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            own = [g for g in self.languages if self.family[g] == f]
            votes, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for k, a, b in pairs.get(f, []):
                q = p[rows, k]
                votes[:, own.index(a)] += q >= 0.5
                votes[:, own.index(b)] += q < 0.5
                sure[:, own.index(a)] += q
                sure[:, own.index(b)] += 1 - q
            pick = (votes + sure / (len(own) + 1)).argmax(axis=1)
            out[rows] = np.array(own, dtype=object)[pick]
            if len(own) > 1:
                score[rows] *= sure[np.arange(len(rows)), pick] / (len(own) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def fit_language_model(docs: DataFrame, text_col: str, label_col: str, id_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Machines fitted on at most per_language labelled rows of each language; only their features reach the driver, compressed, as most are 0."""
    prepare(docs.sparkSession)
    labelled = docs.where(quoted(label_col).isNotNull() & quoted(text_col).isNotNull()).select(quoted(label_col).cast("string").alias("label"), quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    # Rows whose hash is so low that they are likely among the lowest per_language of their language: few enough to be ranked.
    # One total a language, as many as the machines' own classes, goes to the rows: they need no shuffle by language for it.
    sizes = F.broadcast(labelled.groupBy("label").agg(F.count("*").alias("rows")))
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < (3.0 * per_language + 50) / F.col("rows") * (1 << 20)
    # A row is told by id, label and text, so a repeated id brings no other rows with it; rows equal in all three are one.
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "id", "digest"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    low = labelled.join(sizes, "label").where(share).select("id", "label", F.xxhash64("id", "text").alias("h"), digest.alias("digest")).distinct()
    chosen = cut(low.withColumn("r", rank).where(F.col("r") <= per_language).select(F.col("id").alias("__id"), F.col("label").alias("__label"), F.col("digest").alias("__digest")))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("label") == F.col("__label"))
    near = labelled.join(F.broadcast(chosen.select("__id", "__label").distinct()), same, "left_semi")  # at most per_language rows a label
    rows = near.withColumn("digest", digest).join(F.broadcast(chosen), same & (F.col("digest") == F.col("__digest")), "left_semi")

    def features(texts):
        out = []
        for i, j in passes(texts, 1 << 18):
            out += [zlib.compress(row, 1) for row in frequencies(*utf8(lowered(texts.slice(i, j - i))))]
        return [pa.array(out, pa.binary())]

    got = with_arrow(rows, ["text"], [T.StructField("x", T.BinaryType())], features, ["id", "label", "digest"]).dropDuplicates(["id", "label", "digest"]).drop("id", "digest").collect()
    got = sorted((r["label"], r["x"]) for r in got)
    x = np.empty((len(got), sum(SIZES)), np.float32)
    for row, (_, packed) in zip(x, got):
        row[:] = np.frombuffer(zlib.decompress(packed), np.float32)
    return Model(x, [label for label, _ in got])


def detect_language(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score of each whole text."""
    prepare(docs.sparkSession)

    def run(texts):
        lang, score = [], []
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        for i, j in passes(texts, 1 << 18):
            a, b = model.predict(*utf8(lowered(texts.slice(i, j - i))))
            lang += a
            score.append(b)
        score = np.where(letters, np.concatenate([np.zeros(0), *score]), 0.0)
        return pa.array([g if ok else "und" for g, ok in zip(lang, letters)], pa.string()), pa.array(score, pa.float64())

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_arrow(docs, [text_col], fields, run, keep)


def identify(docs: DataFrame, train: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """detect_language with a model fitted on the rows of docs for which train holds."""
    return detect_language(docs, fit_language_model(docs.where(train), text_col, label_col, id_col), text_col, keep)
