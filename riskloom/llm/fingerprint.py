"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases, and so on. At each level runs of one name
become one symbol; deterministic coin tossing (the lowest bit in which a name differs from the one before, thrice) gives
neighbouring symbols different labels below 8; a phrase begins at each local maximum of the labels. Where a phrase begins
depends on a few symbols around it only, so equal substrings have equal names inside, at any offset. A name is a hash of the
names that it joins.

A fingerprint keeps, for each of FIRST classes of the names at level 1 and SLOTS - FIRST classes of the names at LEVELS, the
least name (16 bits of it): equal texts have equal fingerprints, and the share of equal slots estimates the Jaccard likeness of
two texts' phrases. The names of level 1, the most numerous, have slots of their own and displace no others'. Empty (and null) texts have
empty slots only; two such are alike (1), one such and any other text are not (0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, BASE_INVERSE, mix, passes, powers, prepare, quoted, utf8, with_arrow

#: All slots, and those of level 1, without which short texts would have few phrases.
SLOTS, FIRST, LEVELS = 144, 16, (2, 3, 4, 5, 6)
EMPTY = 0xFFFF
ONE = np.uint64(1)


def coin(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which each label differs from the one before, plus that bit."""
    x = label.copy()
    x[1:] ^= label[:-1]
    x[first] = label[first] | np.uint64(1 << 62)
    low = x & (~x + ONE)
    place = np.log2(low.astype(np.float64)).astype(np.uint64)
    return (place << ONE) | ((label >> place) & ONE)


def level(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and ends; each text has at least one symbol."""
    head = np.ones(len(names), bool)
    head[1:] = names[1:] != names[:-1]
    head[ends[:-1]] = True
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(names)))
    s = names[at]
    long = run > 1
    s[long] = mix(s[long] * np.uint64(0xD6E8FEB86659FD93) + run[long].astype(np.uint64))
    begin = np.searchsorted(at, ends[:-1])
    first = np.zeros(len(s), bool)
    first[begin] = True
    small = coin(coin(coin(s, first), first), first).astype(np.int16)
    after = np.append(small[1:], np.int16(-1))
    after[np.flatnonzero(first)[1:] - 1] = -1
    before = np.append(np.int16(99), small[:-1])
    cut = (small > before) & (small >= after)
    cut |= first
    start = np.flatnonzero(cut)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum((s + ONE) * powers(BASE, len(s)), out=total[1:])
    stop = np.append(start[1:], len(s))
    made = mix((total[stop] - total[start]) * powers(BASE_INVERSE, len(s) + 1)[start] + (stop - start).astype(np.uint64))
    return made, np.append(np.searchsorted(start, begin), len(made))


def sketch(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of SLOTS 16-bit numbers for each text."""
    n = len(ends) - 1
    out = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        names, at = data.astype(np.uint64), np.append(ends[:-1][full], ends[-1])
        for k in range(1, max(LEVELS) + 1):
            names, at = level(names, at)
            if k == 1 or k in LEVELS:
                low, many = (0, FIRST) if k == 1 else (FIRST, SLOTS - FIRST)
                slot = np.repeat(full, np.diff(at)) * SLOTS + low + ((names >> np.uint64(48)) % np.uint64(many)).astype(np.int64)
                np.minimum.at(out, slot, mix(names * np.uint64(0x2545F4914F6CDD1D)))
    kept = (out >> np.uint64(20)).astype(np.uint16)
    kept[kept == EMPTY] = EMPTY - 1
    kept[out == np.iinfo(np.uint64).max] = EMPTY
    return kept.reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots that are equal, of those that either has."""
    used = (a != EMPTY) | (b != EMPTY)
    return np.where(used.any(axis=1), ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1), 1.0)


def texts_of(row: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in row]


def sketch_array(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, SLOTS), np.uint16), *(sketch(*utf8(texts.slice(i, j - i))) for i, j in passes(texts))])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """docs with the fingerprint (4 * SLOTS hexadecimal digits) of each whole text."""
    prepare(docs.sparkSession)
    return with_arrow(docs, [text_col], [T.StructField(out_col, T.StringType())], lambda t: [pa.array(texts_of(sketch_array(t)), pa.string())], keep)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_ranges: int = 4096) -> DataFrame:
    """Rows by descending id in ranges, each range followed by the first row of the next one, for a pass along the order.

    Columns: pid (range), look (1 for the row of the next range), id, text. One shuffle moves the texts; of the ranges only
    their bounds and first ids reach the driver (at most most_ranges). Rows without id come last; ties go by text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    parts = min(most_ranges, 4 * n)
    bounds = sorted(set(rows.approxQuantile("id", [k / parts for k in range(1, parts)], 0.25 / parts)), reverse=True) or [0.0]
    pid = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b > F.col("id"))))
    placed = rows.withColumn("pid", pid.cast("int"))
    heads = sorted((r["pid"], r["head"]) for r in placed.groupBy("pid").agg(F.max("id").alias("head")).collect())
    # The head of each range goes along with the range before it, too; the first one follows the last.
    goes = spark.createDataFrame([(heads[k][0], heads[k][1], heads[k - 1][0]) for k in range(len(heads))], "hpid int, head long, target int")
    both = placed.join(F.broadcast(goes), (F.col("pid") == F.col("hpid")) & F.col("id").eqNullSafe(F.col("head")), "left")
    copies = both.select("id", "text", F.explode(F.when(F.col("target").isNull(), F.array(F.struct(F.col("pid").alias("pid"), F.lit(0).alias("look")))).otherwise(F.array(F.struct(F.col("pid").alias("pid"), F.lit(0).alias("look")), F.struct(F.col("target").alias("pid"), F.lit(1).alias("look"))))).alias("p"))
    return copies.select("p.pid", "p.look", "id", "text").repartition(n, "pid").sortWithinPartitions("pid", "look", F.col("id").desc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """text, its last half (rounded down) replaced by as many first code points of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; likeness to the next text by descending id."""
    prepare(docs.sparkSession)

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            rows = [*held, *zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            held = rows[-1:]
            for i, j in chunks([len(r[3]) for r in rows[:-1]]):
                part = rows[i : j + 1]
                own = [k for k in range(len(part) - 1) if not part[k][1] and part[k][0] == part[k + 1][0]]
                if not own:
                    continue
                prints = sketch_array(pa.array([r[3] for r in part], pa.string()))
                new = [edited(part[k][3], part[k + 1][3]) for k in own]
                other = sketch_array(pa.array(new, pa.string()))
                at = np.array(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[k][2] for k in own], pa.int64()), pa.array([len(part[k][3]) for k in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array(texts_of(prints[at]), pa.string()), pa.array(texts_of(other), pa.string()),
                    pa.array(likeness(prints[at], other)), pa.array(likeness(prints[at], prints[at + 1])),
                ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    made = with_next(docs, id_col, text_col).select("pid", "look", "id", "text").mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)


def chunks(lengths: list[int], most: int = 1 << 20):
    """Ranges of about `most` characters."""
    i = 0
    while i < len(lengths):
        j, total = i + 1, lengths[i]
        while j < len(lengths) and total + lengths[j] <= most:
            total += lengths[j]
            j += 1
        yield i, j
        i = j
