"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words are counted first. Each n-gram belongs to one of its places: that of its rarest word, the leftmost of equal ones. So a
place gives one text fragment: the words to its left that are more frequent and those to its right that are not rarer, as far as
an n-gram can reach; what is beyond, and words too rare for any phrase, is cut off. Equal fragments of a pass are one with a
count, and fragments travel to their pivot (language and word) as one row for each pivot and pass. A task that holds a pivot has
every occurrence of the n-grams that the pivot owns, so it counts them alone and emits those that are frequent enough. Pivots
more frequent than a share of a partition are dealt out by a hash of the fragment, and a pivot of which a task holds more than a
bound is counted in parts; such counts are added up afterwards, the others are whole.

The order of words is a broadcast table of the frequent words, at most MOST_WORDS of them, the most frequent ones. Where there
are more, the others count as rarer than all in the table, in the order of a hash; every order gives the same counts, as an
n-gram's place follows from its words alone.

Null text has no words; a null language is `und`; null, repeated and clashing ids or other columns play no part, as only text and
language are read. Empty tables give no rows. Very long texts are read in windows that overlap by the reach of a phrase. Ties in
score are ordered by count, then by phrase in UTF-8 byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, mix, powers, prepare, quoted

#: Bytes of text that are looked at together, and of fragments that are counted together.
PASS = 8 << 20
#: Words in the broadcast table at most: some 20 MB.
MOST_WORDS = 1 << 20
#: A pivot with more than this share of a partition's even load is dealt out.
HOT_SHARE = 0.25

#: Bytes that end a piece: . , ; : ! ? and \x0A-\x0D; space and tab end words only. (Fixed values.)
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
APART = ENDS.copy()
APART[[*b" \t"]] = True


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~APART[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans' bytes as texts."""
    size = stops - starts
    ends = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])
    wide = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[own]))
    return wide


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the different values in the order of their numbers."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def grouped(columns: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row number of each different row of the columns, and the sum of weights. Hashes only sort; rows are compared whole."""
    if not len(weights):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(weights), np.uint64)
    for c in columns:
        h = mix(h + c.astype(np.uint64))
    order = np.argsort(h)
    same = lambda o: np.logical_and.reduce([c[o[1:]] == c[o[:-1]] for c in columns])
    equal = same(order)
    if (~equal & (h[order[1:]] == h[order[:-1]])).any():  # two rows with one hash
        order = np.lexsort(columns)
        equal = same(order)
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    return order[first], np.add.reduceat(weights[order], first)


def texts_of(batches: Iterator[pa.RecordBatch], most: int = PASS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Rows (language, text) some megabytes at a time: languages, bytes of all texts with a line end after each, offsets."""
    langs, parts, size = [], [], 0
    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
            raw = t.as_buffer()
            raw = b"" if raw is None else raw.to_pybytes()
            langs.append(lang)
            parts.append(raw)
            size += len(raw) + 1
            if size >= most:
                yield joined(langs, parts)
                langs, parts, size = [], [], 0
    if parts:
        yield joined(langs, parts)


def joined(langs: list[str], parts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return langs, LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)], ends


def windows(data: np.ndarray, reach: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, own from, own to, to): ranges of bytes that each hold whole words. A pass is one range, unless a long text makes it
    longer than `most`: then ranges overlap by `reach` words on either side of what is their own."""
    n = len(data)
    if n <= most:
        yield 0, 0, n, n
        return

    def after(at: int, words: int) -> int:
        """The end of the given number of words from `at` on (a place between words), or the end of all."""
        step = 1 << 16
        while True:
            _, stops = spans(data[at : at + step])
            done = stops[:-1] if at + step < n else stops
            if len(done) >= words or at + step >= n:
                return at + int(done[words - 1]) if len(done) >= words else n
            step *= 4

    def before(at: int, words: int) -> int:
        step = 1 << 16
        while True:
            low = max(0, at - step)
            starts, _ = spans(data[low:at])
            done = starts[1:] if low else starts
            if len(done) >= words or not low:
                return low + int(done[-words]) if len(done) >= words else 0
            step *= 4

    a = 0
    while a < n:
        b = n if a + most >= n else after(a + most, 1) if APART[data[a + most]] else after_word(data, a + most)
        yield before(a, reach), a, b, after(b, reach)
        a = b


def after_word(data: np.ndarray, at: int) -> int:
    """The end of the word that `at` is in."""
    step = 1 << 12
    while True:
        gap = np.flatnonzero(APART[data[at : at + step]])
        if len(gap) or at + step >= len(data):
            return at + int(gap[0]) if len(gap) else len(data)
        step *= 4


def pairs_of(langs: list[str], data: np.ndarray, ends: np.ndarray, offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Starts of words, each word's number, and for each number its language and word; the same word has a number for each language."""
    starts, stops = spans(data)
    code, words = codes_of(strings(data, starts, stops))
    lang_code, names = codes_of(pa.array(langs, pa.string()))
    lang = lang_code[np.searchsorted(ends, starts + offset, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    pair = lang * max(1, len(words)) + code
    have, number = np.unique(pair, return_inverse=True)
    return starts, number, have, names.take(pa.array(have // max(1, len(words)))), words.take(pa.array(have % max(1, len(words))))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, f of docs (lang, text); the row without a word has the number of all."""

    def run(batches):
        for langs, data, ends in texts_of(batches):
            _, number, have, lang, word = pairs_of(langs, data, ends)
            n = np.bincount(number, minlength=len(have)).astype(np.int64)
            lang = lang.cast(pa.string())
            total = pa.TableGroupBy(pa.table({"lang": lang, "n": n}), "lang").aggregate([("n", "sum")])
            step = 1 << 16
            for i in range(0, len(n), step):
                yield pa.RecordBatch.from_arrays([lang.slice(i, step), word.slice(i, step).cast(pa.string()), pa.array(n[i : i + step])], ["lang", "word", "f"])
            yield pa.RecordBatch.from_arrays([total["lang"].combine_chunks(), pa.nulls(len(total), pa.string()), total["n_sum"].combine_chunks()], ["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def keyed(lang: pa.Array, word: pa.Array) -> pa.Array:
    """Language and word as one text; words hold no space, so the last one parts them."""
    return pc.binary_join_element_wise(lang.cast(pa.large_string()), word.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))


class Order:
    """The order of words by frequency: a table of the most frequent ones, and whether it holds all that a phrase may have."""

    def __init__(self, rows: pa.Table, whole: bool):
        keys, f = keyed(rows["lang"].combine_chunks(), rows["word"].combine_chunks()), rows["f"].to_numpy().astype(np.int64)
        at = pc.sort_indices(pa.table({"f": f, "k": keys}), sort_keys=[("f", "descending"), ("k", "ascending")])
        self.keys, self.f, self.whole = keys.take(at), f[at.to_numpy()], whole

    def ranks(self, lang: pa.Array, word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word how many come before it (-1: too rare for any phrase) and its count (0 where the table hasn't it)."""
        own = keyed(lang, word)
        found = pc.index_in(own, value_set=self.keys)
        rank = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        absent = np.flatnonzero(rank < 0)
        f = np.zeros(len(rank), np.int64)
        f[rank >= 0] = self.f[rank[rank >= 0]]
        if not self.whole and len(absent):
            rank[absent] = len(self.f) + hashed(own.take(pa.array(absent)))
        return rank, f


def hashed(values: pa.Array) -> np.ndarray:
    """31 bits of each text that follow from its bytes."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = ends[1:] - ends[:-1]
    own = np.arange(len(data)) - np.repeat(ends[:-1], size)
    held = (data.astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(size.max(initial=0)) + 1)[own]
    total = np.concatenate([[np.uint64(0)], np.cumsum(held, dtype=np.uint64)])
    return (mix(total[ends[1:]] - total[ends[:-1]]) >> np.uint64(33)).astype(np.int64)


def extents(rank: np.ndarray, piece: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words left and right of each place its n-grams reach: more frequent ones to the left, not rarer ones to the right."""
    n = len(rank)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    going_l = going_r = rank >= 0
    for d in range(1, min(longest, n)):
        near = (piece[d:] == piece[:-d]) & (rank[d:] >= 0) & (rank[:-d] >= 0)
        l_ok, r_ok = np.zeros(n, bool), np.zeros(n, bool)
        l_ok[d:] = near & (rank[:-d] < rank[d:])
        r_ok[:-d] = near & (rank[d:] <= rank[:-d])
        going_l, going_r = going_l & l_ok, going_r & r_ok
        left += going_l
        right += going_r
    return left, right


FRAGMENTS = "lang string, pivot string, salt int, words string, at binary, n binary"


def fragments(docs: DataFrame, order, load: float, longest: int, most: int = PASS) -> DataFrame:
    """Fragments by pivot: lang, pivot, salt, the fragments' words (one fragment a line), the pivot's place in each, its count.

    order: a broadcast Order. load: occurrences of a word above which a pivot is dealt out.
    """

    def made(langs, data, ends, low, own, to, high):
        part = data[low:high]
        starts, number, have, lang, word = pairs_of(langs, part, ends, low)
        rank_of, f_of = order.value.ranks(lang, word)
        rank = rank_of[number]
        piece = np.cumsum(ENDS[part], dtype=np.int64)[starts] if len(starts) else starts
        left, right = extents(rank, piece, longest)
        at = np.flatnonzero((left + right > 0) & (starts >= own - low) & (starts < to - low))
        if not len(at):
            return
        left, right = left[at], right[at]
        columns = []
        for d in range(1 - longest, longest):
            inside = (d >= -left) & (d <= right)
            columns.append(np.where(inside, number[np.clip(at + d, 0, len(number) - 1)], -1))
        rows, n = grouped(columns, np.ones(len(at), np.int64))
        columns = [c[rows] for c in columns]
        pivot, left = columns[longest - 1], left[rows]
        salts = np.maximum(1, np.ceil(f_of / load)).astype(np.int64)[pivot]
        spread = np.zeros(len(rows), np.uint64)
        for c in columns:  # numbers differ from pass to pass, words do not
            spread = mix(spread + np.where(c >= 0, rank_of[c] + 1, 0).astype(np.uint64))
        salt = np.where(salts > 1, (spread % salts.astype(np.uint64)).astype(np.int64), -1)
        sort = np.lexsort([salt, pivot])
        columns, pivot, salt, left, n = [c[sort] for c in columns], pivot[sort], salt[sort], left[sort], n[sort]
        first = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])]))
        last = np.concatenate([first[1:], [len(pivot)]])
        line = pc.binary_join_element_wise(*[word.take(pa.array(c, mask=c < 0)) for c in columns], pa.scalar(" ", pa.large_string()), null_handling="skip")
        blob = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([first, [len(pivot)]])), line), pa.scalar("\n", pa.large_string()))
        small, count = left.astype(np.uint8).tobytes(), n.astype("<i4").tobytes()
        who = pa.array(pivot[first])
        out = [
            lang.take(who).cast(pa.string()), word.take(who).cast(pa.string()), pa.array(salt[first].astype(np.int32)), blob.cast(pa.string()),
            pa.array([small[a:b] for a, b in zip(first, last)], pa.binary()), pa.array([count[4 * a : 4 * b] for a, b in zip(first, last)], pa.binary()),
        ]
        names = [x.split()[0] for x in FRAGMENTS.split(", ")]
        for i in range(0, len(first), 1024):
            yield pa.RecordBatch.from_arrays([x.slice(i, 1024) for x in out], names)

    def run(batches):
        for langs, data, ends in texts_of(batches, most):
            for window in windows(data, longest - 1, 2 * most):
                yield from made(langs, data, ends, *window)

    return docs.mapInArrow(run, FRAGMENTS)


def counted(rows: list[tuple], longest: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Language, phrase, count and whether the count is a part, of all n-grams that the rows' pivots own. rows: lang, words, at, n, part."""
    data = np.frombuffer("\n".join(r[1] for r in rows).encode(), np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], (data[:-1] == 32) | (data[:-1] == 10)]))
    stops = np.concatenate([starts[1:] - 1, [len(data)]])
    code, words = codes_of(strings(data, starts, stops))
    head = np.flatnonzero(np.concatenate([[True], data[starts[1:] - 1] == 10]))
    size = np.diff(np.concatenate([head, [len(starts)]]))
    left = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64)
    n = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
    each = [len(r[2]) for r in rows]
    lang_code, langs = codes_of(pa.array([r[0] for r in rows], pa.string()))
    lang, part = np.repeat(lang_code, each), np.repeat(np.array([r[4] for r in rows], bool), each)
    center, right = head + left, size - left - 1
    found = []
    for before in range(longest):
        for after in range(longest - before):
            if before + after:
                rows_of = np.flatnonzero((left >= before) & (right >= after))
                begin = center[rows_of] - before
                width = before + after + 1
                found.append([*[code[begin + j] if j < width else np.full(len(begin), -1) for j in range(longest)], lang[rows_of], n[rows_of], part[rows_of]])
    columns = [np.concatenate(c) for c in zip(*found)]
    which, total = grouped(columns[: longest + 1], columns[longest + 1])
    tokens = [words.take(pa.array(c[which], mask=c[which] < 0)) for c in columns[:longest]]
    phrase = pc.binary_join_element_wise(*tokens, pa.scalar(" ", pa.large_string()), null_handling="skip")
    return langs.take(pa.array(columns[longest][which])), phrase.cast(pa.string()), total, columns[longest + 2][which]


def mined(pieces: DataFrame, least: int, longest: int, most: int = PASS) -> DataFrame:
    """lang, phrase, a of what each pivot owns: whole counts of at least `least`, or parts of counts."""

    def emit(rows):
        lang, phrase, a, part = counted(rows, longest)
        keep = pa.array(np.flatnonzero(part | (a >= least)))
        lang, phrase, a = lang.take(keep), phrase.take(keep), pa.array(a).take(keep)
        for i in range(0, len(phrase), 1 << 14):
            yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 14) for x in (lang, phrase, a)], ["lang", "phrase", "a"])

    def run(batches):
        held, size, key, part = [], 0, None, False
        for b in batches:
            for lang, pivot, salt, words, at, n in zip(*[c.to_pylist() for c in b.columns]):
                if (lang, pivot) != key:
                    if size >= most:  # all pivots held are whole
                        yield from emit(held)
                        held, size = [], 0
                    key, part = (lang, pivot), False
                elif size >= 4 * most:  # this pivot's rows are counted in parts
                    held = [(*r[:4], r[4] or r[5] == key, r[5]) for r in held]
                    yield from emit(held)
                    held, size, part = [], 0, True
                held.append((lang, words, at, n, part or salt >= 0, key))
                size += len(words) + 5 * len(at)
        if held:
            yield from emit(held)

    placed = pieces.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt")
    return placed.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def word_order(words: DataFrame, least: int, most: int) -> tuple[Order, int]:
    """The order of the counted words, and the count from which on words are in its table."""
    bound = max(1, least)
    while words.where(F.col("f") >= bound).count() > most:
        bound *= 2
    rows = words.where((F.col("f") >= bound) & F.col("word").isNotNull()).select("lang", "word", "f").toArrow()
    return Order(rows, bound <= max(1, least)), bound


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, most_words: int = MOST_WORDS, pass_bytes: int = PASS) -> tuple[DataFrame, DataFrame]:
    """Words of at least `least` occurrences (lang, word, f; without a word: all) and phrases (lang, phrase, a) of two to `longest` words."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), quoted(text_col).cast("string").alias("text"))
    words = cut(count_words(slim).where(F.col("word").isNull() | (F.col("f") >= least)))
    order, _ = word_order(words, least, most_words)
    total = words.where("word is null").agg(F.sum("f")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(order)
    phrases = mined(fragments(slim, shared, max(1.0, HOT_SHARE * total / parts), longest, pass_bytes), least, longest, pass_bytes)
    return words, cut(phrases)


def whole(c) -> F.Column:
    """A count as a decimal, whose products with small factors stay exact."""
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, most_words: int = MOST_WORDS, pass_bytes: int = PASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by their weakest cut.

    A phrase of a occurrences, cut into parts of l and r, scores floor(2000000 a / (l + r)); the lowest cut counts, then the first.
    Phrases within a longer one that has at least `share` percent of their occurrences are dropped.
    """
    words, phrases = phrase_counts(docs, text_col, lang_col, least, longest, most_words, pass_bytes)
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    counts = words.where("word is not null").select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    tokens = F.split("phrase", " ")
    inside = lambda t, i, n: F.array_join(F.slice(t, i, n), " ")

    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), inside(F.col("t"), F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), inside(F.col("t"), k + 1, F.size("t") - k).alias("part")),
    )))
    sides = phrases.withColumn("t", tokens).select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*").join(counts, ["lang", "part"])
    at = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")
    each = sides.groupBy("lang", "phrase").agg(F.first("a").alias("a"), *[at(k, left) for k in range(1, longest) for left in (True, False)])
    score = lambda k: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    weakest = F.array_min(F.filter(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]), lambda x: x.isNotNull()))
    scored = each.withColumn("c", weakest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: inside(F.col("t"), i, n))))
    within = phrases.withColumn("t", tokens).where(F.size("t") > 2).select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * whole(F.col("longer")) < share * whole(F.col("a"))))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
