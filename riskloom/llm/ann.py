"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a string of SYMBOLS symbols and is the sorted array of these strings. A symbol says which of
2 * AXES half-axes of a randomly rotated space the vector is nearest to, AXES rotated coordinates at a time, so that vectors
in like directions share long prefixes. A query descends in each tree to the longest prefix that it shares with the array;
then all trees ascend together, a symbol at a time and tree by tree, until the vectors below are as many as the goal, counted
once a tree. Those are its candidates, which are compared by exact distance.

The goal is top + 1 for each tree and GOAL times the number of vectors to the power of 2/3. Neighbours of vectors without structure are hardly nearer
than others, so that a goal that does not grow at all cannot keep recall; this one is an ever smaller part of the table.

The arrays are dealt out by the first symbols in ranges of about RANGE strings. Only strings and row numbers go there, no
vectors. Each range counts, by binary search, how many strings share each prefix with a query; the sums say where each tree's
ascent ends; then the ranges list the candidates' row numbers by block of vectors (a range of the first tree or a lane of it),
and each block compares its candidates of a query once, whichever trees they come from.

Equal vectors are one before that: the distinct vectors, each with its least top + 1 ids, are hashed and searched, so a very
common vector is one candidate and one query. Vectors that are null, zero, or hold null or non-finite components take no part;
vectors of different lengths never meet. Ties go to the smaller id. Repeated ids are rows of their own. With fewer than two
vectors, or no queries, the result is empty. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, prepare, quoted

TOP, TREES, SYMBOLS, AXES, SEED = 10, 32, 16, 4, 3
#: Bits of a symbol (its half-axis among 2 * AXES).
WIDTH = 3
GOAL = 18.0
#: Strings of a range, and of a lane that a fuller range is shared out to; queries of a block's lane.
RANGE, LANE, ASKERS = 8192, 16_384, 512
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vec: Column) -> Column:
    x = vec.cast("array<double>")
    return vec.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def planes(dim: int, tree: int, n: int = SYMBOLS * AXES) -> np.ndarray:
    """A tree's axes; a block of orthogonal ones, then more such blocks."""
    rng = np.random.default_rng([SEED, tree, dim])
    out = [np.linalg.qr(rng.normal(size=(dim, dim)))[0].T for _ in range(-(-n // dim))]
    return np.concatenate(out)[:n]


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """The tree's string of each row of x as an integer; the first symbol has the highest bits."""
    p = (x @ planes(x.shape[1], tree).T).reshape(len(x), SYMBOLS, AXES)
    symbol = np.concatenate([p, -p], axis=2).argmax(axis=2)
    return symbol @ (np.int64(1) << (WIDTH * np.arange(SYMBOLS - 1, -1, -1, dtype=np.int64)))


def shared(sorted_strings: np.ndarray, asked: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of the sorted array whose first `level` symbols are those of each asked string."""
    shift = WIDTH * (SYMBOLS - np.asarray(level, dtype=np.int64))
    first = (asked >> shift) << shift
    return np.searchsorted(sorted_strings, first, "left"), np.searchsorted(sorted_strings, first + (np.int64(1) << shift), "left")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def stretches(batch: pa.RecordBatch, n: int):
    """Ranges of rows of a batch that are equal in the first n columns."""
    if not len(batch):
        return
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n)], axis=1)
    at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    for i, j in zip(at[:-1], at[1:]):
        yield tuple(keys[i].tolist()), i, j


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """key, vec, dim, ids (the least top + 1) and asking (how many rows ask) of each distinct vector."""
    w = Window.partitionBy("key").orderBy("id")  # Spark limits each partition's ranks before it shuffles them
    least = rows.select("key", "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1)
    ids = least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vecs = rows.groupBy("key").agg(F.first("vec").alias("vec"), F.count_if("asks").alias("asking"), F.size(F.first("vec")).alias("dim"))
    return vecs.join(ids, "key")


def steady(x: np.ndarray) -> np.ndarray:
    """x to six digits of its largest value: sums depend on the order of rows in their last digits, strings must not."""
    scale = 10.0 ** (5 - np.floor(np.log10(max(float(np.abs(x).max(initial=0)), 1e-300))))
    return np.round(x * scale) / scale


def centres(points: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """The mean vector of each number of components, and a quarter of the root of the mean squared distance from it. A task gives one row of
    sums for each, and only these reach the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            dims = np.array(b.column(0).to_pylist())
            for d in np.unique(dims).tolist():
                x = matrix(b.filter(pa.array(dims == d)).column(1))
                sums[d] = sums.get(d, 0) + np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])
                count[d] = count.get(d, 0) + len(x)
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([count[d]], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["dim", "n", "total"])

    rows = points.select(F.col("dim").cast("int"), "vec").mapInArrow(run, "dim int, n long, total array<double>").collect()
    out = {}
    for d in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == d]
        n = sum(r["n"] for r in own)
        both = np.array([math.fsum(c) for c in zip(*[r["total"] for r in own])]) / n
        if not np.isfinite(both).all():
            out[d] = np.zeros(d), 1.0
            continue
        mean = steady(both[:d])
        spread = float(steady(np.sqrt(np.maximum(both[d:] - both[:d] ** 2, 0).sum(keepdims=True)))[0])
        out[d] = mean, spread / 4
    return out


def hashed(points: DataFrame) -> DataFrame:
    """points with `strings`: one integer a tree, by the direction from a place beside the mean of all vectors (in one dimension more,
    a quarter of the usual distance off), so that neither where vectors lie nor how long they are is lost; distances don't depend on it."""
    centre = centres(points)

    def run(batches):
        for b in batches:
            dims = np.array(b.column("dim").to_pylist())
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                mean, beside = centre[int(d)]
                x = matrix(own.column("vec")) - mean
                x = np.concatenate([x, np.full((len(x), 1), beside or 1.0)], axis=1)
                made = np.stack([strings(x, t) for t in range(TREES)], axis=1)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, TREES, dtype=np.int32)), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, column], [*own.schema.names, "strings"])

    return points.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in points.schema.fields)}, strings array<bigint>")


PLACE = ["dim", "tree", "range", "lane"]


def met(held: DataFrame, asks: DataFrame) -> DataFrame:
    """Each range's strings in order, then the queries sent to it (level: where the tree's ascent ends)."""
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*PLACE, "asks", "string", "pid", "level", "block"]
    return held.select(columns).unionByName(asks.select(columns)).repartition(n, *PLACE).sortWithinPartitions(*PLACE, "asks", "string")


def answered(both: DataFrame, answer, schema: str) -> DataFrame:
    """answer(sorted strings, pids, blocks, query strings, query pids, levels, place) over each range's queries, batch by batch."""

    def run(batches):
        at, kept, held = None, [], None
        for b in batches:
            for (*place, asks), i, j in stretches(b, 5):
                if place != at:
                    at, kept, held = place, [], None
                part = [b.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in (5, 6, 8 - asks)]
                if not asks:
                    kept.append(part)
                elif kept:
                    held = held or tuple(np.concatenate([k[x] for k in kept]) for x in range(3))
                    yield from answer(*held, *part, place)

    return both.mapInArrow(run, schema)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the nearest found for each row that is_query holds for."""
    spark = vectors.sparkSession
    prepare(spark)
    vec = quoted(vec_col)
    kind = vectors.select(vec).schema[0].dataType.simpleString()
    rows = vectors.where(usable(vec) & quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), (vec if kind == "array<float>" else vec.cast("array<double>")).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    text = F.array_join(F.transform("vec", lambda v: F.hex(F.concat_ws(":", (v.cast("double") + 0.0).cast("string")))), ",")
    rows = cut(rows.withColumn("key", F.sha2(text, 256)))
    total = rows.select("key").distinct().count()
    if total == 0:
        return spark.createDataFrame([], RESULT)
    points, ranges, deep = dealt(cut(hashed(distinct_vectors(rows, top)).withColumn("pid", F.monotonically_increasing_id())), total)
    answers = compared(points, candidates(points, ranges, deep, TREES * (top + 1) + GOAL * total ** (2 / 3)), top)
    merged = answers.groupBy("pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top + 1).alias("found"))
    by_key = points.where("asking > 0").select("pid", "key", "asking").join(merged, "pid").drop("pid")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "key")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    listed = join_hot(asking, cut(by_key), "key", "asking").select("query_id", own.alias("found"))
    return listed.select("query_id", F.posexplode("found").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def head(string: Column, level: int) -> Column:
    """The string's first symbols as an integer."""
    return F.shiftright(string, WIDTH * (SYMBOLS - level))


def dealt(points: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """points with the block of their vectors; each tree's ranges with n and lanes; and the number of symbols that make a range."""
    deep = 0
    while deep < SYMBOLS and total > RANGE << (WIDTH * deep):
        deep += 1
    each = points.select("dim", F.posexplode("strings").alias("tree", "string")).withColumn("range", head(F.col("string"), deep))
    ranges = cut(each.groupBy("dim", "tree", "range").agg(F.count("*").alias("n")).withColumn("lanes", F.ceil(F.col("n") / LANE).cast("int")))
    first = ranges.where("tree = 0").select("dim", F.col("range").alias("first"), F.col("lanes").alias("parts"))
    lane = F.pmod(F.xxhash64("key"), F.col("parts"))
    placed = points.withColumn("first", head(F.col("strings")[0], deep)).join(first, ["dim", "first"])
    return placed.withColumn("block", F.shiftleft("first", 12) + lane).drop("first", "parts"), ranges, deep


def candidates(points: DataFrame, ranges: DataFrame, deep: int, goal: float) -> DataFrame:
    """pid (of a query), block, and pids of its candidates there: one row for each tree, range and block."""
    forest = points.select("pid", "block", "dim", F.col("asking") > 0, F.posexplode("strings").alias("tree", "string")).toDF("pid", "block", "dim", "asks", "tree", "string")
    forest = forest.withColumn("range", head(F.col("string"), deep))
    lanes = ranges.select("dim", "tree", "range", "lanes")
    held = forest.join(lanes, ["dim", "tree", "range"]).withColumn("lane", F.pmod(F.xxhash64("pid"), F.col("lanes")).cast("int")).withColumn("asks", F.lit(False)).withColumn("level", F.lit(0))
    queries = forest.where("asks").drop("range")

    def sent(asks: DataFrame, level: Column) -> DataFrame:
        """Each query at all lanes of the ranges that its first symbols, `level` or at most `deep`, lead to."""
        up = F.greatest(F.lit(0), F.lit(deep) - level) * WIDTH
        low = F.call_function("shiftleft", F.call_function("shiftright", head(F.col("string"), deep), up), up)
        d = asks.withColumn("low", low).withColumn("range", F.explode(F.sequence(F.col("low"), F.col("low") + F.call_function("shiftleft", F.lit(1).cast("long"), up) - 1)))
        return d.join(lanes, ["dim", "tree", "range"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))

    def count(held_strings, held_pids, held_blocks, asked, pids, levels, place):
        got = [shared(held_strings, asked, x) for x in range(deep, SYMBOLS + 1)]
        n = np.stack([hi - lo for lo, hi in got], axis=1)
        for level in range(n.shape[1]):
            own = np.flatnonzero(n[:, level])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(pids[own]), pa.array(np.full(len(own), place[1], np.int32)), pa.array(np.full(len(own), deep + level, np.int32)), pa.array(n[own, level])], ["pid", "tree", "level", "n"])

    at_own = sent(queries.withColumn("level", F.lit(deep)), F.lit(deep))
    below = answered(met(held, at_own), count, "pid bigint, tree int, level int, n bigint").groupBy("pid", "tree", "level").agg(F.sum("n").alias("n"))
    if deep:  # shorter prefixes than the ranges': sums of the ranges' counts
        up = lambda c: F.expr(f"shiftright({c}, {WIDTH} * ({deep} - level))")
        level = F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("level")
        sums = ranges.select("dim", "tree", "range", "n", level).withColumn("at", up("range")).groupBy("dim", "tree", "level", "at").agg(F.sum("n").alias("n"))
        asked = queries.select("pid", "dim", "tree", head(F.col("string"), deep).alias("range"), level).withColumn("at", up("range"))
        below = below.unionByName(asked.join(sums, ["dim", "tree", "level", "at"]).select("pid", "tree", "level", "n"))
    # Upwards from the longest match: trees in turn at each level, each adding what the longer prefix had not. A query has
    # at most TREES * (SYMBOLS + 1) such counts.
    longer = Window.partitionBy("pid", "tree").orderBy(F.desc("level"))
    path = Window.partitionBy("pid").orderBy(F.desc("level"), "tree")
    steps = below.withColumn("more", F.col("n") - F.coalesce(F.lag("n").over(longer), F.lit(0))).withColumn("sum", F.sum("more").over(path))
    reached = steps.where(F.col("sum") - F.col("more") < goal).groupBy("pid", "tree").agg(F.min("level").alias("level"))
    ascents = cut(queries.join(reached, ["pid", "tree"]))

    def fetch(held_strings, held_pids, held_blocks, asked, pids, levels, place):
        for q, lo, hi in zip(pids.tolist(), *map(np.ndarray.tolist, shared(held_strings, asked, levels))):
            if lo < hi:
                order = np.argsort(held_blocks[lo:hi], kind="stable")
                block, own = held_blocks[lo:hi][order], held_pids[lo:hi][order]
                at = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) - 1, q)), pa.array(block[at[:-1]]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own))], ["pid", "block", "pids"])

    return answered(met(held, sent(ascents, F.col("level"))), fetch, "pid bigint, block bigint, pids array<bigint>")


def compared(points: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """pid and found: the nearest (score, vec_id) of each query's candidates in a block."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = cut(found.groupBy("block", "pid").agg(F.array_distinct(F.flatten(F.collect_list("pids"))).alias("pids")))  # at most a block's vectors
    lanes = lists.groupBy("block").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("lanes"))
    asks = lists.join(lanes, "block").join(points.select("pid", "vec"), "pid").select("block", F.pmod(F.xxhash64("pid"), F.col("lanes")).cast("int").alias("lane"), F.lit(1).alias("asks"), "pid", "vec", "pids", F.lit(None).cast("array<bigint>").alias("ids"))
    stored = points.join(lanes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("asks"), "pid", "vec", F.lit(None).cast("array<bigint>").alias("pids"), "ids")
    meet = stored.unionByName(asks).repartition(n, "block", "lane").sortWithinPartitions("block", "lane", "asks", "pid")

    def run(batches):
        at, kept, held, ids, pids = None, [], None, [], []
        for b in batches:
            for where, i, j in stretches(b, 3):
                if where[:2] != at:
                    at, kept, held, ids, pids = where[:2], [], None, [], []
                part = b.slice(i, j - i)
                if not where[2]:
                    kept += by_length(part.column(4))
                    ids += part.column(6).to_pylist()
                    pids.append(part.column(3).to_numpy())
                    continue
                held = held or (*stacked(kept), np.concatenate(pids))
                lists = [np.searchsorted(held[2], own) for own in vectors_of(part.column(5))]
                found = [nearest_of(held[0][len(v)], held[1][own], ids, own, v) for v, own in zip(vectors_of(part.column(4)), lists)]
                yield pa.RecordBatch.from_arrays([part.column(3), pa.array(found, FOUND_ARROW)], ["pid", "found"])

    def nearest_of(x: np.ndarray, rows: np.ndarray, ids: list, own: np.ndarray, vec: np.ndarray) -> list[dict]:
        d = np.sqrt(((x[rows] - vec) ** 2).sum(axis=1))
        m = min(len(d), top + 1)
        best = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
        pairs = sorted((float(d[k]), v) for k in best.tolist() for v in ids[own[k]])
        return [{"score": e, "vec_id": v} for e, v in pairs[: top + 1]]

    return meet.mapInArrow(run, "pid bigint, found array<struct<score: double, vec_id: bigint>>")


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    flat, kind = column.flatten().to_numpy(zero_copy_only=False), np.int64 if pa.types.is_integer(column.type.value_type) else np.float64
    at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    flat = flat.astype(kind)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def by_length(column: pa.Array) -> list[np.ndarray]:
    """Rows of a column of vectors as matrices: one for each stretch of equal length."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1).tolist(), len(n)]
    return [matrix(column.slice(i, j - i)) for i, j in zip(at[:-1], at[1:])]


def stacked(parts: list[np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """A matrix for each length, and each vector's row in the matrix of its length."""
    rows, count = [], {}
    for x in parts:
        dim = x.shape[1]
        rows.append(np.arange(len(x)) + count.get(dim, 0))
        count[dim] = count.get(dim, 0) + len(x)
    return {dim: np.concatenate([x for x in parts if x.shape[1] == dim]) for dim in count}, np.concatenate(rows)


FOUND_ARROW = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
