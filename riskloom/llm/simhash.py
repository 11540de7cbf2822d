"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is the majority of the XXH64 hashes of a text's word shingles, bit by bit. Two fingerprints link when at most
DISTANCE bits differ. The 64 bits are a ring of five segments; by the pigeonring principle each linked pair has a segment from
which every chain of l segments differs in at most l * DISTANCE / 5 bits: none in the first, one in two, two in three. So a
pair meets under a key made of one segment as it is and the next with at most one bit changed; longer chains prune what meets
by chance, and only then the whole fingerprints are compared. Equal fingerprints are one row before that, however many
documents share them. Documents linked directly or by way of others form a component.

Null texts count as empty; texts without words have fingerprint zero, linked like any other. Rows with the same id and
different texts are separate rows of the result. A component whose ids are all null has a null component_id. Of a component
that is cut down to one row, that is the first by id (null last), then by the digest of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, cut, join_hot, join_salted, prepare, quoted, with_arrow

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Widths of the ring's segments, and the place of each one's lowest bit.
WIDTHS = [13, 13, 13, 13, 12]
PLACES = [0, 13, 26, 39, 52]
#: A key's fingerprints above which they are dealt out as pairs of blocks over several tasks.
BLOCK = 4_096
#: Links that a task contracts together before it passes on a spanning forest.
LINKS = 200_000
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return POPCOUNT[np.ascontiguousarray(x).view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    spans = list(zip(starts[: len(words) - k + 1].tolist(), stops[k - 1 :].tolist()))
    n, ones, digest = len(spans), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + (1 << 15)]], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, text_col: str = "text", out_col: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """docs with the fingerprint of each text as a signed 64-bit integer."""
    prepare(docs.sparkSession)

    def run(texts):
        return [pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64), pa.int64())]

    return with_arrow(docs, [text_col], [T.StructField(out_col, T.LongType())], run, keep)


def segment(f: np.ndarray, i: int) -> np.ndarray:
    return (f >> np.uint64(PLACES[i % 5])) & np.uint64((1 << WIDTHS[i % 5]) - 1)


def ring_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, fingerprints and roles: role 0 has both segments as they are, role 1 has one set bit of the second cleared."""
    keys, prints, roles = [], [], []
    for i in range(5):
        head = (np.uint64(i) << np.uint64(26)) | (segment(f, i) << np.uint64(13))
        second = segment(f, i + 1)
        keys.append(head | second)
        prints.append(f)
        roles.append(np.zeros(len(f), np.int8))
        for b in range(WIDTHS[(i + 1) % 5]):
            bit = np.uint64(1 << b)
            own = (second & bit) != 0
            keys.append((head | (second ^ bit))[own])
            prints.append(f[own])
            roles.append(np.ones(int(own.sum()), np.int8))
    return np.concatenate(keys).view(np.int64), np.concatenate(prints), np.concatenate(roles)


def chained(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences x keep every chain from segment `start` within its budget; the last chain is the whole ring."""
    total, ok = np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
    for n in range(5):
        total = total + popcount(segment(x, start + n))
        ok &= total <= (n + 1) * DISTANCE // 5
    return ok


class Forest:
    """Union by least element."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        root = a
        while (up := self.up.get(root, root)) != root:
            root = up
        while a != root:
            self.up[a], a = root, self.up.get(a, a)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def group_links(start: int, plain: np.ndarray, changed: np.ndarray, same: bool = True) -> list[tuple[int, int]]:
    """A spanning forest of the links among plain, and between changed and plain, of one key. same: plain is compared with itself."""
    out, forest = [], Forest()
    for other, own in ((plain, True), (changed, False)) if same else ((changed, False),):
        for i in range(0, len(other), 256):
            part = other[i : i + 256]
            diff = part[:, None] ^ plain[None, :]
            near = chained(diff, start)
            if own:
                near &= part[:, None] < plain[None, :]
            a, b = np.nonzero(near)
            for x, y in zip(part[a].tolist(), plain[b].tolist()):
                if x != y and forest.union(x, y):
                    out.append((x, y))
    return out


EDGE = "a bigint, b bigint"


def contracted(edges: np.ndarray) -> pa.RecordBatch:
    """Stars that connect what the edges connect."""
    forest = Forest()
    for x, y in edges.tolist():
        forest.union(x, y)
    nodes = np.unique(edges)
    roots = np.array([forest.find(x) for x in nodes.tolist()], dtype=np.int64)
    own = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["a", "b"])


def links(prints: DataFrame, col: str = "simhash") -> DataFrame:
    """Edges (a > b) whose components are those of all links among the different fingerprints in prints[col]."""
    spark = prints.sparkSession

    def keyed(batches):
        for batch in batches:
            k, f, r = ring_keys(batch.column(0).to_numpy().view(np.uint64))
            for i in range(0, len(k), 16384):
                s = slice(i, i + 16384)
                yield pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(f[s].view(np.int64)), pa.array(r[s])], ["key", "f", "role"])

    rows = prints.select(col).mapInArrow(keyed, "key bigint, f bigint, role tinyint")
    # A key of many fingerprints: each one goes to one of its blocks, and each pair of blocks is a task's group.
    plain = F.count_if(F.col("role") == 0)
    hot = cut_edges(rows.groupBy("key").agg(F.ceil(plain / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")).where("blocks > 1"))
    dealt = join_hot(rows, hot, "key", "rows", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).otherwise(0))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Group (u, v): plain rows of block u, compared with plain rows of v (u <= v) and changed rows of v.
    grouped = dealt.select("key", "f", "role", "own", F.explode(others).alias("other"))
    placed = grouped.select("key", "f", F.when(F.col("role") == 0, F.lit(0)).otherwise(1).cast("tinyint").alias("role"), F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("u"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("v"))
    # Plain rows of v must also stand in (u, v) to be compared with those of u: as changed ones.
    crossed = grouped.where("role = 0 and other < own").select("key", "f", F.lit(1).cast("tinyint").alias("role"), F.col("other").alias("u"), F.col("own").alias("v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.unionByName(crossed).repartition(n, "key", "u", "v").sortWithinPartitions("key", "u", "v", "role")

    def find(batches):
        held = np.zeros((0, 5), np.int64)
        edges: list[np.ndarray] = []
        count = 0

        def look(rows: np.ndarray) -> None:
            nonlocal count
            if not len(rows):
                return
            at = np.flatnonzero((rows[1:, [0, 2, 3]] != rows[:-1, [0, 2, 3]]).any(axis=1)) + 1
            at = np.concatenate([[0], at, [len(rows)]])
            many = np.flatnonzero((np.diff(at) > 1) & (rows[at[:-1], 4] == 0))
            for i, j in zip(at[many], at[many + 1]):
                g = rows[i:j]
                plain = g[g[:, 4] == 0, 1]
                got = group_links(int(g[0, 0]) >> 26, plain.view(np.uint64), np.ascontiguousarray(g[g[:, 4] == 1, 1]).view(np.uint64), bool(g[0, 2] == g[0, 3]))
                if got:
                    edges.append(np.array(got, dtype=np.uint64).view(np.int64))
                    count += len(got)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            rows = np.concatenate([held, rows]) if len(held) else rows
            last = np.flatnonzero((rows[:, [0, 2, 3]] != rows[-1, [0, 2, 3]]).any(axis=1))
            keep_from = int(last[-1]) + 1 if len(last) else 0
            look(rows[:keep_from])
            held = rows[keep_from:]
            if count >= LINKS:
                yield contracted(np.concatenate(edges))
                edges, count = [], 0
        look(held)
        if edges:
            yield contracted(np.concatenate(edges))

    return sorted_rows.select("key", "f", "u", "v", "role").mapInArrow(find, EDGE)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): each node that has a smaller one in its component, and the least of them. Large-star and small-star rounds.

    A hub's edges are dealt out where they meet its least neighbour (see join_salted).
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    near = lambda df: df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
    e = cut(edges.where("a <> b").select(pair("a", "b").alias("p")).select("p.*").distinct())
    before = None
    for _ in range(most_rounds):
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            return e
        before = sign
        # Each node's larger neighbours go to the least of all its neighbours and itself.
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
        least = near(both).withColumn("m", F.least("a", "m"))
        up = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = join_salted(up, least, "a", "rows", rows=sign[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Each node and its smaller neighbours go to the least of these.
        met = join_salted(large, near(large), "a", "rows", rows=sign[0])
        small = met.select(F.explode(F.array(pair("b", "m"), F.struct(F.col("a"), F.col("m").alias("b")))).alias("p")).select("p.*").where("a <> b")
        e = cut(small.distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, simhash (signed) and component_id: the least id that links lead to."""
    prints = cut(simhash(docs.select(quoted(id_col), quoted(text_col).cast("string").alias("__text")), "__text", keep=[id_col]))
    classed = classes(prints, quoted(id_col))
    least = cut(classed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")))
    found = cut(join_salted(classed, least, "root", "prints").select("simhash", "component_id", "rows"))
    return join_salted(prints, found, "simhash", "rows").select(quoted(id_col), "simhash", "component_id")


def classes(prints: DataFrame, value: Column) -> DataFrame:
    """Each simhash with its rows, the least value of them (first) and the simhash that stands for its component (root)."""
    spark = prints.sparkSession
    each = prints.groupBy("simhash").agg(F.min(value).alias("first"), F.count("*").alias("rows"))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
        edges = cut_edges(links(each.select("simhash")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    roots = components(edges)
    return cut(each.join(roots, each["simhash"] == roots["a"], "left").select("simhash", "first", "rows", F.coalesce("b", "simhash").alias("root")))


def cut_edges(edges: DataFrame) -> DataFrame:
    sc = edges.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        prepare(edges.sparkSession)
    return edges.checkpoint(eager=True)


def row_key(row_id: Column, digest: Column) -> Column:
    """32 bytes that stand for an id and the digest of a text (empty for a null text)."""
    told = F.coalesce(F.concat(F.lit(b"="), row_id.cast("string").cast("binary")), F.lit(b""))
    return F.unhex(F.sha2(F.concat(F.sha2(told, 256).cast("binary"), digest), 256))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the first by id and digest of the text (of rows equal in both, one of them).

    A row is told by its id and text together, so null and repeated ids on texts of different components lose none of them.
    Rows meet the ones to keep by one key, by which they are also made distinct: texts are shuffled once. Rows that are
    repeated more often than an even share of a partition are kept once in each task before they are shuffled.
    """
    digest = F.coalesce(F.unhex(F.sha2(quoted(text_col).cast("string").cast("binary"), 256)), F.lit(b""))
    rows = docs.select(quoted(id_col).alias("__id"), digest.alias("__digest"), quoted(text_col).cast("string").alias("__text"))
    prints = cut(simhash(rows, "__text", keep=["__id", "__digest"]))
    classed = classes(prints, F.struct(F.col("__id").isNull().alias("none"), "__id", "__digest"))
    first = classed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    kept = cut(first.select(row_key(F.col("first.__id"), F.col("first.__digest")).alias("__key"), "rows"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, (kept.agg(F.sum("rows")).first()[0] or 0) // parts)
    # A component of more rows than that: there are fewer of them than partitions.
    hot = F.broadcast(kept.where(F.col("rows") > most).select("__key"))
    cold = kept.where(F.col("rows") <= most).select("__key").hint("merge")
    told = docs.withColumn("__key", row_key(quoted(id_col), digest))
    many = told.join(hot, "__key", "left_semi").dropDuplicates(["__key"])
    few = told.join(cold, "__key", "left_semi").dropDuplicates(["__key"])
    return few.unionByName(many).drop("__key")
