"""Helpers that the operators share: Arrow batches in and out, checkpoints, hashes of words."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows in one Arrow batch; with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 512
#: Bytes of text that a numpy pass looks at together; one longer text is a pass of its own.
PASS_BYTES = 1 << 20

#: The six bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """This package on the executors, small Arrow batches, and a shared checkpoint folder: the session's own where it names one."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; without one, a folder of this machine, and only where Spark runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: survives lost executors and ends the lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and offsets; a null is an empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = pc.fill_null(values, "")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(values.type)
    ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def passes(values: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes of text."""
    _, ends = utf8(values)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def with_arrow(
    df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField], fn: Callable[..., Sequence[pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """df and new columns that fn makes of Arrow arrays, batch by batch.

    A column of df that has a new column's name (in any case) is replaced, as withColumn does. keep: columns to pass on.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    at = {c: kept.index(c) for c in inputs if c in kept}
    more = [c for c in dict.fromkeys(inputs) if c not in at]
    src = df.select(*[quoted(c) for c in kept], *[quoted(c).alias(f"__in{i}") for i, c in enumerate(more)])
    at |= {c: len(kept) + i for i, c in enumerate(more)}
    schema = T.StructType([*src.schema.fields[: len(kept)], *fields])
    places, n_kept, names = [at[c] for c in inputs], len(kept), [f.name for f in schema.fields]

    def run(batches):
        try:
            for b in batches:
                made = fn(*[b.column(i) for i in places])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_kept)], *made], names)
                del b, made
        finally:
            give_back()

    return src.mapInArrow(run, schema)


def give_back() -> None:
    """Returns to the system what a task has freed: Spark keeps a worker's process for later tasks, and idle ones hold their memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key has remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def crc_mod_np(keys: list, n: int) -> np.ndarray:
    return np.array([0 if k is None else zlib.crc32(str(k).encode()) % n for k in keys], dtype=np.int64)


#: An odd factor and its inverse modulo 2**64, for polynomial hashes by prefix sums.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs of bytes that are not spaces) and the number of words of each text."""
    word = ~SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1 if len(word) else np.zeros(0, np.int64)
    bounds = ends[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    inner = bounds[word[bounds] & word[bounds - 1]] if len(bounds) else bounds
    starts = edge[word[edge]]
    stops = edge[~word[edge]]
    if len(word) and word[0]:
        starts = np.concatenate([[0], starts])
    if len(word) and word[-1]:
        stops = np.concatenate([stops, [len(word)]])
    if len(inner):
        inner = np.unique(inner)
        starts = np.sort(np.concatenate([starts, inner]))
        stops = np.sort(np.concatenate([stops, inner]))
    counts = np.searchsorted(starts, ends[1:], "left") - np.searchsorted(starts, ends[:-1], "left")
    return starts, stops, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = (total[stops] - total[starts]) * powers(BASE_INVERSE, n + 1)[starts]
    return mix(h)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in `weight` how many rows of left have it; weight is dropped.

    Keys of more rows than an even share of a partition are at most as many as there are partitions, so these rows of right
    are broadcast and their rows of left stay where they are. Only the other keys are shuffled. how: inner or left.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight)).first()[0] or 0
    most = max(1, total // parts)
    hot, cold = right.where(F.col(weight) > most), right.where(F.col(weight) <= most).drop(weight)
    keys = F.broadcast(hot.select(key))
    split = F.broadcast(hot.drop(weight))
    return left.join(split, key).unionByName(left.join(keys, key, "left_anti").join(cold, key, how))


def join_salted(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """join_hot by one shuffle, in which left is read once: rows of a hot key are dealt to places by their hash, and the key's row
    of right stands in each of these places. rows: how many rows left has, if that is known; else right's weights are added up.

    The broadcast table has a row for each key of more rows than an even share of a partition: fewer than there are partitions.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows if rows is not None else right.agg(F.sum(weight)).first()[0] or 0
    most = max(1, total // parts)
    places = F.ceil(F.col(weight) / most).cast("int")
    hot = F.broadcast(right.where(F.col(weight) > most).select(key, places.alias("__places")))
    dealt = left.join(hot, key, "left").withColumn("__place", F.when(F.col("__places").isNotNull(), F.pmod(F.xxhash64(*[quoted(c) for c in left.columns]), F.col("__places")).cast("int")).otherwise(0)).drop("__places")
    spread = right.withColumn("__place", F.explode(F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1))).drop(weight)
    return dealt.join(spread, [key, "__place"], how).drop("__place")


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the file system that its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
