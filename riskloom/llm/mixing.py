"""Mixing sources to target weights.

Each document gets a hash-random key; documents are range-sorted by source and key over all partitions, and word counts are
summed along that order: within a partition row by row, across partitions by each source's totals of the partitions before.
A source's budget is cut exactly: whole epochs first, then the documents whose running sum stays within what is left, the last
of them in part. A hot source spreads over many partitions as its keys do.

Sources come by code point, null last, and weigh WEIGHTS in turn. A null text has size 0; a document of size 0 takes 0.
Documents without id or with the same id as others are documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, passes, prepare, quoted, utf8, with_arrow, word_spans

#: Weights of the sources in order, repeating; the most epochs; the key's seed.
WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 17


def word_count(docs: DataFrame, text_col: str = "text", out_col: str = "size", keep: list[str] | None = None) -> DataFrame:
    prepare(docs.sparkSession)

    def run(texts):
        got = [word_spans(*utf8(texts.slice(i, j - i)))[2] for i, j in passes(texts)]
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *got]), pa.int64())]

    return with_arrow(docs, [text_col], [T.StructField(out_col, T.LongType())], run, keep)


def level(sources: DataFrame, total: int, epochs: int = EPOCHS) -> float:
    """Words for each unit of weight, so that targets of weight times this, cut at the caps, have the total's sum."""
    rate = None
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) >= F.col("source_size") * epochs
        got = sources.agg(F.sum(F.when(full, F.col("source_size") * epochs)), F.sum(F.when(~full, F.col("weight")))).first()
        if not got[1]:
            return rate or 0.0
        now = (total - (got[0] or 0)) / got[1]
        if rate is not None and now <= rate * (1 + 1e-12):
            return rate
        rate = now


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """id_col, source_col, size, source_size, target and taken of each row of docs.

    row_col: a unique key of docs' rows, passed on; rows of one id and size then come in order of their texts' hashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = [] if row_col is None else [F.xxhash64(quoted(text_col).cast("string")).alias("hash"), quoted(row_col).alias("row")]
    extra = ["hash", "row"] if more else []
    sized = word_count(docs.select(quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), quoted(text_col).cast("string").alias("text"), *more), "text", keep=["id", "source", *extra])
    keyed = sized.select("id", "source", "size", *extra, F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("s"), F.xxhash64(F.lit(seed), "id").alias("key"))
    order = ["none", "s", "key", "id", "size", *extra]
    ranged = cut(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))

    w = Window.partitionBy("none", "s").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("pid", "none", "s").agg(F.sum("size").alias("part"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("part").over(w), F.lit(0))).drop("part")

    # A source's place in the order: sources that begin in partitions before, and those before it in its first partition.
    by_source = cut(totals.groupBy("none", "s").agg(F.min("pid").alias("first"), F.sum("part").alias("source_size")))
    begun = by_source.groupBy("first").agg(F.count("*").alias("begun"))
    ahead = begun.withColumn("ahead", F.coalesce(F.sum("begun").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("first").orderBy("none", "s")) - 1
    weighed = by_source.join(ahead, "first").withColumn("place", place).select("none", "s", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))
    weighed = cut(weighed)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate = level(weighed, total, epochs)
    target = F.least(F.col("weight") * F.lit(rate), (F.col("source_size") * epochs).cast("double"))
    plans = weighed.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
    plans = plans.select("none", "s", "source_size", "target", "whole", (F.col("budget") - F.col("whole") * F.col("source_size")).alias("left"))

    before = running(ranged, order)
    joined = before.join(offsets, ["pid", "none", "s"]).join(plans, ["none", "s"])
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("offset") - F.col("before")))
    return joined.select(
        *([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + rest).cast("long").alias("taken"),
    )


def running(ranged: DataFrame, order: list[str]) -> DataFrame:
    """ranged with before: the sizes before each row among its partition's rows of its source."""

    def run(batches):
        at, total = None, 0
        for b in batches:
            size = b.column(b.schema.get_field_index("size")).to_numpy()
            keys = list(zip(b.column(b.schema.get_field_index("pid")).to_pylist(), b.column(b.schema.get_field_index("none")).to_pylist(), b.column(b.schema.get_field_index("s")).to_pylist()))
            out = np.empty(len(size), np.int64)
            for i, (key, n) in enumerate(zip(keys, size.tolist())):
                if key != at:
                    at, total = key, 0
                out[i], total = total, total + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "before"])

    # The checkpoint's files may be read in any order, so the order within a partition is made anew; rows stay where pid puts them.
    spark = ranged.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranged.repartition(n, "pid").sortWithinPartitions("pid", *order)
    return rows.mapInArrow(run, T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType())]))


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words hold it, a half or more counting as once.

    row_col: a unique key of docs' rows that is the same each time they are read, and is dropped; without one, docs are written
    to the shared checkpoint folder with such a key.
    """
    keyed = cut(docs.withColumn("__row", F.monotonically_increasing_id())) if row_col is None else docs.withColumnRenamed(row_col, "__row")
    took = mix(keyed, text_col, source_col, id_col, row_col="__row").where("size > 0").select("__row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__times")).where("__times > 0")
    joined = keyed.join(took, "__row")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[quoted(c) for c in docs.columns if c != row_col])
