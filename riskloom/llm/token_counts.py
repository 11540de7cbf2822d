"""Token counts from a cache of digests.

A text's content digest and the tokenizer's version digest name a count. Counts stand in a Parquet folder that the cluster
shares, one subfolder for each tokenizer version. Digests of the documents are joined with the stored ones; of the texts that
are missing, each different one is encoded once, and its count is appended to the folder. The documents then take their counts
from there by digest.

Content is normalised first as the tokenizer itself does before it looks at a text (a vocabulary without a normaliser: as it
is), so texts that no count can tell apart share one entry. Null counts as empty; an empty text has no tokens. The version
digest covers the vocabulary's bytes and this module's way to count, so another file or way never meets old counts.

An append that a lost executor or driver interrupts leaves either nothing or whole rows; rows that were written twice are read
as one. Repeated rows and ids each get their count; a digest of very many documents is not shuffled to one task. Columns named
like new ones are replaced. Empty tables give empty tables. Very long texts travel compressed and are encoded in one task each,
unsplit stretches of them by halves.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import cut, join_hot, prepare, quoted, with_arrow

#: Part of the version digest: a new number where counts of the same file may differ.
WAY = "1"
#: Stored digests up to this number (some 20 MB) are broadcast, and known texts do not travel; beyond it they meet by digest.
HELD = 1 << 18
STORED = "digest string, n_tokens long"


@functools.lru_cache(maxsize=4)
def version(path: str) -> str:
    """A digest of the vocabulary and of how this module counts with it."""
    h = hashlib.sha256(f"{WAY}:{path.rpartition('.')[2]}:".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def is_plain(spec: dict) -> bool:
    """Whether a tokenizers file is byte-level BPE as `bpe.ByteBpe` runs it: its pattern, no normaliser, merges in the order of ids."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["post_processor"] and spec["post_processor"].get("type") != "ByteLevel" or model["type"] != "BPE" or before.get("type") != "ByteLevel":
        return False
    if before.get("add_prefix_space") or not before.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(a < b for a, b in zip(ids, ids[1:]))


class Counter:
    """A vocabulary's count of tokens; `normalise` (None: texts stay as they are) gives what a text's count follows from."""

    def __init__(self, path: str):
        self.normalise = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text, num_threads=1))
            return
        if not path.endswith(".json"):
            raise ValueError(f"neither a tokenizers file (.json) nor a sentencepiece one (.model): {path}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if is_plain(spec):
            encode = bpe.tokenizer(path).encode
            self.count = lambda text: len(encode(text))
            return
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_padding()
        whole.no_truncation()
        self.count = lambda text: len(whole.encode(text, add_special_tokens=False).ids)
        added = spec["added_tokens"]
        if whole.normalizer is not None and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            # The library looks for added tokens first and normalises what is between them.
            cut = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
            parts = lambda text: cut.split(text) if cut else [text]
            self.normalise = lambda text: json.dumps([p if i % 2 else whole.normalizer.normalize_str(p) for i, p in enumerate(parts(text))])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def with_digest(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """docs with `__digest`, the SHA-256 of the normalised text."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    if counter(path).normalise is None:
        return docs.withColumn("__digest", F.sha2(text.cast("binary"), 256))

    def run(texts):
        normalise = counter(path).normalise
        return [pa.array([hashlib.sha256(normalise(t.as_py()).encode()).hexdigest() for t in texts], pa.string())]

    named = with_arrow(docs.withColumn("__text", text), ["__text"], [T.StructField("__digest", T.StringType())], run)
    return named.drop("__text")


def folder(cache: str, path: str) -> str:
    return f"{cache}/tokenizer={version(path)}"


def stored(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """digest and n_tokens of the texts counted so far with this tokenizer version, one row each."""
    place = folder(cache, path)
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(place)  # begins a cache that isn't there
    return spark.read.schema(STORED).parquet(place).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, text_col: str = "text", vocabulary: str | None = None) -> None:
    """Appends the counts of all texts of docs that the cache hasn't, each different text encoded once."""
    path = vocabulary or bpe.default_vocabulary()
    spark = docs.sparkSession
    prepare(spark)
    known = stored(spark, cache, path).select(F.col("digest").alias("__digest"))
    texts = with_digest(docs, text_col, path).select("__digest", F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    few = known.count() <= HELD
    if few:  # what is known stays where it is
        texts = texts.join(F.broadcast(known), "__digest", "left_anti")

    def pack(batches):
        for b in batches:
            raw = [t.as_buffer() for t in b.column(1)]
            packed = [pa.compress(r, codec="zstd", asbytes=True) if r.size else b"" for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.size for r in raw], pa.int64()), pa.array(packed, pa.binary())], ["__digest", "size", "packed"])

    def encode(batches):
        for b in batches:
            count = counter(path).count
            texts = (pa.decompress(p.as_buffer(), n.as_py(), codec="zstd").to_pybytes().decode() if n.as_py() else "" for n, p in zip(b.column(1), b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in texts], pa.int64())], ["digest", "n_tokens"])

    # Copies within a task become one before they travel.
    distinct = texts.mapInArrow(pack, "__digest string, size long, packed binary").groupBy("__digest").agg(F.first("size").alias("size"), F.first("packed").alias("packed"))
    misses = distinct if few else distinct.join(known, "__digest", "left_anti")
    misses.mapInArrow(encode, STORED).write.mode("append").parquet(folder(cache, path))


def token_counts(docs: DataFrame, cache: str, text_col: str = "text", vocabulary: str | None = None, limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; other columns stay, or those in keep.

    cache: a folder that driver and executors share; see the module's text. vocabulary: a tokenizers file (.json) or a
    sentencepiece one (.model); counts are the library's, without begin, end or added special tokens.
    """
    path = vocabulary or bpe.default_vocabulary()
    fill(docs, cache, text_col, path)
    named = with_digest(docs, text_col, path)
    counts = stored(docs.sparkSession, cache, path).withColumnRenamed("digest", "__digest")
    used = cut(named.groupBy("__digest").agg(F.count("*").alias("__rows")).join(counts, "__digest"))
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    size = F.octet_length(F.coalesce(quoted(text_col).cast("string"), F.lit(""))).cast("long")
    slim = named.select(*[quoted(c) for c in kept], size.alias("n_bytes"), "__digest")
    return join_hot(slim, used, "__digest", "__rows").drop("__digest").withColumn("over_limit", F.col("n_tokens") > limit)
