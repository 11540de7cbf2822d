"""Token counts against the libraries, and what the cache keeps, shares and repairs."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, queries, token_counts

TEXTS = ["", None, "hello world", "Hello  World", "HELLO WORLD", "<|endoftext|> a <|endoftext|>", "né 𝒳 é é", "\n\n  x\t", "z" * 9_000, "ab " * 30_000, "don't we'll 12345 <|startoftext|>", "<s> x </s>", "\x00‍"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return path, lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return path, lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 40 if i % 9 else None, TEXTS[i % len(TEXTS)], 5) for i in range(150)] + [(i, "hot text", 5) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)


def rows_in(spark, place):
    return spark.read.parquet(place).count()


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(spark, docs, tmp_path, name):
    path, count = library(name)
    want = {t: count(t or "") for t in [*TEXTS, "hot text"]}
    got = token_counts.token_counts(docs, f"{tmp_path}/c", vocabulary=path, limit=10)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields) == "doc_id bigint, text string, n_bytes bigint, n_tokens bigint, over_limit boolean"
    rows = got.collect()
    assert len(rows) == 350
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), want[r["text"]], want[r["text"]] > 10)
    first = rows_in(spark, token_counts.folder(f"{tmp_path}/c", path))
    # Null counts as empty; the lower-casing vocabulary counts texts that it can't tell apart once.
    assert first == len({token_counts.counter(path).normalise(t or "") if token_counts.counter(path).normalise else t or "" for t in want})
    assert (name == "word_bpe_49k.json") == (first < len({t or "" for t in want}))


def test_only_new_texts_are_encoded_and_appended(spark, docs, tmp_path):
    path, cache = bpe.default_vocabulary(), f"{tmp_path}/c"
    place = token_counts.folder(cache, path)
    token_counts.fill(docs.where("text = 'hot text'"), cache)
    assert rows_in(spark, place) == 1
    # A stored count is taken as it is: it shows whether a text was encoded again.
    spark.read.parquet(place).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(f"{tmp_path}/d/tokenizer={token_counts.version(path)}")
    got = token_counts.token_counts(docs, f"{tmp_path}/d").where("text = 'hot text'").select("n_tokens").distinct().collect()
    assert [r[0] for r in got] == [77]
    n = rows_in(spark, token_counts.folder(f"{tmp_path}/d", path))
    token_counts.fill(docs, f"{tmp_path}/d")
    assert n == rows_in(spark, token_counts.folder(f"{tmp_path}/d", path)) == len({t or "" for t in TEXTS}) + 1


def test_known_texts_beyond_the_broadcast_and_rows_written_twice(spark, docs, tmp_path, monkeypatch):
    path, cache = bpe.default_vocabulary(), f"{tmp_path}/c"
    token_counts.fill(docs.where("text = 'hot text'"), cache)
    spark.read.parquet(token_counts.folder(cache, path)).write.mode("append").parquet(token_counts.folder(cache, path))
    monkeypatch.setattr(token_counts, "HELD", 0)
    assert token_counts.token_counts(docs, cache).count() == 350
    assert rows_in(spark, token_counts.folder(cache, path)) == len({t or "" for t in TEXTS}) + 2


def test_other_vocabularies_have_their_own_counts(spark, docs, tmp_path):
    cache = f"{tmp_path}/c"
    for name in FILES:
        token_counts.fill(docs, cache, vocabulary=library(name)[0])
    assert len({token_counts.version(library(n)[0]) for n in FILES}) == len(list(tmp_path.glob("c/tokenizer=*"))) == 3
    with pytest.raises(ValueError):
        token_counts.counter("/x/y.tiktoken")


def test_empty_table_and_query(spark, docs, tmp_path):
    assert token_counts.token_counts(docs.limit(0), f"{tmp_path}/c").collect() == []
    docs.drop("n_tokens").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    _, count = library(FILES[0])
    spark.conf.set("riskloom.tokenCounts", f"{tmp_path}/own")
    try:
        df = queries.op13_token_counts(spark, str(tmp_path))
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
        got = sorted(map(tuple, df.collect()), key=str)
    finally:
        spark.conf.unset("riskloom.tokenCounts")
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := count(r["text"] or ""), n > 1024) for r in docs.collect()]
    assert got == sorted(want, key=str) and len(pq.read_table(next(tmp_path.glob("own/*")))) == len({t or "" for t in TEXTS}) + 1


def test_specials_of_any_spelling_are_one_token_in_short_and_long_texts():
    t = bpe.ByteBpe(bpe.default_vocabulary())
    t.specials = {"[CLS]": 7}
    assert t.encode("a [CLS]").count(7) == t.encode("a [CLS]" + " b" * 5000).count(7) == 1
