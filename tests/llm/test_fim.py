"""Fill-in-middle against plain slices, exact round trips, other units, and its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm import fim, queries

TEXTS = ["", None, "a", "né 𝒳 end", "with <P> inside", "<", "<M", "x<S>", "one two  three\nfour\r\nfive", "\x00‍ é", "word " * 20_000, "𝒳" * 70_000, *(f"text number {i} <" for i in range(150))]


def plain(doc_id, text):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fim")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (None, None)]
    spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, form string, n int").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_query_and_its_sql(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(x := plain(i, t))[:4], sha(x[4]), sha(t or "")) for i, t in sf_dir[1]]
    df = queries.op12_fill_in_middle(spark, sf_dir[0])
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(df.collect()) == order(want) and {w[2] for w in want} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir[0]}/documents.parquet/*.parquet')")
    assert order(con.execute(queries.ORACLE_SQL["op12_fill_in_middle"]).fetchall()) == order(want)


@pytest.mark.parametrize("unit,pieces", [("word", lambda t: __import__("re").findall(r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", t)), ("line", lambda t: t.splitlines(True) if "\x0b" not in t else None), ("char", list)])
def test_units(spark, sf_dir, unit, pieces):
    docs = spark.createDataFrame([(i, t) for i, t in sf_dir[1] if t is None or "\x00" not in t], "doc_id long, text string")
    made = fim.fim_transform(docs, rate=100, spm=50, unit=unit, seed=5)
    for r in fim.fim_restore(made).collect():
        text = r["text"] or ""
        assert r["restored"] == text
        if r["form"] != "plain":
            parts = [p for p in pieces(text.replace("\r\n", "\n\n")[:400])]
            ends = {sum(map(len, parts[:i])) for i in range(len(parts) + 1)}
            if len(text) < 400 and "\r" not in text:
                assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends


def test_sentinels_of_ones_own_and_wrong_ones(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d") for i in range(30)], "doc_id long, text string")
    own = ("[pre]", "[suf]", "[mid]")
    back = fim.fim_restore(fim.fim_transform(docs, sentinels=own), sentinels=own)
    assert back.where(F.col("restored") != F.col("text")).count() == 0 and back.where("form <> 'plain' and fim like '%[mid]%'").count() > 10
    for wrong in [("<P>", "<P>", "<M>"), ("<<P>", "<S>", "<M>"), ("", "<S>", "<M>")]:
        with pytest.raises(ValueError):
            fim.fim_transform(docs, sentinels=wrong)
    with pytest.raises(ValueError):
        fim.bounds(fim.points("ab"), "page")


def test_empty_tables_and_partitionings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    assert fim.fim_transform(docs.limit(0)).collect() == []
    a, b = (sorted(map(str, fim.fim_transform(d, keep=["doc_id"]).collect())) for d in (docs.repartition(1), docs.repartition(9)))
    assert a == b
    assert fim.fim_transform(docs).columns == ["doc_id", "text", "n", "fim", "form", "prefix_chars", "middle_chars"]
