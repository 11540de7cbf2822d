"""Collocations against a count of every n-gram, under small tables, salted pivots and small passes."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskloom.llm import collocations, queries

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def every(rows, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in held.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in held.items():
            if 100 * longer[p] < share * a or not longer[p]:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "The", "the", "cat", "né", "x y", "-", "rare%d"]
    for i in range(n):
        t = "".join((r.choice(words[: r.choice([3, 8, 9])]).replace("%d", str(r.randrange(50)))) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(r.randrange(40)))
        yield r.choice(["en", "en", "de x", None, "und"]), t
    yield "en", None
    yield "en", ""
    yield "fr", " \t\n.,"
    yield "en", "a b " * 3000  # no end of a piece, and one pivot that is most of all
    yield "de", "a " * 400 + "b" * 5000 + " a b" * 200


ROWS = list(texts(1, 300)) + list(texts(2, 20)) * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i % 50 if i % 7 else None, lang, t, "x") for i, (lang, t) in enumerate(ROWS)], "doc_id long, lang string, text string, a string").repartition(3)


@pytest.mark.parametrize("least,longest,top,share,more", [
    (4, 4, 2000, 80, {}), (2, 3, 7, 50, {}), (4, 4, 2000, 80, {"most_words": 2}), (4, 4, 2000, 80, {"pass_bytes": 300}), (3, 5, 100, 100, {"pass_bytes": 2000, "most_words": 5}),
])
def test_against_every_ngram(docs, least, longest, top, share, more):
    got = collocations.collocations(docs, least=least, longest=longest, top=top, share=share, **more)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields) == "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    assert sorted(map(tuple, got.collect())) == every(ROWS, least, longest, top, share)


def test_salted_pivots_and_lost_partitionings(docs, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.0001)
    assert sorted(map(tuple, collocations.collocations(docs.repartition(1), least=4).collect())) == every(ROWS, 4, 4, 2000, 80)


def test_empty_and_wordless_tables(spark, docs):
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string"), least=1).collect() == []


def test_query_and_its_sql(spark, tmp_path):
    rows = [(i, lang, t) for i, (lang, t) in enumerate(ROWS * 2)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_collocations(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got and got == sorted(con.execute(queries.ORACLE_SQL["op11_collocations"]).fetchall()) == every([r[1:] for r in rows], 30, 4, 2000, 80)


def test_each_ngram_has_one_place():
    r = np.random.default_rng(1)
    rank, piece = r.integers(-1, 5, 200), np.sort(r.integers(0, 20, 200))
    left, right = collocations.extents(rank, piece, 4)
    for i in range(200):
        for m in range(2, 5):
            if i + m <= 200 and len(set(piece[i : i + m])) == 1 and (rank[i : i + m] >= 0).all():
                owners = [c for c in range(i, i + m) if left[c] >= c - i and right[c] >= i + m - 1 - c]
                assert owners == [i + int(np.argmax(rank[i : i + m]))]


def test_rows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mix", lambda h: h * np.uint64(0))
    rows, n = collocations.grouped([np.array([1, 2, 1, 3, 2]), np.array([1, 1, 1, 1, 1])], np.array([1, 1, 1, 1, 5]))
    assert sorted(zip(np.array([1, 2, 1, 3, 2])[rows].tolist(), n.tolist())) == [(1, 2), (2, 6), (3, 1)]


def test_windows_hold_whole_words_and_the_reach():
    text = b"aa bb cc dd " * 50 + b"e" * 300 + b" ff gg" * 40
    data = np.frombuffer(text, np.uint8)
    starts, stops = collocations.spans(data)
    seen = []
    for low, own, to, high in collocations.windows(data, 3, 100):
        for a in (low, own, to, high):
            assert not ((starts < a) & (stops > a)).any()
        inside = np.flatnonzero((starts >= own) & (starts < to))
        seen += inside.tolist()
        assert low <= starts[max(0, inside[0] - 3)] and high >= stops[min(len(stops) - 1, inside[-1] + 3)]
    assert seen == list(range(len(starts)))
