"""Each query beside its SQL in DuckDB on the smallest tables; values agree to six digits."""

import decimal
import importlib
import math
import os
import re
import sys

import duckdb
import pytest

from riskloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_its_sql_rows(spark, views, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = views.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


#: Queries that SQL cannot say, and what must hold of their rows.
HOLDS = {
    "scrub_placeholders": lambda rows: len(rows) == 200 and not any(r["residual"] for r in rows) and sum(r["n"] for r in rows) > 10,
    "speech_chunks": lambda rows: rows and all(r is not None for r in rows),
    "ml_text_lr": lambda rows: rows and all(0 <= v <= 1 for r in rows for v in r if isinstance(v, float)),
    "bootstrap_auc": lambda rows: len(rows) == 1 and 0 <= rows[0]["lo"] <= rows[0]["mean"] <= rows[0]["hi"] <= 1,
    "domain_model_trained": lambda rows: {r["what"] for r in rows} == {"trained", "trained without grams", "trained without others", "length", "digits", "hyphens"} and all(r["auc"] is None or 0 <= r["auc"] <= 1 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert HOLDS[name](catalogue.QUERIES[name](spark, SF).collect())


def test_entry_works_without_the_llm_folders(monkeypatch):
    import __spark_entry__

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name in ("riskloom.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("riskloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delattr(importlib.import_module("riskloom"), "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalogue.SQL)


def test_no_other_module_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalogue.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", open(os.path.join(folder, f), encoding="utf-8").read(), re.M), f
