"""Every query against its SQL, at the smallest scale; and the package's own rules."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

from mnemora.plans import queries as q

ROOT = Path(__file__).resolve().parent.parent


def rows(columns, values):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in values), columns


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{sf}/{p}'")
    want = con.execute(f"select {', '.join(columns)} from ({q.ORACLE_SQL[name]})").fetchall()
    assert rows(columns, map(tuple, df.select(*columns).collect())) == rows(columns, want)


def test_nothing_else_imports_the_training_operators():
    for p in (ROOT / "mnemora").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry_without_training_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name == "corpus_pipeline" or "llm" in name.split("."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="corpus_pipeline" if name == "corpus_pipeline" else "mnemora.llm")
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("mnemora.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", blocked)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(q.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
