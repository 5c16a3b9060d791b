import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lodestream import registry
from lodestream.plans.compare import CHECKED, compare, duck

ROOT = Path(entry.__file__).parent / "lodestream"
QUERIES = {k: f for m in registry.modules() for k, f in m.queries().items()}
SQL = {k: s for m in registry.modules() for k, s in m.oracle_sql().items()}
#: Trained or iterated many times: run by their own tests and by compare.py.
SLOW = {"model_predictions", "feature_importance", "personalised_pagerank"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, con, sf, name):
    r = compare(spark, con, QUERIES[name], SQL.get(name), sf, CHECKED.get(name), need_rows=False)
    assert r["ok"], r["why"]


def test_nothing_outside_imports_llm():
    for p in ROOT.rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lodestream.llm") for n in names), p
