from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["coin", "n", "avg_spread_bps", "avg_imbalance"]


def test_every_oracle_has_a_query():
    assert not e.oracle_sql().keys() - e.queries().keys()


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tidebook").rglob("*.py"):
        if "llm" not in p.parts:
            names = [n for node in ast.walk(ast.parse(p.read_text())) if isinstance(node, ast.Import | ast.ImportFrom) for n in [getattr(node, "module", None) or "", *[a.name for a in node.names]]]
            assert not any("llm" in n.split(".") for n in names), p


def test_ladder_scans_read_only_what_they_need(spark):
    plan = e.queries()["symbol_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
