import ast
from pathlib import Path

import __spark_entry__ as entry
from tests.conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    for path in [*ROOT.glob("quernstone/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Import | ast.ImportFrom):
                assert "llm" not in (getattr(node, "module", "") or "") and all("llm" not in a.name for a in node.names), path


def test_p5_runs_over_the_small_tables(spark):
    got = entry.queries()["p5_found"](spark, SF)
    assert got.columns == ["board_id", "crawl_id", "posting_id", "change_kind"] and got.count() > 0
