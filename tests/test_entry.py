import ast
import importlib
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_names_agree():
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60 and {"p2_found", "p5_found"} <= set(queries)


def test_core_works_without_the_llm_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "lodestrata.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p2_found" in entry.queries() and "p7_ids" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_core_does_not_import_the_llm_package():
    for path in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "lodestrata").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("lodestrata.llm") for n in names), path
