import importlib
import sys

import __spark_entry__ as entry


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert "event_id" in rows.columns
    rows.collect()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("driftwood.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "driftwood.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    alone = importlib.import_module("__spark_entry__")
    assert alone.llm is None and "search_page" in alone.queries() and "pipeline" not in alone.queries()
