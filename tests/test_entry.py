"""The driver contract, with and without the optional subpackage."""

import importlib
import sys


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    first, second = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert first.schema == second.schema
    assert first.count() >= 0


def test_sql_only_for_registered_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__

    for name in [x for x in sys.modules if x == "corpus_pipeline" or x.startswith("tallyforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    try:
        assert bare.queries() and not [x for x in bare.queries() if x.startswith("op") or x == "pipeline"]
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
