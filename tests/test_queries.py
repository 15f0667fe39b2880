"""Every registered query against the same rows in DuckDB."""

from __future__ import annotations

import re

import pytest
from conftest import SF, rows_of

from ctxengine.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert rows_of(got) == rows_of(duck.sql(catalog.SQL[name]).df())
    else:
        assert len(got)


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_public_function_of_the_library_is_called(spark):
    """Each public function of operators, sources, functions and streaming runs in a query or in a stream test; a tag alone is not enough."""
    import importlib
    import inspect
    import sys

    modules = [importlib.import_module(f"ctxengine.{m}") for m in ("operators.pack", "operators.patch", "operators.recommend", "operators.search", "operators.selection", "operators.signals", "sources.connectors", "sources.tables", "functions.text", "functions.paths", "streaming.changes", "streaming.live", "sources.store")]
    wanted = {f.__code__: f"{m.__name__}.{n}" for m in modules for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_")}
    seen = set()

    def note(frame, event, arg):  # noqa: ANN001, ANN202
        if event == "call" and frame.f_code in wanted:
            seen.add(frame.f_code)

    sys.setprofile(note)
    try:
        for name in sorted(catalog.QUERIES):
            catalog.QUERIES[name](spark, SF)
    finally:
        sys.setprofile(None)
    # on tasks, over streams, or sinks of the caller's own place
    elsewhere = {"ctxengine.operators.patch.heal_text", "ctxengine.sources.connectors.write_patched", "ctxengine.operators.recommend.markdown", "ctxengine.streaming.live.due", "ctxengine.streaming.live.refresh", "ctxengine.streaming.live.current_snapshot", "ctxengine.sources.store.expire"}
    assert {n for c, n in wanted.items() if c not in seen} - elsewhere == set()


def test_every_operator_is_named():
    named = set(re.findall(r"\w+", " ".join(catalog.OPERATORS.values())))
    last = {"S": 21, "K": 14, "F": 20, "P": 43, "J": 21, "A": 16, "X": 22, "W": 8, "O": 13, "U": 15, "ST": 6}
    # no counterpart: the clipboard and editor, and a guard against a call within a call
    assert {f"{p}{i}" for p, n in last.items() for i in range(1, n + 1)} - named == {"K10", "ST6"}
