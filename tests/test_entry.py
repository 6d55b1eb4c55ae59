"""The entry's added queries: there with all they import, else left out with a warning."""

import importlib

import pytest

import __spark_entry__ as entry
from cohorta.plans import QUERIES, SQL


@pytest.mark.parametrize("missing", ["public_tokenizers", "cohorta.llm", "corpus_pipeline"])
def test_core_queries_stay_without_the_added_ones(monkeypatch, missing):
    def refuse(name, *rest):
        raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)

    monkeypatch.setattr(importlib, "import_module", refuse)
    with pytest.warns(UserWarning, match=missing):
        assert set(entry.queries()) == set(QUERIES)
    with pytest.warns(UserWarning):
        assert set(entry.oracle_sql()) == set(SQL)
