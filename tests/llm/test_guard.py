"""The rest of the library works without these operators, and only their absence is forgiven."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def reload_without(monkeypatch, name):
    for loaded in [m for m in sys.modules if m == name or m.startswith(f"{name}.")]:
        monkeypatch.delitem(sys.modules, loaded)
    monkeypatch.setitem(sys.modules, name, None)
    for dependent in ("corpus_pipeline", "flowsight.llm.queries"):
        if dependent != name and dependent in sys.modules:
            monkeypatch.delitem(sys.modules, dependent)
    return importlib.reload(entry)


@pytest.fixture(autouse=True)
def restored():
    yield
    importlib.reload(entry)


def test_entry_without_the_operators(monkeypatch):
    with monkeypatch.context() as m:
        alone = reload_without(m, "flowsight.llm")
        assert "decisions" in alone.queries()
        assert not any(name.startswith("op") or name == "pipeline" for name in alone.queries())


def test_another_missing_module_is_an_error(monkeypatch):
    with monkeypatch.context() as m, pytest.raises(ModuleNotFoundError):
        reload_without(m, "public_tokenizers")


def test_entry_with_the_operators():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
