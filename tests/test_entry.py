import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["prefix", "n", "first_page"] and df.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(monkeypatch):
    """Without the folder and the pipeline file the module imports and the other queries are there."""

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("brindle.llm"):
                raise ModuleNotFoundError(name, name=name)

    gone = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("brindle.llm")}
    finder = Missing()
    sys.meta_path.insert(0, finder)
    brindle = sys.modules["brindle"]
    had = brindle.__dict__.pop("llm", None)
    try:
        bare = importlib.reload(entry)
        names = bare.queries()
        assert "prefix_cluster" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    finally:
        sys.meta_path.remove(finder)
        sys.modules.update(gone)
        if had is not None:
            brindle.llm = had
        importlib.reload(entry)
