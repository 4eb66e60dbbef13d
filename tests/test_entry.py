import importlib
import importlib.util
import sys

import __spark_entry__


def test_queries_and_oracles_match_by_name():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 90


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:3] == ["doc_id", "word", "n"]


def test_without_the_training_data_package(monkeypatch):
    """Neither the package's absence nor that of what it imports takes the other queries along."""
    for missing in ("fabula.llm", "tiktoken"):
        with monkeypatch.context() as m:
            for loaded in [k for k in sys.modules if k.startswith("fabula.llm") or k == "corpus_pipeline"]:
                m.delitem(sys.modules, loaded)
            m.setitem(sys.modules, missing, None)
            names = importlib.reload(sys.modules["__spark_entry__"]).queries()
            assert "lexical_repetition" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    names = importlib.reload(sys.modules["__spark_entry__"]).queries()
    assert ("op1_decontaminate" in names) == (importlib.util.find_spec("fabula.llm") is not None)
