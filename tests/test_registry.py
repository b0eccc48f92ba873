import os

import __spark_entry__ as entry_module


def test_oracle_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark, data):
    assert entry_module.entry(spark).limit(5).count() == 5


def test_nothing_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for folder, _, files in os.walk(os.path.join(root, "scriptorium")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                assert "scriptorium.llm" not in open(os.path.join(folder, name)).read()


def test_exports_are_there():
    import scriptorium

    assert all(getattr(scriptorium, name) is not None for name in scriptorium.__all__)


def test_no_misspelling_is_listed():
    from scriptorium.functions.lexicon import METRIC_ALIASES

    said = {s for group in METRIC_ALIASES.values() for s in group}
    assert not said & {"exat match", "recal@20", "recal@100", "precison@5", "acuracy", "faithfullness", "trainig time", "thruput"}
