"""The package stands without the training-data operators."""

import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tracewright")):
        if os.sep + "llm" in folder[len(ROOT) :]:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"tracewright(\.| import )llm|corpus_pipeline", f.read()), name


def test_entry_names():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert "E1_eval_accuracy" in queries and set(sql) <= set(queries)
