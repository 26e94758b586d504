import re

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import registry


def test_every_operator_has_one_query():
    names = registry.queries()
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names)
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]
