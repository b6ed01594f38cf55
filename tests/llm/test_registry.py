import re

import __spark_entry__ as entry
import corpus_pipeline
from crawlfold.llm import registry


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert all(callable(f) for f in registry.QUERIES.values())
    assert all(isinstance(v, str) and k in registry.QUERIES for k, v in registry.ORACLE_SQL.items())
    assert len(corpus_pipeline.STAGES) == 5
