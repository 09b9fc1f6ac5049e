import os

import pytest

from lanewise.llm.queries import ORACLES, QUERIES
from tests.test_entry import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    same(spark, small, name, QUERIES, ORACLES)


def test_pipeline(spark, small):
    import corpus_pipeline as p
    from lanewise.llm.common import stage, table

    docs = table(spark, small, "documents")
    assert 4 <= len(p.STAGES) <= 5
    before = docs.count()
    for name, step in p.STAGES[:-1]:
        docs = stage(step(spark, docs, small), name)
        assert docs.columns == p.COLUMNS and 0 < docs.count() <= before
        before = docs.count()
    assert p.encode(spark, docs, small).count() == before


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for d, _, names in os.walk(os.path.join(root, "lanewise")):
        if os.sep + "llm" not in d:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(d, n), encoding="utf-8").read()
