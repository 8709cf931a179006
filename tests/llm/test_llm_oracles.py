import pytest

from folioscan.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert ours == sorted(answer.fetchall(), key=repr)
