"""Every registered query against its SQL, on the small tables."""

import math
import os

import duckdb
import pytest

from folioscan.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    declared = {c[0]: str(c[1]) for c in answer.description}
    for field in found.schema.fields:
        assert TYPES[field.dataType.simpleString()] == declared[field.name], field
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in row) for row in answer.fetchall()), key=repr)
    assert ours == theirs
