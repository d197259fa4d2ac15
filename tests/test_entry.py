import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows
from vlprep.plans.oracle import SQL
from vlprep.plans.queries import QUERIES

ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["batch_id", "n_rows", "max_len", "real_tokens", "pad_tokens"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())
    plain = {"bigint", "double", "string"}
    assert {f.dataType.simpleString() for f in df.schema.fields} <= (plain if name in QUERIES else plain | {"int", "boolean"})


def test_library_has_no_unbounded_collects():
    for path in (ROOT / "vlprep").rglob("*.py"):
        source = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|coalesce\(1\)", source), path
        for line in source.splitlines():
            if re.search(r"\.(collect|toPandas|toArrow)\(\)", line):
                assert ".limit(" in line or "# at most" in line, f"{path}: {line}"
