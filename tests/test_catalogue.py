"""Every query of the catalogue that has an oracle, against DuckDB over the same tables; the entry contract."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from arcframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    if name not in catalogue.ORACLES:
        assert rows
        return
    sql = catalogue.ORACLES[name]
    assert sorted(oracle.sql(sql).columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(oracle.sql(f"SELECT {listed} FROM ({sql})").fetchall(), key=key)


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert entry.entry(spark).schema.names == ["path", "difference"]


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "arcframe")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert not re.search(r"(from|import) [\w.]*\bllm\b", source.read()), f
