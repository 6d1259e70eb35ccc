"""Every query with a SQL statement must equal DuckDB's answer (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from churnkit.sources.tables import TABLES
from helpers import rows_of_duckdb, rows_of_spark

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    scols, srows = rows_of_spark(E.queries()[name](spark, sf_dir))
    ocols, orows = rows_of_duckdb(con.sql(ORACLES[name]))
    assert scols == ocols
    assert len(srows) == len(orows)
    assert srows == orows


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["Contract", "TotalCustomers", "AvgMonthlyCharges"]


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "SMALLINT": "smallint", "TINYINT": "tinyint", "FLOAT": "float", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_types_match_sql(spark, sf_dir, con, name):
    spark_types = dict(E.queries()[name](spark, sf_dir).dtypes)
    rel = con.sql(ORACLES[name])
    sql_types = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == sql_types
