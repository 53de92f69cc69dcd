"""Each query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list:
    show = lambda v: None if pd.isna(v) else f"{float(v):.6f}" if type(v).__name__ in ("float", "Decimal", "float64") else str(v)
    return sorted((tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_query(spark, db, name):
    got, expected = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and canonical(got) == canonical(expected)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(catalogue.SQL) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_balance_and_partitioning(spark):
    balance = catalogue.QUERIES["q_journal_balance"](spark, SF)
    assert balance.where("difference <> 0").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = catalogue.QUERIES["q_slabs"](spark, SF).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert canonical(one) == canonical(catalogue.QUERIES["q_slabs"](spark, SF).toPandas())
