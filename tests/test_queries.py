"""Every query of the engine against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.plans import catalogue
from lectern.plans.domain import number

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal | datetime.datetime):
        return str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf_dir, sql, name):
    df = catalogue.queries()[name](spark, sf_dir)
    expected = sql.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_only(spark, sf_dir):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    catalogue.queries()["find_by_id"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rounding_is_the_sqls(spark, tmp_path):
    prices = [443750.75, 412487.25, 251592.75, 259293.25, 95179.25, -1e9, 1e305, float("nan"), None]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    expected = con.sql(catalogue.oracle_sql()["scaled_scores"] + " ORDER BY 1").fetchall()
    assert repr([tuple(r) for r in catalogue.queries()["scaled_scores"](spark, str(tmp_path)).orderBy("o_orderkey").collect()]) == repr(expected)
    values = [0.8875015, 0.5031855, -0.8875015, 5e-07, -5e-07, 1e305, -1e305, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(number(F.col("v"))).collect()]
    assert repr(got) == repr([con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values])
