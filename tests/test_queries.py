"""Every named query against its SQL in DuckDB, and its plan's shape."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name == "benchmark_semi_overlap"  # the smallest tables share no line
    if name in ORACLE_SQL:
        told = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(told.columns)
        assert sorted_rows(df.columns, rows) == sorted_rows(told.columns, told.fetchall())


def test_leaderboard_however_rows_are_dealt_out(spark, tmp_path):
    """Customers of the same orders have the same sum, to the last bit, and go by their keys."""
    copies = spark.range(6).withColumnRenamed("id", "c")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").crossJoin(copies).withColumns({"o_orderkey": F.expr("o_orderkey + c * 1000000"), "o_custkey": F.expr("o_custkey + c * 1000000")}).drop("c")
    orders.repartition(16, F.xxhash64("o_orderkey", "o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE TABLE orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' ORDER BY o_orderkey")
    df = QUERIES["leaderboard"](spark, str(tmp_path))
    told = con.sql(ORACLE_SQL["leaderboard"])
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(told.columns, told.fetchall())


def test_queries_without_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"normalize_text", "topk_dedup_speaker_cap", "cluster_constrained", "cer_adjacent_turns", "loose_marks"}


def test_scans_are_pruned(spark, capsys):
    QUERIES["attested_sources"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<lang:string,source:string>" in plan
    QUERIES["hard_negatives"](spark, DATA).explain("formatted")
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,40.0)]" in capsys.readouterr().out
