"""Relational queries against their check SQL on rows that the test tables do not have."""

import random

import duckdb
import pytest


@pytest.mark.parametrize("files", [1, 4])
def test_conditional_aggregates_of_ties_halves_and_nulls(spark, tmp_path, files):
    """Lines that share order and line number, quantities with halves and nulls in every column give what the SQL gives."""
    import __spark_entry__ as entry
    from compare import check

    rng = random.Random(3)
    some = lambda value: None if rng.random() < 0.1 else value
    lines = [(some(rng.randint(-5, 20)), some(rng.randint(1, 50)), some(rng.randint(1, 8)), some(rng.randint(1, 14)), some(rng.choice([0.5, 1.5, 2.5, 3.4999, -0.5, 7.0])),
              some(rng.choice([0.1, 0.1000001, 0.0])), some(rng.choice("ARN")), some(rng.choice("OF")), some(f"2001-01-{rng.randint(1, 28):02d}")) for _ in range(600)]
    con = duckdb.connect()
    con.execute("SET threads = 1")  # several threads may meet the rows of a tie in any order
    con.execute("CREATE TABLE lines (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO lines VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", lines)
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k in range(files):  # later files are larger, so Spark reads them first
        first, last = len(lines) * k * k // files**2, len(lines) * (k + 1) ** 2 // files**2
        con.execute(f"COPY (SELECT * FROM lines WHERE rowid >= {first} AND rowid < {last} ORDER BY rowid) TO '{folder}/part-{k}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    name = "k01_conditional_aggregates"
    ok, text, _ = check(name, entry.queries()[name], entry.oracle_sql()[name], spark, str(tmp_path), con)
    assert ok, text
