"""Queries and their SQL state one rule: ties, and pairs with more than one difference."""

import duckdb
import pytest

import __spark_entry__
from readloom.operators import intervals


def made(c, folder, name, rows, columns):
    c.execute(f"create table {name} as select * from (values {rows}) t({columns})")
    c.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")


@pytest.mark.parametrize("name", ["bubble_extract", "sql_bubbles"])
def test_gaps_after_a_difference_without_one(spark, tmp_path, name):
    """These keys' deletions look like a substitution first, so the gap is told at a later difference, or twice."""
    c = duckdb.connect()
    made(c, tmp_path, "part", ", ".join(f"({k}::bigint, {s}::int)" for k in (79996, 279986, 379981, 1, 3, 6, 11, 16) for s in (1, 3)), "p_partkey, p_size")
    own = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    assert own and sorted(own) == sorted(c.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_equal_spans_begin_one_run(spark):
    spans = [("a", 10 * i, 10 * i + 5) for i in range(200)] * 30 + [("a", 3000, 3005), ("a", 3005, 3005), ("b", 7, 9)]
    found = intervals.union_of_spans(spark.createDataFrame(spans, "region string, start long, end long").repartition(7), width=64)
    assert sorted(map(tuple, found.collect())) == sorted([("a", 10 * i, 10 * i + 5) for i in range(200)] + [("a", 3000, 3005), ("b", 7, 9)])


def test_merged_spans_with_equal_reads(spark, tmp_path):
    """Many reads of one part lie at one place."""
    c = duckdb.connect()
    made(c, tmp_path, "part", "(1::bigint, 1::int), (2::bigint, 2::int)", "p_partkey, p_size")
    rows = ", ".join(f"({o * 64}::bigint, {n}::int, {p}::bigint, 1::bigint, 5.0::double)" for o in range(60) for n in (1, 4) for p in (1, 2))
    made(c, tmp_path, "lineitem", rows, "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity")
    own = [tuple(r) for r in __spark_entry__.queries()["merged_spans"](spark, str(tmp_path)).collect()]
    assert own and sorted(own) == sorted(c.execute(__spark_entry__.oracle_sql()["merged_spans"]).fetchall())
