"""Columns of a pile in one sweep: the same as of the pile itself, which is never made."""

import random

from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import calling

import __spark_entry__

SCHEMA = "read_id long, contig_id long, start long, seq string, quals array<int>"


def _drawn():
    drawn, rows = random.Random(7), []
    for i in range(30000):
        n = drawn.choice((1, 30, 55))
        seq = "".join(drawn.choice("ACGTNé" if i % 9 == 0 else "ACGT") for _ in range(n))
        # a deep contig, small ones, and places around the border of two chunks
        contig, start = (0, drawn.randrange(40)) if i % 3 else (drawn.randrange(1, 400), drawn.randrange(65500, 65560))
        rows.append((i, contig, start, seq, [drawn.choice((2, 30, 40, None)) for _ in range(max(0, n - i % 4))]))
    return [*rows, (-1, 5, 10, "", []), (-2, 6, 10, "A", None)]


def test_counts_and_medians_are_those_of_the_pile(spark):
    placed = spark.createDataFrame(_drawn(), SCHEMA).repartition(5)
    piled = calling.pileup(placed).filter("q is not null").cache()
    assert sorted(calling.column_counts(placed.filter("quals is not null")).collect()) == sorted(calling.base_counts(piled).collect())
    plain = piled.groupBy("contig_id", "pos").agg(S.upper_median(F.collect_list("q")).alias("upper_median"))
    assert sorted(calling.column_medians(placed).collect()) == sorted(plain.collect())


def test_contigs_can_have_names(spark):
    rows = spark.createDataFrame([("b", 3, "AC"), ("a", 3, "AC"), ("a", 4, "GT")], "contig_id string, start int, seq string")
    assert sorted(calling.column_counts(rows).select("contig_id", "pos", "depth").collect()) == [("a", 3, 1), ("a", 4, 2), ("a", 5, 1), ("b", 3, 1), ("b", 4, 1)]


def test_no_table_of_the_pile(spark):
    for name in ("pileup_counts", "upper_median"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "MapInArrow" in plan
