"""Joins whose sides grow with the input don't go through the driver."""

import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"
PLAIN = ["anchor_pairs_capped", "query_fasta", "read_coherence", "read_reconstruct", "site_tally", "seed_map_best", "except_leftovers", "leftover_fraction", "place_or_content", "hamming_filter", "read_map", "xsnv_pairs", "junction_min_support", "read_gap_votes", "linked_gap_votes", "mismatch_histogram"]


@pytest.mark.parametrize("name", PLAIN)
def test_nothing_is_broadcast(spark, name):
    plan = __spark_entry__.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_contigs_are_dealt_to_all_tasks_of_a_shuffle(spark):
    # by bytes, the file of parts is one task's: all that is derived from it would be too
    from readloom.plans import fixtures

    rows = fixtures.genome(spark, TABLES)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
