"""Edges of the k-mer graph found on one strand."""

import random

from pyspark.sql import functions as F
from test_minimizers import written_rows

from readloom.functions import sequence as S
from readloom.operators import kmers


def test_solid_edges(spark):
    draw = random.Random(9)
    for k, letters in ((4, "ACGT"), (5, "ACGT"), (5, "ACGTRY"), (2, "ACGT"), (21, "AC")):
        words = {"".join(draw.choices(letters, k=k)) for _ in range(150)} | {"ACGTACGTACGTACGTACGTA"[:k], "A" * k}
        counts = spark.createDataFrame([(w, draw.randrange(1, 9)) for w in sorted({min(w, w.translate(TURN)[::-1]) for w in words})], "kmer string, cnt long")
        want = kmers.successors(kmers.oriented(counts), k)
        assert sorted(map(tuple, kmers.solid_edges(numbered(counts), k).collect())) == sorted(map(tuple, want.collect()))


def test_ends_are_shuffled_as_numbers_on_one_strand(spark, monkeypatch):
    draw = random.Random(10)
    words = sorted({min(w, w.translate(TURN)[::-1]) for w in ("".join(draw.choices("ACGT", k=21)) for _ in range(500))})
    counts = spark.createDataFrame([(w, 2) for w in words], "kmer string, cnt long")
    assert written_rows(spark, kmers.solid_edges(numbered(counts), 21).collect) <= 2 * len(words) + 8  # four rows a k-mer by successors
    monkeypatch.setattr(kmers, "successors", None)  # the query doesn't go by text
    from readloom.plans import queries

    assert queries.graph_successors(spark, "/root/testdata/sf0.001").columns == ["node", "next", "cnt"]


def numbered(counts):
    plain = F.col("kmer").rlike("^[ACGT]+$")
    return counts.select(F.when(plain, S.packed(F.col("kmer"))).alias("code"), F.when(~plain, F.col("kmer")).alias("odd"), "cnt")


TURN = str.maketrans("ACGT", "TGCA")
