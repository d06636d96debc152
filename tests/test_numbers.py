"""k-mers as numbers give what k-mers as text give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import kmers


@pytest.mark.parametrize("k", [1, 4, 5, 21, 31, 32])
def test_counts_equal_those_of_text(spark, k):
    draw = random.Random(k)
    texts = ["", "ACG", "A" * 40, "N" * 40, "ACGTRACGTTGACCATGACCATTGACGNACGTACGATCAGCATTT" * 2, "acgtACGTTGACCATGACCATTGACGACGTACGATCAGCATTT", "ACGTTGACCATGACCÄATTGACGACGTACGATCAGCATTTACGTTGACCATGACCATT", None]
    texts += ["".join(draw.choices("ACGTN", [9, 9, 9, 9, 1], k=draw.randrange(90))) for _ in range(50)]
    seqs = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    own = kmers.occurrences(seqs, k).groupBy("kmer").agg(F.count("*").alias("cnt"))
    found = kmers.count(seqs, k)
    assert "string" in dict(found.dtypes)["kmer"] and sorted(found.collect()) == sorted(own.collect())
    if k <= 31:
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    parts = [kmers._packed(np.frombuffer(b"ACGTTGCANACGT" * 9, "uint8"), np.array([0, 50, 117]), min(k, 31), chunk) for chunk in (3, 1 << 20)]
    totals = [{} for _ in parts]
    for total, made in zip(totals, parts):
        for codes, n, odd in made:
            assert not odd
            for c, m in zip(codes.tolist(), n.tolist()):
                total[c] = total.get(c, 0) + m
    assert totals[0] == totals[1]
