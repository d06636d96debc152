"""Functions for Spark SQL text: sequence functions as SQL expressions, and a table function for gaps of sequence pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readloom.operators import calling

# SQL expressions, so that Catalyst sees through them
EXPRESSIONS = {
    "revcomp(seq STRING) RETURNS STRING": "reverse(translate(seq, 'ACGT', 'TGCA'))",
    "canonical(seq STRING) RETURNS STRING": "least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))",
    "kmers(seq STRING, k INT) RETURNS ARRAY<STRING>": "CASE WHEN length(seq) >= k THEN transform(sequence(1, length(seq) - k + 1), i -> substring(seq, i, k)) ELSE array() END",
    "hamming(a STRING, b STRING) RETURNS INT": "size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d))",
    "packed(kmer STRING) RETURNS BIGINT": "cast(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS BIGINT)",
}


class ExtractBubbles:
    """Rows (pair_id, left, right) of a table argument to their gaps, batch by batch."""

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        for batch in calling.event_batches(table):
            yield pa.Table.from_batches([batch])


def register(spark: SparkSession) -> None:
    """revcomp, canonical, kmers, hamming, packed and extract_bubbles(TABLE(pair_id, left, right)) as temporary functions of the session."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("extract_bubbles", F.arrow_udtf(ExtractBubbles, returnType=calling.EVENTS))
