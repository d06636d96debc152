"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near-duplicates stays,
benchmark passages are cut out, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import common, decontaminate, linededup, pieces, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity below 0.5, by a network fitted to the labels of these documents."""
    net = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, net, into="toxicity").filter("toxicity < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of a smaller id has; n_chars follows the text."""
    return linededup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints, the document of the smallest id (rows that repeat it all stay)."""
    groups = simhash.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(groups, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages of benchmark items; n_chars follows the text."""
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    text = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_pieces, ids): the text that the ids decode to."""
    coded = pieces.encode(docs.select("doc_id", F.col("text").alias("source_text")), text="source_text", decoded="text")
    return coded.select("doc_id", "text", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # the network's scores and the piece search aren't SQL; tests/llm compare stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
