"""Reads: scope checks, deduplication, containment, header tokens, reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.session import cut

DUPLICATE_SHARE = 0.15  # from this share on, deduplication pays


class OutOfScope(ValueError):
    """The input breaks a rule that the engine relies on."""


def scope_report(reads: DataFrame, longest: int | None = None) -> DataFrame:
    """One row: counts by read length, base and quality, and a verdict.

    CANNOT READ: no reads, or a sequence and quality of different lengths.  OUT OF SCOPE: letters
    other than A, C, G, T, N, or a read above ``longest``.  CAVEAT: read lengths vary.
    """
    letters = F.regexp_replace("seq", "[ACGTN]", "")
    out = reads.agg(
        F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"),
        F.percentile(F.length("seq"), 0.5).alias("median_length"), F.sum(F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("n_n"),
        F.count_if(F.length("seq") != F.length("qual")).alias("n_mismatched"), F.count_if(F.length(letters) > 0).alias("n_foreign"),
    )
    verdict = F.when((F.col("n_reads") == 0) | (F.col("n_mismatched") > 0), "CANNOT READ").when((F.col("n_foreign") > 0) | (F.col("longest") > (longest or 1 << 30)), "OUT OF SCOPE")
    return out.withColumn("verdict", verdict.when(F.col("shortest") < F.col("longest"), "CAVEAT").otherwise("IN SCOPE"))


def scope_json(report: DataFrame) -> DataFrame:
    """(json): the report as one JSON object; the median as a whole number, rounded down."""
    return report.select(F.to_json(F.struct(*[F.col(c).cast("long").alias(c) if c == "median_length" else F.col(c) for c in report.columns])).alias("json"))


def require_in_scope(reads: DataFrame, longest: int | None = None) -> None:
    verdict = scope_report(reads, longest).first()
    if verdict.verdict in ("CANNOT READ", "OUT OF SCOPE"):
        raise OutOfScope(f"{verdict.verdict}: {verdict.asDict()}")


def deduplicate(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique reads, read map): N counts as A; a unique read is named by its smallest read_id.

    Names come from one partial aggregation by sequence, with no global order.
    """
    plain = reads.select("read_id", F.replace("seq", F.lit("N"), F.lit("A")).alias("seq"))
    unique = plain.groupBy("seq").agg(F.min("read_id").alias("uid")).select("uid", "seq", F.length("seq").alias("len"))
    return unique, plain.join(unique.select("uid", "seq").hint("merge"), "seq").select("read_id", "uid")


def duplicate_share(reads: DataFrame) -> DataFrame:
    """Duplicates among reads without N, over all reads, and whether deduplication pays."""
    clean = F.when(~F.contains("seq", F.lit("N")), F.col("seq"))
    out = reads.agg(F.count("*").alias("n_reads"), F.count(clean).alias("n_clean"), F.count_distinct(clean).alias("n_distinct"))
    share = F.when(F.col("n_reads") > 0, (F.col("n_clean") - F.col("n_distinct")) / F.col("n_reads"))
    return out.withColumn("share", F.round(share, 6)).withColumn("pays", share >= DUPLICATE_SHARE)


def contain_prefixes(unique: DataFrame) -> DataFrame:
    """(uid, into): reads that are a proper prefix of a longer one, with the smallest such in order of sequence.

    For each length that occurs, longer reads' prefixes meet the reads of that length in an
    equi-join; the lengths come from an aggregate (as many rows as there are lengths).  Reads are
    written out once, as all three ask for them.
    """
    unique = cut(unique)
    lengths = unique.select("len").distinct()
    longer = unique.select(F.col("uid").alias("into"), F.col("seq").alias("whole"), F.col("len").alias("whole_len"))
    prefixes = longer.join(F.broadcast(lengths), F.col("len") < F.col("whole_len")).select("into", "whole", F.expr("left(whole, len)").alias("seq"))
    return unique.join(prefixes.hint("merge"), "seq").groupBy("uid").agg(F.min_by("into", F.struct("whole", "into")).alias("into"))


def header_layout(reads: DataFrame) -> DataFrame:
    """(place, n_values, constant, is_length): each token column of the headers."""
    tokens = reads.select(F.posexplode(S.header_tokens(F.col("name"))).alias("place", "token"), F.length("seq").cast("string").alias("len"))
    return tokens.groupBy("place").agg(
        F.count_distinct("token").alias("n_values"), F.when(F.min("token") == F.max("token"), F.min("token")).alias("constant"), F.bool_and(F.col("token") == F.col("len")).alias("is_length")
    )


def line3_modes(reads: DataFrame) -> DataFrame:
    """How often the third line is a bare plus, repeats the header, or is something else."""
    mode = F.when(F.col("plus") == "+", 0).when(F.col("plus") == F.concat(F.lit("+"), F.substring("name", 2, 1 << 20)), 1).otherwise(2)
    return reads.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def reconstruct(read_map: DataFrame, placements: DataFrame, deviations: DataFrame, contigs: DataFrame, n_places: DataFrame) -> DataFrame:
    """(read_id, seq): each read from its place on a contig, its deviations and its N places.

    Deviations are in read space: a reverse read is complemented first.
    """
    per_read = deviations.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("off", "obs"))).alias("dev"))
    placed = placements.join(contigs.hint("merge"), "contig_id").join(per_read.hint("merge"), "uid", "left")
    body = F.expr("substring(seq, start + 1, end - start)")
    body = F.when(F.col("strand") == "-", S.reverse_complement(body)).otherwise(body)
    body = F.when(F.col("dev").isNull(), body).otherwise(S.with_letters(body, F.col("dev.off"), F.col("dev.obs")))
    whole = read_map.join(placed.select("uid", body.alias("body")).hint("merge"), "uid").join(n_places.hint("merge"), "read_id", "left")
    masked = S.with_letters(F.col("body"), F.col("n_offsets"), F.transform("n_offsets", lambda _: F.lit("N")))
    return whole.select("read_id", F.when(F.col("n_offsets").isNull(), F.col("body")).otherwise(masked).alias("seq"))


def best_by_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")
