"""Nucleotide tables that Spark derives from the star-schema tables, with the same derivation in SQL.

One contig of 128 bases a part, a second haplotype with a substitution or a deletion, and one read
for each line of an order.  Expressions are shared text that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DNA = "translate(md5(cast({k} as varchar(20)) || '-{i}'), '0123456789abcdef', 'ACGTACGTACGTACGT')"
GENOME = " || ".join(_DNA.format(k="p_partkey", i=i) for i in range(4))
SITE = "p_size % 48 + 40"
SECOND = (
    "case when p_partkey % 3 = 0 then substr(seq, 1, site) || translate(substr(seq, site + 1, 1), 'ACGT', 'CGTA') || substr(seq, site + 2) "
    "when p_partkey % 5 = 1 then substr(seq, 1, site) || substr(seq, site + 3) else seq end"
)
READ = {
    "read_id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
    "contig_id": "l_partkey",
    "start": "(l_orderkey * 7 + l_linenumber * 13) % 64",
    "len": "50 + 10 * (l_linenumber % 2)",
    "strand": "case when l_orderkey % 2 = 1 then '-' else '+' end",
    "body": "substr(case when l_suppkey % 2 = 1 then second else seq end, cast((l_orderkey * 7 + l_linenumber * 13) % 64 as int) + 1, cast(50 + 10 * (l_linenumber % 2) as int))",
    "n_at": "case when l_orderkey % 50 = 0 then cast(l_linenumber * 5 as int) end",
    "q": "cast(l_quantity as int) % 20 + 20",
    "name": "'@SRR' || cast(l_suppkey as varchar(20)) || '.' || cast(l_orderkey as varchar(20)) || ' ' || cast(l_linenumber as varchar(20)) || '/1 length=' || cast(50 + 10 * (l_linenumber % 2) as varchar(20))",
}
TURNED = "case when strand = '-' then reverse(translate(body, 'ACGT', 'TGCA')) else body end"
MASKED = "case when n_at is null then turned else substr(turned, 1, n_at) || 'N' || substr(turned, n_at + 2) end"

GENOME_SQL = f"genome AS (SELECT contig_id, seq, site, {SECOND} AS second FROM (SELECT p_partkey AS contig_id, p_partkey, {GENOME} AS seq, {SITE} AS site FROM part))"
READS_SQL = (
    f"{GENOME_SQL}, drawn AS (SELECT {', '.join(f'{e} AS {n}' for n, e in READ.items())} FROM lineitem JOIN genome ON l_partkey = contig_id), "
    f"turned AS (SELECT *, {TURNED} AS turned FROM drawn), "
    f"reads AS (SELECT read_id, name, {MASKED} AS seq, turned, body, contig_id, start, len, strand, n_at, q FROM turned)"
)


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seq, site, second.

    A part is a few bytes in its file and hundreds of rows in what follows, so parts are dealt to all tasks that a
    shuffle has, by contig: a number by hand, as adaptive execution would go by the bytes and leave one or two.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(n, "p_partkey").select(F.col("p_partkey").alias("contig_id"), "p_partkey", F.expr(GENOME).alias("seq"), F.expr(SITE).alias("site"))
    return parts.withColumn("second", F.expr(SECOND)).drop("p_partkey")


def drawn_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, name, seq (as read), turned (seq before N), body (on the contig's strand), contig_id, start, len, strand, n_at, q."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.join(genome(spark, sf_dir).hint("merge"), F.col("l_partkey") == F.col("contig_id")).select(*[F.expr(e).alias(n) for n, e in READ.items()])
    rows = rows.withColumn("turned", F.expr(TURNED)).withColumn("seq", F.expr(MASKED))
    return rows.select("read_id", "name", "seq", "turned", "body", "contig_id", "start", "len", "strand", "n_at", "q")


def fastq(reads: DataFrame) -> DataFrame:
    """read_id, name, seq, plus, qual; a third of the third lines repeat the header."""
    plus = F.when(F.col("read_id") % 3 == 0, F.concat(F.lit("+"), F.substring("name", 2, 1 << 20))).otherwise("+")
    return reads.select("read_id", "name", "seq", plus.alias("plus"), F.expr("repeat(char(33 + q), cast(len as int))").alias("qual"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe_id, probe: 30 bases of each tenth contig, exact, with one difference, or with two."""
    return genome(spark, sf_dir).filter("contig_id % 10 = 0").select(F.col("contig_id").alias("probe_id"), F.expr(PROBE).alias("probe"))


PROBE_BODY = "substr(seq, cast(contig_id % 90 as int) + 1, 30)"
PROBE = (
    f"case when contig_id % 30 = 0 then {PROBE_BODY} "
    f"when contig_id % 30 = 10 then substr({PROBE_BODY}, 1, 7) || translate(substr({PROBE_BODY}, 8, 1), 'ACGT', 'CGTA') || substr({PROBE_BODY}, 9) "
    f"else reverse(translate({PROBE_BODY}, 'ACGT', 'TGCA')) end"
)
PROBES_SQL = f"probes AS (SELECT contig_id AS probe_id, {PROBE} AS probe FROM genome WHERE contig_id % 10 = 0)"
