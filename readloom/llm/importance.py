"""Importance resampling towards a target distribution, by hashed n-grams of words.

Counts by segments: newlines cut a text into lines, and a line's words are its segment.  Equal
segments are counted first and their n-grams then counted once, multiplied by that; n-grams that
cross a newline are segments of their own with the one n-gram.  The counts of the raw corpus and of
the target give a gain for each of ``BUCKETS`` buckets, a table of fixed size that every task gets.
A second scan adds up the gains of each text, and the best of a Gumbel race by weight are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

BUCKETS = 10_000
LONGEST = 2
_IN_WORD = common.table_of(lambda b: b >= 0x80 or chr(b).isdigit() or chr(b).isalpha())
_BY_BYTES = 64  # words longer than that are finished one by one


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of spans, each going on from a checksum so far; a byte of all spans at a time, longest spans first."""
    order = np.argsort(start - end, kind="stable")
    size, at = (end - start)[order], start[order]
    state = ~crc[order].astype(np.uint32)
    many = len(size) - np.searchsorted(size[::-1], np.arange(1, min(int(size.max(initial=0)), _BY_BYTES) + 1), "left")  # spans that have a byte there
    for j, k in enumerate(many):
        state[:k] = CRC[(state[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    state = ~state
    for i in np.flatnonzero(size > _BY_BYTES):
        state[i] = zlib.crc32(data[at[i] + _BY_BYTES : at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def runs(data: np.ndarray, w: common.Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to ``longest``: the first words of all runs within a text, and the CRC-32 of the words joined by one space."""
    first = np.arange(len(w.start))
    crc = crc_on(np.zeros(len(first), np.uint32), data, w.start, w.end)
    yield first, crc
    for n in range(1, longest):
        some = np.flatnonzero(w.doc[np.minimum(first + n, len(w.doc) - 1)] == w.doc[first]) if len(first) else first
        some = some[first[some] + n < len(w.doc)]
        first, crc = first[some], crc[some]
        state = ~crc  # a space
        crc = ~(CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)))
        crc = crc_on(crc, data, w.start[first + n], w.end[first + n])
        yield first, crc


def _joined(data: np.ndarray, w: common.Words, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Of each stretch of words (the first, one past the last): the words joined by one space."""
    size = w.end - w.start
    many = end - begin
    word = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    last = np.zeros(len(word), bool)
    last[np.cumsum(many) - 1] = True
    wide = size[word] + ~last  # a space after all but the last word of a stretch
    upto = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(int(upto[-1]), 0x20, np.uint8)
    inner = np.repeat(upto[:-1] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
    source = np.repeat(w.start[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
    out[inner] = data[source]
    bounds = upto[np.concatenate([[0], np.cumsum(many)])].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def segments(df: DataFrame, text: str, longest: int) -> DataFrame:
    """(words, crossing, times): distinct segments of all texts; a crossing one is a run of words over a newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in common.slices(batch, "_text"):
                data = common.LOWER[raw]
                w = common.words(data, offsets, _IN_WORD)
                if not len(w.start):
                    continue
                line = np.cumsum(data == 0x0A)[w.start]
                breaks = np.flatnonzero((np.diff(line) != 0) | (np.diff(w.doc) != 0)) + 1
                begin = [np.concatenate([[0], breaks])]
                end = [np.concatenate([breaks, [len(w.start)]])]
                crossing = [np.zeros(len(begin[0]), bool)]
                for n in range(2, longest + 1):
                    at = np.arange(max(0, len(w.start) - n + 1))
                    at = at[(w.doc[at] == w.doc[at + n - 1]) & (line[at] != line[at + n - 1])]
                    begin.append(at)
                    end.append(at + n)
                    crossing.append(np.ones(len(at), bool))
                found = _joined(data, w, np.concatenate(begin), np.concatenate(end))
                yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), pa.array(np.concatenate(crossing))], ["words", "crossing"])

    found = df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "words binary, crossing boolean")
    return found.groupBy("words", "crossing").agg(F.count("*").alias("times"))


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; the driver gets a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            crossing, times = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            upto = 0
            for part, data, offsets in common.slices(batch.select(["words"]), "words"):
                w = common.words(data, offsets, _IN_WORD)
                alone, each = crossing[upto : upto + part.num_rows], times[upto : upto + part.num_rows]
                upto += part.num_rows
                whole = np.diff(w.first)
                for n, (first, crc) in enumerate(runs(data, w, longest), 1):
                    doc = w.doc[first]
                    some = ~alone[doc] | (whole[doc] == n)
                    np.add.at(total, crc[some] % buckets, each[doc[some]])
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in segments(df, text, longest).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in the target and in the raw corpus."""
    s, t, size = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + size) / ((int(x) + 1) * (t + size)))) for x, y in zip(raw, target, strict=True)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """The columns of ``df`` without ``text``, and n_words, n_features and weight, the floored mean gain of a text's n-grams (none: 0)."""
    own = ["n_words", "n_features", "weight"]
    others = [c for c in df.columns if c != text and c not in own]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in common.slices(batch, "_text"):
                data, n_texts = common.LOWER[raw], len(offsets) - 1
                w = common.words(data, offsets, _IN_WORD)
                many, total = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
                for first, crc in runs(data, w, longest):
                    many += np.bincount(w.doc[first], minlength=n_texts)
                    np.add.at(total, w.doc[first], gain[crc % len(gain)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first)), pa.array(many), pa.array(total // np.maximum(many, 1))], ["_row", *own])

    made = rows.mapInArrow(run, T.StructType([rows.schema["_row"], *[T.StructField(c, T.LongType()) for c in own]]))
    return made.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], *own)


def resample(
    df: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """The columns of ``df`` without ``text``, with n_words, n_features, weight, score and, for the rows drawn, rank.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features are the runs
    of 1 to ``longest`` words, with repeats, in the bucket of their CRC-32.  The score adds to the
    weight a Gumbel number from the SHA-256 of ``seed``:``doc_id``; of the rows of at least
    ``least_words`` words, ``percent`` of 100 of the highest scores are drawn (ties to the smaller doc_id,
    null first), so that a row's chance follows exp(weight / 1000).  The drawn sample is
    ``filter("rank IS NOT NULL")``, joined to the texts by doc_id.

    A null text has no words, weight 0; a null doc_id is an empty string in the hash; rows that repeat
    a doc_id are scored and drawn each for itself.  Empty tables count nothing: an empty ``df`` gives no
    rows, an empty ``target`` smoothed shares only.  Columns already called as the new ones are replaced.
    """
    gain = gains(bucket_counts(df, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    made = weigh(df.drop("score", "rank"), gain, text, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = common.cut(made.withColumn("score", F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log(uniform))).cast("long")))
    few = scored.filter(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    # one order over all rows; a row's rank is its partition's start and its place there
    race = scored.filter(F.col("n_words") >= least_words).withColumn("_readloom_at", F.monotonically_increasing_id())
    race = common.cut(race.orderBy(F.desc("score"), F.col(f"`{doc_id}`"), "_readloom_at").withColumn("_readloom_at", F.monotonically_increasing_id()))
    starts = common.partition_starts(race, "_readloom_at")
    drawn = int(starts[-1] + race.filter(F.shiftright("_readloom_at", 33) == len(starts) - 1).count()) * percent // 100
    rank = F.lit(starts.tolist())[F.shiftright("_readloom_at", 33).cast("int")].cast("long") + F.col("_readloom_at").bitwiseAND((1 << 33) - 1) + 1
    return race.withColumn("rank", F.when(rank <= drawn, rank)).drop("_readloom_at").unionByName(few)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    drawn = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by its table; a feature's bytes are read off the hexadecimal form of its UTF-8
OP11_SQL = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT true AS raw, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), text FROM benchmark
), worded AS (
  SELECT raw, doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT raw, r, unnest(w) AS f FROM worded
  UNION ALL
  SELECT raw, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
), counted AS (
  SELECT raw, r, f, count(*) AS n FROM features GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM hexed, crc
), buckets AS (
  SELECT bucket, sum(n) FILTER (raw) AS s, sum(n) FILTER (NOT raw) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM buckets
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS g FROM buckets, totals
), sums AS (
  SELECT r, sum(n * g) AS total, sum(n) AS n FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE raw GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
         (('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u
  FROM worded LEFT JOIN sums USING (r) WHERE raw
), raced AS (
  SELECT *, (weight + floor(-1000 * ln(-ln(u))))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS many FROM raced WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * many // 100 THEN k END::BIGINT AS rank FROM raced LEFT JOIN ranked USING (doc_id)
"""
