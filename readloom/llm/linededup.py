"""Line deduplication across documents.

Lines are normalised and hashed in the scan (128 bits of BLAKE2b, written once); one partial
aggregation finds, for each hash, the smallest and the largest doc_id that holds it (they differ if two documents do), and each
document gets back the hashes that it has to lose.  Lines are put together again by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

_IN_LINE = common.table_of(lambda b: b != 0x0A)
_SOLID = common.table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_STARTS = common.table_of(lambda b: b & 0xC0 != 0x80)


def line_keys(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Document, line number in it and digest of the key of each line whose key has at least ``least`` code points."""
    runs = common.words(data, offsets, _IN_LINE)
    solid = np.flatnonzero(_SOLID[data])
    lo = np.searchsorted(solid, runs.start)
    hi = np.searchsorted(solid, runs.end)
    full = hi > lo
    start, end = solid[lo[full]], solid[hi[full] - 1] + 1
    doc, at = runs.doc[full], runs.start[full]
    points = np.concatenate([[0], np.cumsum(_STARTS[data])])
    long = points[end] - points[start] >= least
    start, end, doc, at = start[long], end[long], doc[long], at[long]
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, at) - np.searchsorted(breaks, offsets[doc])
    return doc, line, common.digests(common.LOWER[data], start, end)


def _hashed_lines(df: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                doc, _, keys = line_keys(data, offsets, least)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(keys, pa.binary())], ["doc_id", "key"])

    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("key", T.BinaryType())])
    return df.select("doc_id", "text").mapInArrow(run, schema)


def _kept(text: bytes, lines: np.ndarray) -> bytes:
    gone = set(lines.tolist())
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)


def drop_repeated_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10, digest: bool = False) -> DataFrame:
    """The rows of ``df`` with repeated lines taken out of ``text``, and n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.  A key of at
    least ``least`` code points that is in two documents or more loses all its lines but those
    of the smallest doc_id that holds it.  A null or empty text is one empty line.  Rows that
    repeat a doc_id count as one document; rows without a doc_id neither count nor lose lines.
    Other columns stay as they are, but for columns already called n_lines or n_dropped, which
    are replaced.  With ``digest`` the text is replaced by the SHA-256 of its bytes, in
    kept_sha256, and only doc_id is kept besides.
    """
    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = plain.filter(F.col("doc_id").isNotNull())
    lines = common.cut(_hashed_lines(known, least))
    repeated = lines.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).filter("keeper < other").select("key", "keeper")
    repeated = common.cut(repeated)  # a side of the join of its own, so that a hot line's rows can be split
    lost = lines.join(repeated, "key").filter("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("_lost"))
    lost = lost.withColumnRenamed("doc_id", "_lost_of")
    carried = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text and not digest or c == doc_id]).alias("_row")
    rows = df.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), carried)
    rows = rows.join(lost, F.col("_doc") == F.col("_lost_of"), "left").select("_row", "_text", "_lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "_text"):
                n = len(offsets) - 1
                newlines = np.concatenate([[0], np.cumsum(data == 0x0A)])
                n_lines = np.diff(newlines[offsets]) + 1
                lost = part.column(2)
                n_dropped = np.zeros(n, np.int64)
                body = [data[offsets[i] : offsets[i + 1]] for i in range(n)]
                for i in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)):
                    gone = set(lost[i].as_py())
                    _, line, keys = line_keys(body[i], np.array([0, len(body[i])]), least)
                    out = line[[k in gone for k in keys]]
                    n_dropped[i] = len(out)
                    body[i] = _kept(body[i].tobytes(), out)
                if digest:
                    kept = pa.array([hashlib.sha256(x).hexdigest() for x in body], pa.string())
                else:
                    kept = pa.array([x if isinstance(x, bytes) else x.tobytes() for x in body], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(n_lines), pa.array(n_dropped)], ["_row", "_kept", "n_lines", "n_dropped"])

    fields = [rows.schema["_row"], T.StructField("_kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = rows.mapInArrow(run, T.StructType(fields))
    if digest:
        return out.select(F.col(f"_row.`{doc_id}`").alias(doc_id), "n_lines", "n_dropped", F.col("_kept").alias("kept_sha256"))
    keep = [F.col("_kept").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*keep, "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(common.documents(spark, sf_dir), digest=True)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)
), keys AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.line, l.pos, (keeper IS NOT NULL AND l.doc_id <> keeper) AS gone FROM lines l LEFT JOIN keys USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
