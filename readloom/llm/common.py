"""Byte-level helpers shared by the text operators.

Inside a Spark task the operators see Arrow batches.  A batch is cut into slices of a bounded
number of bytes, a slice is one flat ``uint8`` array plus document offsets, and words, lines and
rolling hashes are found on that array without a Python loop over words.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
DIGEST = 16
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[str, np.ndarray] = {}


def carried(df: DataFrame, text: str, but: list[str]) -> DataFrame:
    """``df`` in one struct column, row, without the columns that are to be replaced; a text among those is kept beside it."""
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("row")
    return df.select(kept, F.col(text).alias("_text")) if text in but else df.select(kept)


def byte_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column, or that field of the struct ``row`` (so that a text crosses to Python once), as large binary; nulls become empty."""
    if batch.schema.names == ["row"]:
        column = batch.column(0).field(batch.schema.field(0).type.get_field_index(name))
    else:
        column = batch.column(batch.schema.get_field_index("_text" if batch.schema.names == ["row", "_text"] else name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (one more than documents) of a large binary column."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])), ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive parts of a batch of about ``limit`` bytes of text, a longer document alone."""
    column = byte_column(batch, text)
    _, ends = flat(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, len(column))
        data, offsets = flat(column.slice(at, to - at))
        yield batch.slice(at, to - at), data, offsets
        at = to


@dataclass
class Words:
    """Half-open byte spans of the words of a slice, in order, with the document of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each document's first word; one more than documents


def table_of(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; runs never cross documents."""
    n_docs = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(n_docs + 1, np.int64))
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    after[filled[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets, "left")
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(start, end, doc, first)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling multiplier and of its inverse modulo 2**64, n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            out = np.ones(1, np.uint64)
            while len(out) < size:  # p[i + k] = p[i] * base**k
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


BYTE_CODES = _byte_codes()


class Rolling:
    """Hashes of arbitrary byte spans of a slice from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def mixed_in(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """A hash of the pair."""
    return mixed(x * np.uint64(_MULTIPLIER) + (y.astype(np.uint64) if isinstance(y, np.ndarray) else np.uint64(y)))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, *more: np.ndarray | int) -> list[bytes]:
    """128 bits of BLAKE2b of each span, salted with up to two numbers: where equality of bytes decides, rolling hashes don't do."""
    view, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    spans = zip(start.tolist(), end.tolist(), strict=True)
    if not more:
        return [hashed(view[a:b], digest_size=DIGEST).digest() for a, b in spans]
    salt = np.stack([np.broadcast_to(np.asarray(x, np.int64), start.shape) for x in more], 1).tobytes()
    wide = 8 * len(more)
    return [hashed(view[a:b], digest_size=DIGEST, salt=salt[wide * i : wide * (i + 1)]).digest() for i, (a, b) in enumerate(spans)]


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Whether each span of one array holds the bytes of the span of another."""
    size = end - start
    out = size == finish - begin
    some = np.flatnonzero(out & (size > 0))
    if len(some):
        many = size[some]
        first = np.cumsum(many) - many
        step = np.arange(int(many.sum())) - np.repeat(first, many)
        equal = data[np.repeat(start[some], many) + step] == other[np.repeat(begin[some], many) + step]
        out[some] = np.logical_and.reduceat(equal, first)
    return out


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of this machine only where nothing else takes part, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join("/tmp", f"readloom-{context.applicationId}"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder, to go when the application ends, and read that."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sample(rows: DataFrame, order: list, most_rows: int, most_bytes: int) -> pa.Table:
    """The first rows (_id, text, ...) by ``order``, as Arrow: at most that many, and texts of at most that many bytes in all.

    Sizes are looked at first, so that what comes to the driver is bounded whatever the length of a text: a row that
    would go over the bytes is passed over, and no row is left out while there is room.  Null texts count as empty.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_hash", F.xxhash64(*rows.columns))
    sizes = rows.groupBy("_id", "_hash", F.octet_length("text").alias("n")).count().orderBy(*order, "_hash").limit(most_rows).collect()
    room, left, taken, times = most_bytes, most_rows, [], []
    for r in sizes:
        copies = min(r["count"], left, room // r.n if r.n else left)
        if copies:
            room, left = room - copies * r.n, left - copies
            taken.append((r["_id"], r["_hash"], len(taken)))
            times.append(copies)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _hash long, _place int"
    few = rows.join(F.broadcast(rows.sparkSession.createDataFrame(taken, schema)), ["_id", "_hash"]).dropDuplicates(["_place"])  # broadcast: at most ``most_rows`` ids
    found = few.select(*[c for c in rows.columns if c != "_hash"], "_place").toArrow().sort_by("_place")
    return found.take(pa.array(np.repeat(np.arange(len(times)), times)))


def partition_starts(df: DataFrame, at: str) -> np.ndarray:
    """Rows before each partition, by its number, where ``at`` is monotonically_increasing_id of a written table: one row a partition comes here."""
    sizes = df.groupBy(F.shiftright(at, 33).alias("p")).count().collect()
    out = np.zeros(max((r.p for r in sizes), default=0) + 2, np.int64)
    for r in sizes:
        out[r.p + 1] = r["count"]
    return np.cumsum(out)[:-1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n))
