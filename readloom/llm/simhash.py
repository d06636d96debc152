"""SimHash near-duplicates, linked through BK-trees of fingerprints.

Fingerprints: vectorised XXH64 of the word shingles of each whole text.  Two fingerprints within
``radius`` bits agree exactly on all but ``radius`` of any ``blocks`` blocks of their bits, so
each distinct fingerprint goes to one shard for each choice of the blocks that agree.  A shard
holds a BK-tree (children keyed by the Hamming distance to their parent) and every fingerprint
of the shard follows only edges within the radius.  Shards larger than ``shard_size`` are dealt
into chunks, and each pair of chunks makes a shard, so no link is lost and no task grows with a
hot shard.  What leaves a shard is one link a fingerprint, to the smallest one that the shard
connects it with.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common
from readloom.llm.components import components

BITS = 64
FRONTIER = 1 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_IS_WORD = common.table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LONG = 512


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, x):
    return _rotated(acc + x * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of the bytes; spans are taken in order of length so that each step works on a run of them."""
    if not len(start):
        return np.zeros(0, np.uint64)
    order = np.argsort(np.minimum(length, _LONG + 1).astype(np.uint16), kind="stable")
    n, at = length[order], start[order]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,)).copy()
    four = eight & np.uint64(0xFFFFFFFF)
    short = int(np.searchsorted(n, _LONG, "right"))
    n, at = n[:short], at[:short]
    done = np.zeros(short, np.int64)
    h = np.full(short, (seed + int(_P5)) % (1 << 64), np.uint64)
    if (big := int(np.searchsorted(n, 32))) < short:
        lanes = [np.full(short - big, x % (1 << 64), np.uint64) for x in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
        stripe = 0
        while (lo := int(np.searchsorted(n, 32 * (stripe + 1)))) < short:
            base = at[lo:] + 32 * stripe
            for k in range(4):
                lanes[k][lo - big :] = _lane(lanes[k][lo - big :], eight[base + 8 * k])
            stripe += 1
        v = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
        for lane in lanes:
            v = (v ^ _lane(np.zeros_like(lane), lane)) * _P1 + _P4
        h[big:] = v
        done[big:] = n[big:] // 32 * 32
    h += n.astype(np.uint64)
    left = n - done
    at = at + done
    for k in range(3):
        if len(go := np.flatnonzero(left >= 8 * (k + 1))):
            h[go] = _rotated(h[go] ^ _lane(np.zeros(len(go), np.uint64), eight[at[go] + 8 * k]), 27) * _P1 + _P4
    at, left = at + left // 8 * 8, left % 8
    if len(go := np.flatnonzero(left >= 4)):
        h[go] = _rotated(h[go] ^ (four[at[go]] * _P1), 23) * _P2 + _P3
    at, left = at + left // 4 * 4, left % 4
    for k in range(3):
        if len(go := np.flatnonzero(left > k)):
            h[go] = _rotated(h[go] ^ ((eight[at[go] + k] & np.uint64(0xFF)) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    out = np.empty(len(order), np.uint64)
    out[order[:short]] = h
    for i in order[short:]:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed=seed)
    return out


def shingle_spans(found: common.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first and last word of each shingle, and the number of shingles of each document.

    A document of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    counts = np.diff(found.first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(per)])
    first = np.arange(begin[-1]) + np.repeat(found.first[:-1] - begin[:-1], per)
    last = np.minimum(first + size - 1, np.repeat(found.first[1:] - 1, per))
    return first, last, per


def joined_words(data: np.ndarray, found: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and each word's new start and end."""
    size = found.end - found.start
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(size) else np.zeros(0, np.int64)
    take = np.arange(int((size + 1).sum())) + np.repeat(found.start - start, size + 1)
    out = common.LOWER[data[np.minimum(take, len(data) - 1)]] if len(take) else np.zeros(0, np.uint8)
    end = start + size
    out[end] = 0x20
    return out, start, end


def simhashes(data: np.ndarray, offsets: np.ndarray, size: int = 4, seed: int = 42) -> np.ndarray:
    """The unsigned fingerprint of each document of a slice."""
    n = len(offsets) - 1
    found = common.words(data, offsets, _IS_WORD)
    first, last, per = shingle_spans(found, size)
    out = np.zeros(n, np.uint64)
    if not len(first):
        return out
    text, start, end = joined_words(data, found)
    hashes = xxh64(text, start[first], end[last] - start[first], seed)
    filled = np.flatnonzero(per)
    ones = np.zeros((len(filled), BITS), np.int64)
    step = 1 << 14  # documents' runs of shingles are counted in parts, so that bits unpacked at once are bounded
    which = np.repeat(np.arange(len(filled)), per[filled])
    for lo in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[lo : lo + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        docs = which[lo : lo + step]
        edge = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        ones[docs[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    major = (2 * ones > per[filled][:, None]).astype(np.uint8)
    out[filled] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


class BKForest:
    """BK-trees of several groups of distinct fingerprints, built and searched level by level for all of them at once."""

    def __init__(self, values: np.ndarray, group_start: np.ndarray):
        self.values = values
        n = len(values)
        self.root = np.repeat(group_start, np.diff(np.append(group_start, n)))
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        keys, kids = [], []
        while len(waiting):
            key = at * (BITS + 1) + np.bitwise_count(values[waiting] ^ values[at])
            own, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(own)
            kids.append(waiting[first])
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            at, waiting = waiting[first][which][rest], waiting[rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of a group within the radius, in parts of bounded size."""
        every = np.arange(len(self.values))
        todo = [(every[lo : lo + FRONTIER], self.root[lo : lo + FRONTIER]) for lo in range(0, len(every), FRONTIER)]
        while todo:
            query, node = todo.pop()
            far = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(far - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(far + radius, BITS), "right")
            many = hi - lo
            ends = np.cumsum(many)
            at = 0
            while at < len(query):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + FRONTIER, "right")))
                part = slice(at, to)
                size = int(ends[to - 1] - base)
                if size:
                    edge = np.arange(size) + np.repeat(lo[part] - (ends[part] - many[part] - base), many[part])
                    todo.append((np.repeat(query[part], many[part]), self.kids[edge]))
                at = to


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index of the set) after joining the sets of each pair."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def shard_links(group: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group and value: each value that a group connects with a smaller one, with the smallest."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    label = np.arange(len(value))
    for a, b in BKForest(value, start).links(radius):
        label = _united(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(value)))
    return value[moved], value[label[moved]]


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row a document; fp is the fingerprint's bits as a long."""
    kind = df.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(simhashes(data, offsets, size, seed).view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def block_choices(n: int, radius: int, target: int = 2000) -> tuple[list[tuple[int, int]], int]:
    """Bit ranges and how many of them a shard's members share: enough bits that an even spread leaves ``target`` values a shard."""
    for blocks in range(radius + 1, radius + 5):
        share = blocks - radius
        if n / 2 ** (BITS * share // blocks) <= target or blocks == radius + 4:
            edges = [BITS * k // blocks for k in range(blocks + 1)]
            return list(zip(edges, edges[1:], strict=False)), share
    raise AssertionError


def fingerprint_links(distinct: DataFrame, n: int, radius: int = 4, shard_size: int = 20_000) -> DataFrame:
    """(a, b) links that connect all of the distinct fingerprints ``fp`` within the radius of one another."""
    ranges, share = block_choices(n, radius)
    masks = []
    for chosen in combinations(ranges, share):
        mask = 0
        for lo, hi in chosen:
            mask |= ((1 << (hi - lo)) - 1) << lo
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    shard = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)]))
    rows = distinct.select("fp", shard.alias("shard"))
    large = rows.groupBy("shard").count().filter(F.col("count") > shard_size).select("shard", F.ceil(F.col("count") / (shard_size // 2)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("shard", F.least(x, own), F.greatest(x, own)))
    dealt = rows.join(large, "shard", "left").select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("shard")).otherwise(pairs)).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_group, kept_value = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(group, value):
            order = np.lexsort((value, group))
            a, b = shard_links(group[order], value[order], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            group = np.concatenate([kept_group, batch.column(0).to_numpy(zero_copy_only=False)])
            value = np.concatenate([kept_value, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
            if whole:
                yield out(group[:whole], value[:whole])
            kept_group, kept_value = group[whole:], value[whole:]
        if len(kept_group):
            yield out(kept_group, kept_value)

    dealt = dealt.select("shard", "fp").repartition(common.partitions(distinct.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row a row of ``df``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach.  A null or
    empty text has fingerprint zero and links like any other.  Rows that repeat a doc_id each get
    a row; a null doc_id is never a component's name unless the component has no other.  Other
    columns of ``df`` are not read.  An empty table gives an empty one.
    """
    prints = common.cut(fingerprints(df, text, doc_id, size, seed))
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    roots = components(fingerprint_links(distinct, n, radius))
    named = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
