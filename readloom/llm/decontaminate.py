"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents of some 4 MB.  Words are found and hashed on the bytes, and a word is one of
the benchmark's if its bytes are the same; words and word pairs that no benchmark window has end a segment, since no occurrence can hold them, and segments
shorter than the shortest window are left out.  What is left is indexed: suffix array of the
segments, Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position.  All
windows are searched backwards together through the ranks, occurrences are located by walking to
a sampled position, and their word spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

_IS_WORD = common.table_of(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
BLOCK_BYTES = 4 << 20
SAMPLE = 8
SHARD_SLICES = 16


@dataclass
class Vocabulary:
    """Distinct words by hash; a word's symbol is its place plus one."""

    hashes: np.ndarray
    data: np.ndarray  # the words' bytes, lower-cased, end to end
    ends: np.ndarray  # one more than words
    most: int  # words that share a hash

    def symbols(self, data: np.ndarray, found: common.Words) -> np.ndarray:
        """The symbol of each word of a slice, 0 for words that aren't here: bytes decide, hashes only point to candidates."""
        out = np.zeros(len(found.start), np.int64)
        if not len(self.hashes) or not len(out):
            return out
        data = common.LOWER[data]
        hashes = common.Rolling(data).of(found.start, found.end)
        place = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):
            at = np.minimum(place + k, len(self.hashes) - 1)
            some = np.flatnonzero((self.hashes[at] == hashes) & (out == 0))
            at = at[some]
            equal = common.same_bytes(data, found.start[some], found.end[some], self.data, self.ends[at], self.ends[at + 1])
            out[some[equal]] = at[equal] + 1
        return out


def vocabulary_of(data: np.ndarray, found: common.Words) -> Vocabulary:
    body = common.LOWER[data].tobytes()
    texts = pa.array(sorted({body[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)}), pa.large_binary())
    flat, ends = common.flat(texts)
    hashes = common.Rolling(flat).of(ends[:-1], ends[1:])
    order = np.argsort(hashes, kind="stable")
    _, many = np.unique(hashes, return_counts=True)
    flat, ends = common.flat(texts.take(pa.array(order)))
    return Vocabulary(hashes[order], flat.copy(), ends.copy(), int(many.max(initial=0)))


@dataclass
class Windows:
    """The distinct windows of a block of benchmark items."""

    vocabulary: Vocabulary
    pairs: np.ndarray  # sorted codes of neighbouring symbols within windows
    symbols: np.ndarray  # windows x longest, right-aligned, zero before the first word
    length: np.ndarray
    item_first: np.ndarray  # items of window w: names[items[item_first[w]:item_first[w + 1]]]
    items: np.ndarray
    names: np.ndarray
    alone: np.ndarray  # symbols that are windows of one word


def windows_of(rows: list[tuple[str | None, str | None]], size: int) -> Windows:
    data, offsets = common.flat(pa.array([(t or "").encode() for _, t in rows], pa.large_binary()))
    found = common.words(data, offsets, _IS_WORD)
    vocabulary = vocabulary_of(data, found)
    symbols, counts = vocabulary.symbols(data, found), np.diff(found.first)
    many = np.where(counts > 0, np.maximum(counts - size, 0) + 1, 0)
    item = np.repeat(np.arange(len(rows)), many)
    length = np.minimum(size, counts[item])
    last = found.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + length - 1
    wide = np.zeros((len(item), size), np.int32)
    for k in range(size):
        some = np.flatnonzero(k < length)
        wide[some, size - 1 - k] = symbols[last[some] - k]
    wide, which = np.unique(wide, axis=0, return_inverse=True)
    wide, which = wide.astype(np.int64), which.ravel()
    length = (wide > 0).sum(1)
    names, place = np.array(sorted({x for x, _ in rows if x is not None}), object), {}
    place = {x: k for k, x in enumerate(names)}
    own = np.array([place.get(x, -1) for x, _ in rows], np.int64)[item]
    listed = np.unique(which[own >= 0] * max(1, len(names)) + own[own >= 0])
    first = np.searchsorted(listed // max(1, len(names)), np.arange(len(wide) + 1))
    pairs = np.unique((wide[:, :-1] * (len(vocabulary.hashes) + 1) + wide[:, 1:])[wide[:, :-1] > 0])
    return Windows(vocabulary, pairs, wide, length, first, listed % max(1, len(names)), names, np.unique(wide[length == 1, -1]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; zeros end segments, each smaller than all symbols and than later zeros."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + int(zeros.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + int(text.max(initial=0)) + 2) + np.where(zeros, 0, after)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if n else 0
        rank = new
        if n == 0 or int(rank.max()) == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, one bit of the symbol a level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            zeros = len(sequence) - int(before[-1])
            self.levels.append((bit, before, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is in the first ``end`` places."""
        low, high = np.zeros(len(symbol), np.int64), end.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low


class FMIndex:
    """Backward search and location in segments that zeros end."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        order = suffix_array(text)
        self.transform = text[order - 1]  # before the first symbol comes the last zero
        counts = np.bincount(text, minlength=alphabet + 1)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = WaveletMatrix(self.transform, max(1, int(alphabet).bit_length()))
        begins = np.concatenate([[True], text[:-1] == 0]) if n else np.zeros(0, bool)
        kept = (order % SAMPLE == 0) | begins[order]
        self.sampled = kept
        self.sample_at = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of each right-aligned pattern."""
        low = np.zeros(len(symbols), np.int64)
        high = np.full(len(symbols), len(self.transform), np.int64)
        for k in range(symbols.shape[1]):
            go = np.flatnonzero((length > k) & (low < high))
            c = symbols[go, symbols.shape[1] - 1 - k]
            low[go], high[go] = self.below[c] + self.ranks.rank(c, low[go]), self.below[c] + self.ranks.rank(c, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes; segment starts are sampled, so that no walk passes a zero."""
        at = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        go = np.flatnonzero(~self.sampled[at])
        while len(go):
            c = self.transform[at[go]]
            at[go] = self.below[c] + self.ranks.rank(c, at[go])
            steps[go] += 1
            go = go[~self.sampled[at[go]]]
        return self.samples[self.sample_at[at]] + steps


def occurrences(shard: list[tuple[np.ndarray, np.ndarray]], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, slice of the shard, word of the slice) of each occurrence; the shard is its slices' word symbols and documents."""
    none = np.zeros(0, np.int64)
    if not len(windows.length):
        return none, none, none
    texts, where, what = [], [], []
    shortest = int(windows.length.min())
    for number, (symbol, doc) in enumerate(shard):
        if not len(symbol):
            continue
        pair = symbol[:-1] * (len(windows.vocabulary.hashes) + 1) + symbol[1:]
        tied = (symbol[:-1] > 0) & (symbol[1:] > 0) & (doc[:-1] == doc[1:])
        near = np.flatnonzero(tied)
        if len(windows.pairs):
            at = np.minimum(np.searchsorted(windows.pairs, pair[near]), len(windows.pairs) - 1)
            tied[near] = windows.pairs[at] == pair[near]
        else:
            tied[:] = False
        begin = np.flatnonzero(np.concatenate([[True], ~tied]))
        many = np.diff(np.append(begin, len(symbol)))
        good = np.where(many == 1, np.isin(symbol[begin], windows.alone), many >= shortest)
        begin, many = begin[good], many[good]
        if not len(begin):
            continue
        ends = np.cumsum(many + 1)
        take = np.arange(ends[-1]) + np.repeat(begin - (ends - many - 1), many + 1)
        own = np.append(symbol, 0)[take]
        own[ends - 1] = 0
        texts.append(own)
        where.append(np.full(len(own), number))
        what.append(take)
    if not texts:
        return none, none, none
    text = np.concatenate(texts)
    index = FMIndex(text, len(windows.vocabulary.hashes))
    low, high = index.search(windows.symbols, windows.length)
    many = high - low
    window = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(window)) + np.repeat(low - (np.cumsum(many) - many), many)
    at = index.locate(rows)
    return window, np.concatenate(where)[at], np.concatenate(what)[at]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; touching spans become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(reach) - 1)]


def _cleaned(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):  # a block is some 4 MB of benchmark text, whatever the benchmark's size
        yield [(r.item, r.text) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def find_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` as a struct ``row``, with n_words, n_hit, items and clean.

    Words are runs of 0-9, A-Z (lower-cased), a-z and all characters above ASCII.  A window is
    ``size`` consecutive words of an item, or all of them if the item has fewer.  n_hit counts
    the words inside any occurrence, items lists the ids (as strings, sorted) of the items that
    occur, and clean is the text without its hit words and what stands between hit words of one
    run.  Null and empty texts have no words, nor do empty items; an item without an id hits
    words but isn't listed; items that share an id count as one.  Documents may repeat.
    """
    columns = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("_text")]
    out = df.select(*columns, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    context = df.sparkSession.sparkContext

    def step(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for parts in (list(some) for batch in batches for some in batched(common.slices(batch, "_text"), SHARD_SLICES)):
            shard, found = [], []
            for _, data, offsets in parts:
                own = common.words(data, offsets, _IS_WORD)
                shard.append((windows.vocabulary.symbols(data, own), own.doc))
                found.append(own)
            window, number, word = occurrences(shard, windows)
            del shard
            order = np.argsort(number, kind="stable")
            window, number, word = window[order], number[order], word[order]
            for k, ((part, _, offsets), own) in enumerate(zip(parts, found, strict=True)):
                lo, hi = np.searchsorted(number, [k, k + 1])
                spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                hit_doc = own.doc[word[lo:hi]] if hi > lo else np.zeros(0, np.int64)
                by = np.argsort(hit_doc, kind="stable")
                for some in np.split(by, np.flatnonzero(np.diff(hit_doc[by])) + 1) if len(by) else []:
                    i = int(hit_doc[some[0]])
                    begin = word[lo + some] - own.first[i]
                    end = begin + windows.length[window[lo + some]]
                    before = np.array(spans[i] or [], np.int64).reshape(-1, 2)
                    a, b = merged(np.append(before[:, 0], begin), np.append(before[:, 1], end))
                    spans[i] = np.stack([a, b], 1).ravel().tolist()
                    names = {windows.names[x] for w in np.unique(window[lo + some]) for x in windows.items[windows.item_first[w] : windows.item_first[w + 1]]}
                    items[i] = sorted(names | set(items[i] or []))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(own.first)), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row", "_text", "n_words", "spans", "items"])

    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = context.broadcast(windows_of(rows, size))
        out = out.mapInArrow(lambda batches, shared=shared: step(shared, batches), schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "_text"):
                own = common.words(data, offsets, _IS_WORD)
                clean, n_hit = [], []
                for i, spans in enumerate(part.column(3).to_pylist()):
                    text, ends = data[offsets[i] : offsets[i + 1]].tobytes(), own.first[i]
                    pairs = list(zip((spans or [])[::2], (spans or [])[1::2], strict=True))
                    n_hit.append(sum(b - a for a, b in pairs))
                    clean.append(_cleaned(text, [(int(own.start[ends + a] - offsets[i]), int(own.end[ends + b - 1] - offsets[i])) for a, b in pairs]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_hit, pa.int64()), part.column(4), pa.array(clean, pa.binary()).cast(pa.string())], ["row", "n_words", "n_hit", "items", "clean"])

    fields = [schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())]
    done = out.mapInArrow(finish, T.StructType(fields))
    return done.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(common.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(w), 10) AS n, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM item_windows),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT s.doc_id, s.i, s.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM starts) s JOIN win ON s.n = win.n AND s.gram = win.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
