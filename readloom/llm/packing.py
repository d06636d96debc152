"""Packing of documents into sequences of a fixed number of tokens.

Only a text longer than a sequence is cut.  How the pieces share sequences is decided on the
histogram of their lengths, which has at most one row a length, whatever the size of the corpus:

* The configuration linear program has a variable for each configuration (a multiset of lengths
  that fits into a sequence) and a covering row for each length; it asks for the least number of
  configurations.  Multiplicative weights solve it: each row has a price, which falls as the row
  gets covered; a knapsack over the capacity finds the configurations of (nearly) the highest
  price, and those are taken by small steps.
* The fractions are rounded: configurations are used as often as they say while there are pieces
  for them, and what is left is packed by best fit on the histogram.

The result is a list of (configuration, times).  Pieces of a length are numbered by one
distributed sort, and a piece's number gives its sequence and its place by a search in that list.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

MOST = 2048
STEP = 0.25
SLICE = 1 << 22  # bytes of texts encoded together
CACHED, CACHED_BYTES = 1 << 20, 1 << 26  # parts that a worker remembers, and their bytes
MISSED = 64
_SOLID = common.table_of(lambda b: b not in (0x20, 0x0A))  # both are white space to the tokenizer, so no token spans them
_LETTER = common.table_of(lambda b: chr(b).isalpha() and b < 128)
_SIGN = common.table_of(lambda b: 0x20 < b < 0x7F and not chr(b).isalnum() and b != 0x27)


# The plan: from a histogram to configurations


def knapsack(prices: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price that fits into 0..``most``, and the longest piece of such a choice (0: none).

    prices[l] is that of a piece of length l, which may be taken any number of times.
    """
    value, choice = np.zeros(most + 1), np.zeros(most + 1, np.int64)
    falling = prices[::-1].copy()  # aligned with what is left: room - l left pays prices[l]
    for room in range(1, most + 1):
        gains = falling[most - room : most] + value[:room]
        best = gains.argmax()
        if gains[best] > value[room - 1]:
            value[room], choice[room] = gains[best], room - best
        else:
            value[room], choice[room] = value[room - 1], choice[room - 1]
    return value, choice


def configuration(length: int, prices: np.ndarray, value: np.ndarray, choice: np.ndarray, counts: np.ndarray, most: int) -> tuple[tuple[int, int], ...]:
    """The configuration of the highest price that holds ``length``: (length, copies), with no more copies of a length than there are pieces."""
    taken, room = {length: 1}, most - length
    while room > 0:
        best = int(choice[room])
        if best and taken.get(best, 0) >= counts[best]:  # used up: the best of the others
            gains = prices[1 : room + 1] + value[room - 1 :: -1][:room]
            gains[prices[1 : room + 1] <= 0] = 0
            gains[[k - 1 for k, copies in taken.items() if k <= room and copies >= counts[k]]] = 0
            best = room - int(np.argmax(gains[::-1])) if gains.any() else 0
        if not best:
            break
        taken[best] = taken.get(best, 0) + 1
        room -= best
    return tuple(sorted(taken.items()))


def fractions(counts: np.ndarray, most: int, step: float = STEP, goal: float = 1.0) -> dict[tuple[tuple[int, int], ...], float]:
    """A nearly least fractional cover of the histogram by configurations.

    A row's price starts in proportion to its length (the dual of the bound by volume) and falls
    by exp(-share covered in the round); a row covered ``goal`` times over has no price any more.  In a round the
    lengths ask, in the order of what they can get, for their best configuration under one knapsack.
    Those within ``step`` of the best price are taken, by as much as covers no row by more than ``step``
    of its pieces in a round; after ``MISSED`` that find their rows used up, prices are set anew.
    """
    lengths = np.flatnonzero(counts)
    prices = np.arange(most + 1) / most
    prices[counts == 0] = 0
    cover, amounts = np.zeros(most + 1), {}
    while len(open_rows := lengths[cover[lengths] < goal * counts[lengths] * (1 - 1e-9)]):
        value, choice = knapsack(prices, most)
        whole = prices[open_rows] + value[most - open_rows]
        enough = whole.max() * (1 - step)
        used, limit, missed = np.zeros(most + 1), step * counts, 0
        for at in np.lexsort((-open_rows, -whole)):
            length = int(open_rows[at])
            if whole[at] < enough or missed == MISSED:
                break
            if used[length] >= limit[length]:
                continue
            chosen = configuration(length, prices, value, choice, counts, most)
            size = min(min(limit[k] - used[k], goal * counts[k] - cover[k]) / copies for k, copies in chosen)
            if size <= 0:
                missed += 1
                continue
            amounts[chosen] = amounts.get(chosen, 0.0) + size
            for k, copies in chosen:
                used[k] += size * copies
                cover[k] += size * copies
        prices *= np.exp(-used / np.maximum(counts, 1))
        prices[cover >= goal * counts * (1 - 1e-9)] = 0
    return {c: x / goal for c, x in amounts.items()}


@dataclass
class Plan:
    """Configurations, each for so many sequences: (length, copies) pairs, longest first."""

    configurations: list[tuple[list[tuple[int, int]], int]]

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.configurations)


def best_fit(left: np.ndarray, most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit on a histogram, longest first: a sequence takes the longest piece that still fits, again and again."""
    left, out = left.copy(), []
    while left.any():
        taken, room = {}, most
        while room and len(found := np.flatnonzero(left[1 : room + 1])):
            k = int(found[-1]) + 1
            copies = min(room // k, int(left[k]))
            taken[k] = copies
            left[k] -= copies
            room -= k * copies
        times = min((int(left[k]) // copies for k, copies in taken.items()), default=0)  # the same again, while it would be made again
        for k, copies in taken.items():
            left[k] -= copies * times
        out.append((sorted(taken.items(), reverse=True), times + 1))
    return out


def plan(counts: np.ndarray, most: int = MOST, step: float = STEP) -> Plan:
    """Sequences for all pieces of a histogram (counts[l] pieces of length l, 1 to ``most``)."""
    counts = np.asarray(counts, np.int64)
    left, out = counts.copy(), []
    if left[most]:  # a full piece is a configuration by itself, at any prices
        out.append(([(most, 1)], int(left[most])))
        left[most] = 0
    if left.any():
        share = sorted(fractions(left, most, step).items(), key=lambda x: (-x[1], x[0]))
        full = [x for x in share if sum(k * copies for k, copies in x[0]) == most]
        # down for all of them; up for full ones, those of the longest pieces first, which are the hardest to place
        for ordered, wanted in ((share, lambda x: int(x)), (sorted(full, key=lambda x: -x[0][-1][0]), lambda x: int(x > int(x)))):
            for chosen, x in ordered:
                times = min(wanted(x), min(int(left[k]) // copies for k, copies in chosen))
                if times > 0:
                    out.append((list(chosen[::-1]), times))
                    for k, copies in chosen:
                        left[k] -= copies * times
        out += best_fit(left, most)
    return Plan(out)


class Slots:
    """Where the n-th piece of a length goes, as runs of numbers that one configuration takes."""

    def __init__(self, made: Plan, most: int):
        taken, runs, sequence = np.zeros(most + 1, np.int64), [], 0
        for chosen, times in made.configurations:
            offset = 0
            for k, copies in chosen:
                runs.append((k, taken[k], sequence, copies, offset))
                taken[k] += copies * times
                offset += k * copies
            sequence += times
        runs.sort()
        self.length, self.first, self.sequence, self.copies, self.offset = np.array(runs, np.int64).reshape(-1, 5).T
        self.keys = self._key(self.length, self.first)

    @staticmethod
    def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length << 48) + number

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers (from 0) among those of their length."""
        run = np.searchsorted(self.keys, self._key(length, number), "right") - 1
        times, copy = np.divmod(number - self.first[run], self.copies[run])
        return self.sequence[run] + times, self.offset[run] + copy * length


# Pieces


# What the tokenizer file has to say, for its texts to be encoded in parts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _in_parts(model: str) -> bool:
    """Whether tokens of this file never span white space or the border of a letter and a sign, wherever they stand."""
    said = json.loads(model)
    normal, first = said["normalizer"] or {}, ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    steps = [x["type"] for x in normal.get("normalizers", [])]
    white = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal.get("normalizers", []) if x["type"] == "Replace")
    return steps == NORMAL and white and first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed" and first.get("invert") is True and not said["post_processor"]


class Encoder:
    """Ids of the texts of a slice, by parts: each distinct part is encoded once and remembered, as long as there is room.

    Parts are runs without spaces and newlines, cut between an ASCII letter and an ASCII sign other
    than the apostrophe: there no token of such a tokenizer goes on, and no character joins with the
    next.  A slice that holds the string of a special token is cut at spaces and newlines alone.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        self.model, self.parted = Tokenizer.from_str(model), _in_parts(model)
        self.special = [x["content"].encode() for x in json.loads(model)["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known, self.bytes, self.size = {}, 0, 0
        self.begin, self.flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def _places(self, distinct: list[bytes]) -> np.ndarray:
        """The place of each part in the store, to which the new ones are added."""
        if len(self.known) > CACHED or self.bytes > CACHED_BYTES:
            self._forget()
        out = np.fromiter((self.known.get(x, -1) for x in distinct), np.int64, len(distinct))
        new = np.flatnonzero(out < 0)
        for at in range(0, len(new), 4096):  # an encoding is much larger than its ids
            some = [distinct[i] for i in new[at : at + 4096]]
            coded = [e.ids for e in self.model.encode_batch([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)]
            first = len(self.known)
            ends = self.size + np.cumsum([len(ids) for ids in coded])
            while len(self.begin) <= first + len(some):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            while len(self.flat) < ends[-1]:
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.begin[first + 1 : first + 1 + len(some)] = ends
            self.flat[self.size : ends[-1]] = [x for ids in coded for x in ids]
            self.size = int(ends[-1])
            self.known.update(zip(some, range(first, first + len(some)), strict=True))
            self.bytes += sum(map(len, some))
            out[new[at : at + 4096]] = np.arange(first, first + len(some))
        return out

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and bounds of the parts, and the first part of each text (one more than texts)."""
        if not self.parted:
            return data, offsets, np.arange(len(offsets))
        solid = _SOLID[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        raw = data.tobytes()
        if not any(x in raw for x in self.special):
            letter, sign = _LETTER[data], _SIGN[data]
            begins[1:] |= letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
        begins &= solid
        kept = np.ascontiguousarray(data[solid])
        bounds = np.concatenate([np.flatnonzero(begins[solid]), [len(kept)]])
        return kept, bounds, np.searchsorted(np.flatnonzero(begins), offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end`` after each text, and where each text's begin (one more than texts)."""
        n_docs = len(offsets) - 1
        kept, bounds, first_part = self._parts(data, offsets)
        parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        place = self._places(parts.dictionary.to_pylist())[parts.indices.to_numpy(zero_copy_only=False)]
        begin = self.begin[place]
        each = self.begin[place + 1] - begin
        upto = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(begin - upto[:-1], each) + np.arange(upto[-1])
        first = upto[first_part] + np.arange(n_docs + 1)  # an end for each text before
        out = np.full(int(first[-1]), end, np.uint32)
        out[np.arange(upto[-1]) + np.repeat(np.arange(n_docs), np.diff(upto[first_part]))] = self.flat[at]
        return out, first


@cache
def _encoder(model: str) -> Encoder:
    """A worker keeps what it knows from one task to the next."""
    return Encoder(model)


def pieces(df: DataFrame, text: str = "text", most: int = MOST, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """One row for each piece of each row of ``df``: its columns but ``text``, and piece, start, length and ids.

    A text's ids are those of the tokenizer file (no special tokens added), and then ``end``.  Only
    those with more than ``most`` ids are cut, into pieces of ``most``; the last may be shorter.  ids
    is binary, unsigned little-endian 32-bit numbers; start counts the ids before the piece.  A null
    or empty text is the one id ``end``.  Rows that repeat another count by themselves; an empty
    table has no pieces.  Columns already called piece, start, length or ids are replaced.
    """
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file; it is read where the driver runs
    own = ["piece", "start", "length", "ids"]
    others = [c for c in df.columns if c not in (text, *own)]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            for part, data, offsets in common.slices(batch, "_text", SLICE):
                ids, first = encoder.encode(data, offsets, end)
                size = np.diff(first)
                many = -(-size // most)
                doc = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * most
                length = np.minimum(size[doc] - start, most)
                bounds = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), raw], ["_row", *own])

    fields = [rows.schema["_row"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(fields)).select(*[F.col(f"_row.`{c}`").alias(c) for c in others], *own)


def pack(rows: DataFrame, most: int = MOST, step: float = STEP) -> DataFrame:
    """``rows``, each with a length from 1 to ``most``, and the sequence_id and offset where it goes.

    A sequence's rows lie gapless from offset 0 and have ``most`` tokens in all or fewer.  Rows that
    repeat another are packed by themselves; an empty table has no sequences; a length that is null
    or out of bounds is an error.  Columns already called sequence_id or offset are replaced.
    """
    table = common.cut(rows.drop("sequence_id", "offset"))
    counts = np.zeros(most + 1, np.int64)
    for r in table.groupBy("length").count().filter(F.col("length").isNull() | F.col("length").between(1, most)).collect():  # at most one row a length
        if r["length"] is None:
            raise ValueError("a length is null")
        counts[r["length"]] = r["count"]
    if not table.filter(~F.col("length").between(1, most)).isEmpty():
        raise ValueError(f"lengths have to be from 1 to {most}")
    slots = Slots(plan(counts, most, step), most)
    # one order over all rows, in which those of a length are together: a row's place is its partition's start and its place there
    placed = table.withColumn("_readloom_at", F.monotonically_increasing_id()).orderBy("length", "_readloom_at").withColumn("_readloom_at", F.monotonically_increasing_id())
    placed = common.cut(placed)
    starts = common.partition_starts(placed, "_readloom_at")
    before = np.concatenate([[0], np.cumsum(counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, length = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_readloom_at", "_length"))
            number = starts[at >> 33] + (at & ((1 << 33) - 1)) - before[length]
            sequence, offset = slots.of(length, number) if len(length) else (length, length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["_row", "sequence_id", "offset"])

    whole = placed.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("_row"), "_readloom_at", F.col("length").cast("long").alias("_length"))
    fields = [whole.schema["_row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return whole.mapInArrow(run, T.StructType(fields)).select(*[F.col(f"_row.`{c}`").alias(c) for c in table.columns], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces with their ids: the ids of a sequence in the order of its offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids: Column = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(common.documents(spark, sf_dir).select("doc_id", "text"))
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
