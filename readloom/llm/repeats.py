"""Removal of byte strings of a given length that start more than once in the corpus.

Prefix-free parsing over the corpus: a rolling hash picks triggers by content (the leftmost
smallest hash of each window), so equal strings are cut at equal places and every string of
``length`` bytes is tied to one trigger inside it.  The stretch of text about a trigger is a
phrase; the table of distinct phrases is the dictionary, and (text, trigger) rows are the parse.
Where the core of a phrase, which all its strings hold, is shared, but not the whole phrase, it is
cut into stretches of 64, 8 and 1 string starts, and the same dictionary step names those, once
for each distinct phrase.  Equal names stand for neighbours in corpus order that share ``length``
bytes: only which strings are equal is asked here, so names are digests of 128 bits (BLAKE2b, never
rolling hashes), and the order itself isn't built, which would take a row for each byte of the
dictionary.  Texts are worked on in chunks of ``CHUNK`` string starts, so no row grows with a text
until its runs are put together; the end of a chunk is to phrases what the end of a text is.

A step gives the stretches that occur twice as a whole (all their strings repeat) and one
representative of each distinct stretch that shares its core, but not all of itself, with others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import common

GRAM = 24
LEVELS = (64, 8, 1)
SLICE = 1 << 18
CHUNK = 1 << 14
_ROWS = "r binary, part int, place long, size int, core binary, whole binary"
_KEY = ["r", "part"]


def window_size(length: int) -> int:
    """Starts from which a trigger is picked; with the core that follows it they fill ``length`` bytes."""
    return max(1, length * 21 // 25)


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window start: the leftmost position of the smallest hash in the window."""
    least, where, span = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        take = least[step:] < least[:-step]
        where = np.where(take, where[step:], where[:-step])
        least = np.where(take, least[step:], least[:-step])
        span += step
    return where


class Triggers:
    """Triggers of the texts of a slice, and the first and last string start tied to each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.doc = none
        window = window_size(length)
        gram = min(GRAM, length - window + 1)
        room = np.maximum(np.diff(offsets) - length + 1, 0)
        if not room.any():
            return
        begin = np.cumsum(room) - room
        start = np.arange(int(room.sum())) + np.repeat(offsets[:-1] - begin, room)
        grams = np.arange(len(data) - gram + 1)
        tied = anchors(common.Rolling(data).of(grams, grams + gram), window)[start].astype(np.int64)
        doc = np.repeat(np.arange(len(room)), room)
        head = np.flatnonzero(np.concatenate([[True], (tied[1:] != tied[:-1]) | (doc[1:] != doc[:-1])]))
        self.at, self.first, self.doc = tied[head], start[head], doc[head]
        self.last = start[np.append(head[1:], len(start)) - 1]


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray, tag: int, distance: np.ndarray | int = 0, before: np.ndarray | int = 0) -> pa.Array:
    """Names of spans; those of different kinds, distances and extents before the trigger differ."""
    return pa.array(common.digests(data, start, end, (tag << 40) + distance, before), pa.binary())


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """A row for each trigger: the core that all its strings hold, and the phrase that holds them all.

    Ends of texts cut phrases; a phrase's name has its extent before the trigger.
    """
    found, window = Triggers(data, offsets, length), window_size(length)
    lo, hi = np.maximum(found.at - window + 1, offsets[found.doc]), np.minimum(found.at + length, offsets[found.doc + 1])
    core = _names(data, found.at, found.at + length - window + 1, 1)
    return {"doc": found.doc, "place": found.at - offsets[found.doc], "size": np.zeros(len(found.at), np.int32), "core": core, "whole": _names(data, lo, hi, 2, 0, found.at - lo)}


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, doc: np.ndarray, places: np.ndarray, wider: int, size: int) -> dict[str, np.ndarray]:
    """Rows of the stretches of ``size`` string starts inside the given wider ones.

    A stretch is known by its trigger t (counted from its text's start) and the distance of its
    nearest start from it: place is t * length + distance.  Distances are multiples of the size,
    so equal strings, which are equally far from equal triggers, are in equal stretches.
    """
    found = Triggers(data, offsets, length)
    trigger = places // (length if wider else 1) + offsets[doc]
    at = np.searchsorted(found.at, trigger)
    if wider:
        base, many = places % length // size, np.full(len(places), wider // size)
    else:
        base = (trigger - found.last[at]) // size
        many = (trigger - found.first[at]) // size - base + 1
    distance = (np.arange(int(many.sum())) + np.repeat(base - np.cumsum(many) + many, many)) * size
    at, trigger, doc = np.repeat(at, many), np.repeat(trigger, many), np.repeat(doc, many)
    some = (distance <= trigger - found.first[at]) & (distance + size > trigger - found.last[at])
    distance, trigger, doc = distance[some], trigger[some], doc[some]
    nearest, farthest = trigger - distance, trigger - distance - size + 1
    lo, hi = np.maximum(farthest, offsets[doc]), np.minimum(nearest + length, offsets[doc + 1])
    core = _names(data, nearest, farthest + length, 3 + size, distance)
    whole = core if size == 1 else _names(data, lo, hi, 300 + size, distance, trigger - lo)
    return {"doc": doc, "place": (trigger - offsets[doc]) * length + distance, "size": np.full(len(doc), size, np.int32), "core": core, "whole": whole}


def _batch(part: pa.RecordBatch, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    doc = pa.array(rows.pop("doc"))
    return pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), *[x if isinstance(x, pa.Array) else pa.array(x) for x in rows.values()]], [*_KEY, *rows])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose third column holds compressed texts."""
    inflate = zstandard.ZstdDecompressor()
    for at in range(0, batch.num_rows, 64):
        part = batch.slice(at, 64)
        texts = pa.array([inflate.decompress(x.as_py()) for x in part.column(2)], pa.large_binary())
        yield from common.slices(part.set_column(2, "packed", texts), "packed", SLICE)


def _flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, in order within a row, and the row of each."""
    many = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(many)), many)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose core has another row.

    Written out, the cores are a side of the join of their own, so that a hot core's rows can be split.
    """
    shared = common.cut(rows.groupBy("core").count().filter("count > 1").select("core"))
    return rows.join(shared, "core", "left_semi").select(*rows.columns)


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stretches that occur twice, and a representative of each distinct stretch of a core that has several."""
    distinct = rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "place")).alias("one"))
    repeated = rows.join(distinct.filter("n > 1").select("whole"), "whole", "left_semi").select(*_KEY, "place", "size").distinct()
    several = common.cut(distinct.groupBy("core").count().filter("count > 1").select("core"))
    return common.cut(repeated), distinct.join(several, "core", "left_semi").select("one.*")


def _repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """(r, part, packed, places, sizes): all chunks, compressed, of the texts that share a core, with their repeated stretches, if any.

    texts: text, and in r its digest.  Equal texts give equal rows.
    """

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text", SLICE):
                yield _batch(part, _phrases(data, offsets, length))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([deflate.compress(x.as_py()) for x in common.byte_column(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], [*_KEY, "packed"])

    def stretches(wider: int, size: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in _unpacked(batch):
                    places, doc = _flat_lists(part.column(3))
                    yield _batch(part, _stretches(data, offsets, length, doc, places, wider, size))

        return run

    body = F.encode("text", "UTF-8")
    last = F.floor((F.octet_length("text") - length) / CHUNK).cast("int")  # a chunk has CHUNK string starts of its own
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("part"), F.substring(body, k * CHUNK + 1, F.lit(CHUNK + length - 1)).alias("text")))
    long = texts.filter(F.octet_length("text") >= length).select("r", F.explode(chunks).alias("c")).select("r", "c.part", "c.text")
    rows = common.cut(_shared(common.cut(long.mapInArrow(phrases, _ROWS))))
    touched = rows.select("r").distinct()
    held = common.cut(long.mapInArrow(packed, "r binary, part int, packed binary").join(touched, "r", "left_semi").dropDuplicates(_KEY))
    found, pending = _named(rows)
    wider = 0
    for size in (x for x in LEVELS if 4 * x <= length or x == 1):  # a stretch needs a core
        places = pending.groupBy(*_KEY).agg(F.collect_list("place").alias("places"))  # of one chunk
        rows = common.cut(held.join(places, _KEY).select(*_KEY, "packed", "places").mapInArrow(stretches(wider, size), _ROWS))
        repeated, pending = _named(rows)
        found, wider = found.union(repeated), size
    places = found.groupBy(*_KEY).agg(F.collect_list(F.struct("place", "size")).alias("found"))
    runs = held.join(places, _KEY, "left").select(*_KEY, "packed", F.col("found.place").alias("places"), F.col("found.size").alias("sizes"))
    return runs.join(found.select("r").distinct(), "r", "left_semi")


def _covered(found: Triggers, offsets: np.ndarray, n: int, length: int, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs that the strings of the given stretches cover in a slice."""
    starts = np.zeros(n + 1, np.int64)
    trigger = np.where(size > 0, place // length, place) + offsets[doc]
    distance = np.where(size > 0, place % length, 0)
    at = np.searchsorted(found.at, trigger)
    lo = np.where(size > 0, np.maximum(trigger - distance - size + 1, found.first[at]), found.first[at])
    hi = np.where(size > 0, np.minimum(trigger - distance, found.last[at]), found.last[at])
    np.add.at(starts, lo, 1)
    np.add.at(starts, hi + 1, -1)
    hit = np.flatnonzero(np.cumsum(starts)[:-1] > 0)
    owner = np.searchsorted(offsets, hit, "right")
    head = np.concatenate([[True], (hit[1:] > hit[:-1] + length) | (owner[1:] != owner[:-1])])[: len(hit)]
    return hit[head], hit[np.append(np.flatnonzero(head)[1:] - 1, len(hit) - 1)] + length if len(hit) else hit


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): one row a row of ``df``, with the removed byte runs.

    Each byte that a string of ``length`` bytes covers goes, if the string also starts anywhere
    else in the table, the same text included; overlaps count, and strings are judged on the
    input.  Runs are half-open and maximal.  kept holds the other bytes; as runs may end inside a
    character it is binary, or, with ``digest``, the SHA-256 in hex.  Null and empty texts have no
    strings.  Rows that repeat, or lack, a doc_id are documents of their own.  Other columns are
    not read; an empty table gives an empty one.
    """
    # equal texts share a digest, and so all that is found out about them
    plain = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("r", F.unhex(F.substring(F.sha2("text", 256), 1, 2 * common.DIGEST)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _unpacked(batch):
                (places, doc), (sizes, _) = _flat_lists(part.column(3)), _flat_lists(part.column(4))
                lo, hi = _covered(Triggers(data, offsets, length), offsets, len(data), length, doc, places, sizes)
                of = np.searchsorted(offsets, lo, "right") - 1
                first, shift = np.searchsorted(of, np.arange(len(offsets))), part.column(1).to_numpy().astype(np.int64)[of] * CHUNK - offsets[of]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1)), *(common.lists(x + shift, first, pa.int64()) for x in (lo, hi)), part.column(2).cast(pa.binary())], [*_KEY, "starts", "ends", "body"])

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunks = sorted(batch.column(1)[i].as_py(), key=lambda c: c["part"])
                body = b"".join(c["body"][: CHUNK if c is not chunks[-1] else None] for c in chunks)
                runs: list[list[int]] = []
                for a, b in ((a, b) for c in chunks for a, b in zip(c["starts"], c["ends"], strict=True)):
                    if runs and a <= runs[-1][1]:  # it goes on from the chunk before
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                cuts = [0, *(x for run in runs for x in run), len(body)]
                left = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                kept = pa.array([hashlib.sha256(left).hexdigest() if digest else left], pa.string() if digest else pa.binary())
                lists = [pa.array([[run[k] for run in runs]], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *lists, kept], ["r", "starts", "ends", "kept"])

    found = _repeated_runs(plain.select("r", "text"), length).mapInArrow(spans, "r binary, part int, starts array<long>, ends array<long>, body binary")
    runs = found.groupBy("r").agg(F.collect_list(F.struct("part", "starts", "ends", "body")).alias("chunks"))  # as large as the text
    runs = runs.mapInArrow(whole_texts, f"r binary, starts array<long>, ends array<long>, kept {'string' if digest else 'binary'}")
    whole = F.sha2("text", 256) if digest else F.encode("text", "UTF-8")
    marked = F.octet_length("text") >= length  # only these can be among the runs
    brief = plain.select("doc_id", F.when(marked, F.col("r")).alias("r"), F.octet_length("text").cast("long").alias("n_bytes"), whole.alias("whole"))
    none = F.array().cast("array<long>")
    return brief.join(runs, "r", "left").select("doc_id", "n_bytes", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("kept", "whole").alias("kept"))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.documents(spark, sf_dir), digest=True)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
