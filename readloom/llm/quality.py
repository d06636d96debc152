"""Quality: a generalised additive model with pairwise interactions.

Cyclic boosting goes round the features and fits a shallow tree to each in turn, on binned values;
the sum of a feature's trees is its lookup table.  Then the pairs that explain most of what is
left get tables over two coarser binnings.  Scoring adds up table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common
from readloom.llm.toxicity import labelled_sample

SAMPLE_ROWS = 6000  # labelled rows that training takes at most
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAST_WEIGHT, RIDGE = 0.1, 2.0, 1.0
_IS_WORD = common.table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_CLASSES = {
    "upper": common.table_of(lambda b: 65 <= b <= 90),
    "lower": common.table_of(lambda b: 97 <= b <= 122),
    "digit": common.table_of(lambda b: 48 <= b <= 57),
    "stop": common.table_of(lambda b: chr(b) in ".,;:?"),
    "symbol": common.table_of(lambda b: 32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?-'\""),
    "space": common.table_of(lambda b: b == 32),
    "line": common.table_of(lambda b: b == 10),
    "high": common.table_of(lambda b: b >= 128),
}
FEATURES = ["length", "words", "word_length", "upper", "digits", "stops", "symbols", "lines", "high", "distinct", "repeated", "distinct_pairs", "symbol_words", "long_words", "commonest"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a slice; shares of an empty text are zero."""
    n, size = len(offsets) - 1, np.diff(offsets)
    counts = {k: np.diff(np.concatenate([[0], np.cumsum(t[data])])[offsets]) for k, t in _CLASSES.items()}
    found = common.words(data, offsets, _IS_WORD)
    words = np.diff(found.first)
    per = lambda x, y: x / np.maximum(y, 1)
    by_doc = lambda flags: np.bincount(found.doc, flags, n)
    hashes = common.Rolling(data).of(found.start, found.end)
    own, times = np.unique(common.mixed_in(hashes, found.doc), return_counts=True)
    _, at = np.unique(common.mixed_in(hashes, found.doc), return_index=True)
    distinct = np.bincount(found.doc[at], minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, found.doc[at], times)
    inner = found.doc[1:] == found.doc[:-1]
    again = np.concatenate([[False], inner & (hashes[1:] == hashes[:-1])])[: len(hashes)]
    pair = common.mixed_in(common.mixed_in(hashes[:-1], hashes[1:]), found.doc[1:])[inner]
    _, first = np.unique(pair, return_index=True)
    pairs = np.bincount(found.doc[1:][inner][first], minlength=n)
    odd = np.concatenate([[0], np.cumsum(_CLASSES["symbol"][data])])
    letters = found.end - found.start
    return np.stack([
        np.log1p(size), np.log1p(words), per(by_doc(letters), words), per(counts["upper"], counts["upper"] + counts["lower"]),
        per(counts["digit"], size), per(counts["stop"], words), per(counts["symbol"], size), per(counts["line"], words), per(counts["high"], size),
        per(distinct, words), per(by_doc(again), words), per(pairs, words - 1), per(by_doc(odd[found.end] > odd[found.start]), words), per(by_doc(letters > 20), words), per(commonest, words),
    ], 1)


@dataclass
class Additive:
    """Bin edges and lookup tables; ``pairs`` are (a, b, edges of a, edges of b, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, one, two, table in self.pairs:
            out += table[np.searchsorted(one, x[:, a], "right"), np.searchsorted(two, x[:, b], "right")]
        return 1 / (1 + np.exp(-out))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(slope: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """The best split of a row of bins, by the drop in squared loss, and its place."""
    s, w = np.cumsum(slope)[:-1], np.cumsum(weight)[:-1]
    total, all_ = slope.sum(), weight.sum()
    fine = (w >= LEAST_WEIGHT) & (all_ - w >= LEAST_WEIGHT)
    if not fine.any():
        return 0.0, 0
    gain = np.where(fine, s**2 / (w + RIDGE) + (total - s) ** 2 / (all_ - w + RIDGE) - total**2 / (all_ + RIDGE), -np.inf)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(slope: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of each bin by a tree of that depth over the bins."""
    gain, at = _gain(slope, weight) if depth and len(slope) > 1 else (0.0, 0)
    if gain <= 0:
        return np.full(len(slope), slope.sum() / (weight.sum() + RIDGE))
    return np.concatenate([_tree(slope[:at], weight[:at], depth - 1), _tree(slope[at:], weight[at:], depth - 1)])


def _pair_tree(slope: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that splits on one feature, then each side on the other: the better of both orders, with its gain."""
    best = (-1.0, np.zeros_like(slope))
    for turned in (False, True):
        s, w = (slope.T, weight.T) if turned else (slope, weight)
        for at in range(1, len(s)):
            step, gain = np.empty_like(s), 0.0
            for part in (slice(0, at), slice(at, None)):
                values = _tree(s[part].sum(0), w[part].sum(0), 1)
                step[part] = values
                gain += float((values * s[part].sum(0)).sum())
            if gain > best[0]:
                best = gain, step.T.copy() if turned else step
    return best


def fit(x: np.ndarray, label: np.ndarray) -> Additive:
    share = (label.sum() + 1) / (len(label) + 2)
    model = Additive(float(np.log(share / (1 - share))), [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(x) or label.min() == label.max():
        return model
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(x), model.base)
    for _ in range(ROUNDS):
        for j, (bins, table) in enumerate(zip(binned, model.tables, strict=True)):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(bins, label - p, len(table)), np.bincount(bins, p * (1 - p), len(table)))
            model.tables[j] += step
            total += step[bins]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = len(coarse[b]) + 1
        cell, cells, p = rough[a] * wide + rough[b], (len(coarse[a]) + 1) * wide, 1 / (1 + np.exp(-total))
        return cell, np.bincount(cell, label - p, cells).reshape(-1, wide), np.bincount(cell, p * (1 - p), cells).reshape(-1, wide)

    ranked = sorted(((_pair_tree(*grids(a, b)[1:])[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:PAIRS]
    tables = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in ranked}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in tables.items():
            cell, slope, weight = grids(a, b)
            step = RATE * _pair_tree(slope, weight)[1]
            table += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, coarse[a], coarse[b], table) for (a, b), table in tables.items()]
    return model


def fitted(documents: DataFrame, labels: DataFrame) -> Additive:
    """A model from labels.quality, without rows whose crc32 of doc_id leaves 2 when divided by 4."""
    sample = labelled_sample(documents, labels, "quality", 4, 2, rows=SAMPLE_ROWS)
    rows = [features(data, offsets) for batch in sample.to_batches() for _, data, offsets in common.slices(batch, "text")]
    return fit(np.concatenate(rows) if rows else np.zeros((0, len(FEATURES))), sample["label"].to_numpy().astype(float))


def score_quality(df: DataFrame, model: Additive, text: str = "text", into: str = "quality") -> DataFrame:
    """``df`` with the probability of label 1 by the whole ``text`` in ``into`` (replaced if there); null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = common.carried(df, text, [into])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(features(data, offsets)))], ["row", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != into], F.col("score").alias(into))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fitted(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scored = score_quality(documents, model, into="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
