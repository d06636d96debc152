"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a word part (an embedding and a smoothed log odds of its hash) with a
character part (embeddings and log odds of its byte n-grams, begin and end marked), so words that
were never seen are judged by their spelling.  Overlapping windows of words are scored, all of
them, and a document's score is that of its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

SAMPLE_ROWS = 5000  # labelled rows that training takes at most
SAMPLE_BYTES = 32 << 20  # bytes of text that training takes at most, all texts together
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 8, 4
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)
PRIOR_WEIGHT = 4.0
EPOCHS = (3, 3, 3)
FOLDS = 5  # a text's odds in training come from the other folds
RATE = 2.0  # of the embeddings' steps
LEAST_STEPS = 120  # in each round, of batches of 256 windows
BLOCK = 4096
SLICE = 1 << 19
PART = 1 << 15  # words whose inputs are made at once
_IS_WORD = common.table_of(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_CODES = common.BYTE_CODES[common.LOWER]


@dataclass
class Distinct:
    """The distinct words of a slice: table rows, n-gram rows end to end, and each word's place among them."""

    which: np.ndarray  # distinct word of each word
    name: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    first: np.ndarray


def distinct_words(data: np.ndarray, found: common.Words) -> Distinct:
    hashes = common.Rolling(data, _CODES).of(found.start, found.end)
    own, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    start, size = found.start[at], found.end[at] - found.start[at]
    ends = np.cumsum(size + 2)
    text = np.full(int(ends[-1]) if len(ends) else 0, ord("^"), np.uint8)
    body = np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)
    text[np.arange(int(size.sum())) + np.repeat(ends - size - 1 - np.cumsum(size) + size, size)] = data[body]
    if len(ends):
        text[ends - 1] = ord("$")
    names, parts, owner = common.Rolling(text, _CODES), [], []
    for n in GRAMS:
        many = np.maximum(size + 2 - n + 1, 0)
        begin = np.arange(int(many.sum())) + np.repeat(ends - size - 2 - np.cumsum(many) + many, many)
        parts.append(names.of(begin, begin + n) % np.uint64(GRAM_ROWS))
        owner.append(np.repeat(np.arange(len(own)), many))
    gram, owner = np.concatenate(parts).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Distinct(which, own, (own % np.uint64(WORD_ROWS)).astype(np.int64), gram[order], np.searchsorted(owner[order], np.arange(len(own) + 1)))


def windows(first: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each window; every word is in one, a document without words has none."""
    counts = np.diff(first)
    many = np.where(counts > 0, np.maximum(0, -(-(counts - size) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(counts)), many)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * stride
    return first[doc] + start, np.minimum(size, counts[doc] - start), doc


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their index."""
    return np.stack([np.bincount(index, column, n) for column in rows.T], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        inputs = 2 * EMBED + 3
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.word = (0.1 * rng.normal(size=(WORD_ROWS, EMBED))).astype(np.float32)
        self.gram = (0.1 * rng.normal(size=(GRAM_ROWS, EMBED))).astype(np.float32)
        self.word_odds, self.gram_odds = np.zeros(WORD_ROWS, np.float32), np.zeros(GRAM_ROWS, np.float32)
        self.dense = {"W0": draw(inputs, 3 * HIDDEN), "W1": draw(inputs, 3 * HIDDEN), "U0": draw(HIDDEN, 3 * HIDDEN), "U1": draw(HIDDEN, 3 * HIDDEN), "b0": np.zeros(3 * HIDDEN, np.float32), "b1": np.zeros(3 * HIDDEN, np.float32), "v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "c": np.full(1, -1, np.float32)}

    def inputs(self, d: Distinct) -> np.ndarray:
        """A row for each distinct word and a last one of zeros, for places after a window's end."""
        n = len(d.row)
        out = np.zeros((n + 1, 2 * EMBED + 3), np.float32)
        out[:n, :EMBED] = self.word[d.row]
        out[:n, 2 * EMBED] = self.word_odds[d.row]
        for lo in range(0, n, PART):  # so that memory for n-grams is bounded
            hi = min(n, lo + PART)
            many, begin = np.diff(d.first[lo : hi + 1]), d.first[lo]
            some = np.flatnonzero(many)
            if not len(some):
                continue
            at, gram, rows = d.first[lo:hi][some] - begin, d.gram[begin : d.first[hi]], some + lo
            out[rows, EMBED : 2 * EMBED] = np.add.reduceat(self.gram[gram], at, axis=0) / many[some, None]
            odds = self.gram_odds[gram]
            out[rows, 2 * EMBED + 1] = np.maximum.reduceat(odds, at)
            out[rows, 2 * EMBED + 2] = np.add.reduceat(odds, at) / many[some]
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, side: int, keep: list | None) -> np.ndarray:
        """States of one direction: x is the input projection, steps x windows x gates."""
        steps, n, _ = x.shape
        u, h = self.dense[f"U{side}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + r * inner)
            if keep is not None:
                keep.append((t, h, z, r, new, inner))
            h = new + z * (h - new)
            if not mask[t].all():
                h = h * mask[t][:, None]  # windows end in gaps only
            out[t] = h
        return out

    def score(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of each window; index: steps x windows, into the rows of x."""
        d = self.dense
        states = [self._run((x @ d[f"W{k}"] + d[f"b{k}"])[index], mask, k, None) for k in (0, 1)]
        weight = states[0] @ d["v"][:HIDDEN] + states[1] @ d["v"][HIDDEN:]
        value = states[0] @ d["o"][:HIDDEN] + states[1] @ d["o"][HIDDEN:]
        weight = np.exp(np.where(mask, weight - weight.max(0), -np.inf))
        return _sigmoid((weight * value).sum(0) / weight.sum(0) + d["c"][0])

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss, by the dense parameters and by the rows of x."""
        d, kept, states, projected = self.dense, ([], []), [], x[index]
        for k in (0, 1):
            states.append(self._run(projected @ d[f"W{k}"] + d[f"b{k}"], mask, k, kept[k]))
        s = np.concatenate(states, 2)
        weight, value = s @ d["v"], s @ d["o"]
        weight = np.exp(np.where(mask, weight - weight.max(0), -np.inf))
        weight /= weight.sum(0)
        logit = (weight * value).sum(0)
        slope = (_sigmoid(logit + d["c"][0]) - label) / len(label)
        out = {"c": np.array([slope.sum()], np.float32)}
        by_value = weight * slope
        by_weight = weight * (value - logit) * slope
        out["o"] = np.tensordot(by_value, s, 2).astype(np.float32)
        out["v"] = np.tensordot(by_weight, s, 2).astype(np.float32)
        by_state = by_value[..., None] * d["o"] + by_weight[..., None] * d["v"]
        by_x = np.zeros_like(projected)
        for k in (0, 1):
            u, w = d[f"U{k}"], d[f"W{k}"]
            by_u, by_in, carried = np.zeros_like(u), np.zeros((*index.shape, 3 * HIDDEN), np.float32), 0
            for t, h, z, r, new, inner in reversed(kept[k]):
                by_h = (by_state[t][:, k * HIDDEN : (k + 1) * HIDDEN] + carried) * mask[t][:, None]
                by_new = by_h * (1 - z) * (1 - new * new)
                by_zr = np.concatenate([by_h * (h - new) * z * (1 - z), by_new * inner * r * (1 - r)], 1)
                by_gate = np.concatenate([by_zr, by_new * r], 1)
                by_in[t] = np.concatenate([by_zr, by_new], 1)
                by_u += h.T @ by_gate
                carried = by_h * z + by_gate @ u.T
            out[f"U{k}"], out[f"W{k}"], out[f"b{k}"] = by_u, np.tensordot(projected, by_in, ((0, 1), (0, 1))), by_in.sum((0, 1))
            by_x += by_in @ w.T
        return out, _sums(index.ravel(), by_x.reshape(-1, x.shape[1]), len(x))


def _indices(start: np.ndarray, size: np.ndarray, which: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(WINDOW)[:, None]
    mask = place < size
    return np.where(mask, which[np.minimum(start + place, len(which) - 1)], blank), mask


def window_scores(net: Network, d: Distinct, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    x, out = net.inputs(d), np.zeros(len(start), np.float32)
    for lo in range(0, len(start), BLOCK):
        part = slice(lo, lo + BLOCK)
        out[part] = net.score(x, *_indices(start[part], size[part], d.which, len(d.row)))
    return out


class _Odds:
    """Log odds of a toxic document, for each bucket, by documents that have it, drawn to the overall odds; counted by fold."""

    def __init__(self, buckets: int):
        self.yes, self.every = np.zeros((FOLDS, buckets)), np.zeros((FOLDS, buckets))

    def add(self, bucket: np.ndarray, doc: np.ndarray, label: np.ndarray, fold: np.ndarray) -> None:
        pairs = np.unique(bucket * len(label) + doc)
        bucket, doc = pairs // len(label), pairs % len(label)
        for k in range(FOLDS):
            some = fold[doc] == k
            self.yes[k] += np.bincount(bucket[some], label[doc[some]], self.yes.shape[1])
            self.every[k] += np.bincount(bucket[some], minlength=self.yes.shape[1])

    def table(self, share: float, without: int | None = None) -> np.ndarray:
        """By all documents, or by those of the other folds."""
        kept = [k for k in range(FOLDS) if k != without]
        yes, every = self.yes[kept].sum(0), self.every[kept].sum(0)
        odds = np.log((yes + PRIOR_WEIGHT * share) / (every - yes + PRIOR_WEIGHT * (1 - share))) - np.log(share / (1 - share))
        return np.where(every > 0, odds, 0).astype(np.float32)


@dataclass
class Folds:
    """The fold of each text, and the odds that are its texts' inputs in training: those of the other folds, so that no text's own label is among them."""

    fold: np.ndarray
    odds: list[tuple[np.ndarray, np.ndarray]]

    def use(self, net: Network, k: int) -> None:
        net.word_odds, net.gram_odds = self.odds[k]


def _gathered(texts: pa.Array, label: np.ndarray, net: Network) -> tuple[Distinct, np.ndarray, Folds]:
    """The distinct words of all texts, slice by slice, each text's first word, and the folds; sets the network's odds to those of all texts."""
    fold = np.arange(len(label)) % FOLDS
    word_odds, gram_odds = _Odds(WORD_ROWS), _Odds(GRAM_ROWS)
    batch, at, slices_, counts = pa.RecordBatch.from_arrays([texts], ["text"]), 0, [], []
    for _, data, offsets in common.slices(batch, "text", SLICE):
        found, own = common.words(data, offsets, _IS_WORD), label[at : at + len(offsets) - 1]
        at += len(own)
        counts.append(np.diff(found.first))
        if not len(found.start):
            continue
        d = distinct_words(data, found)
        part = fold[at - len(own) : at]
        word_odds.add(d.row[d.which], found.doc, own, part)
        pairs = np.unique(found.doc * len(d.row) + d.which)  # each word once a document
        gram_odds.add(_grams_of(d, pairs % len(d.row)), np.repeat(pairs // len(d.row), np.diff(d.first)[pairs % len(d.row)]), own, part)
        slices_.append(d)
    share = float(np.clip(label.mean(), 0.01, 0.99))
    net.word_odds, net.gram_odds = word_odds.table(share), gram_odds.table(share)
    folds = Folds(fold, [(word_odds.table(share, k), gram_odds.table(share, k)) for k in range(FOLDS)])
    names = np.unique(np.concatenate([d.name for d in slices_])) if slices_ else np.zeros(0, np.uint64)
    number, which, rows, grams, many, n = np.full(len(names), -1), [], [], [], [], 0
    for d in slices_:
        place = np.searchsorted(names, d.name)
        new = np.flatnonzero(number[place] < 0)
        number[place[new]] = n + np.arange(len(new))
        n += len(new)
        which.append(number[place][d.which].astype(np.int32))
        rows.append(d.row[new])
        grams.append(_grams_of(d, new).astype(np.int32))
        many.append(np.diff(d.first)[new])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Distinct(joined(which), names, joined(rows), joined(grams), np.concatenate([[0], np.cumsum(joined(many))])), np.concatenate([[0], np.cumsum(joined(counts))]), folds


def train(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> Network:
    """Fit on whole texts with document labels: in each round the windows that now score worst stand for their document."""
    net, rng = Network(seed), np.random.default_rng(seed)
    label = labels.astype(np.float32)
    d, first, folds = _gathered(texts, label, net) if len(label) else (None, None, None)
    if d is None or not len(d.which) or not 0 < label.mean() < 1:
        net.dense["o"][:] = 0  # one class alone: its share for every text
        net.dense["c"][0] = np.log((label.sum() + 1) / (len(label) - label.sum() + 9))
        return net
    whole = net.word_odds, net.gram_odds
    start, size, doc = windows(first)
    part = folds.fold[doc]
    blank, memory, step = len(d.row), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}, 0
    for number, epochs in enumerate(EPOCHS):
        worst = np.zeros(len(doc), np.float32)
        for k in range(FOLDS):
            folds.use(net, k)
            some = np.flatnonzero(part == k)
            if number:
                worst[some] = window_scores(net, d, start[some], size[some])
            else:
                odds = net.inputs(d)[:, 2 * EMBED + 1]
                odds[blank] = -np.inf
                for lo in range(0, len(some), BLOCK):
                    own = some[lo : lo + BLOCK]
                    worst[own] = odds[_indices(start[own], size[own], d.which, blank)[0]].max(0)
        order = np.lexsort((-worst, doc))
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        chosen = order[(rank < 1) | ((label[doc[order]] == 0) & ((rank < 2) | (rng.random(len(doc)) < 0.03)))]
        batches = max(1, len(chosen) // (256 * FOLDS))
        for _ in range(max(epochs, -(-LEAST_STEPS // (batches * FOLDS)))):
            dealt = [(k, batch) for k in range(FOLDS) for batch in np.array_split(rng.permutation(chosen[part[chosen] == k]), batches) if len(batch)]
            for at in rng.permutation(len(dealt)):
                k, batch = dealt[at]
                folds.use(net, k)
                index, mask = _indices(start[batch], size[batch], d.which, blank)
                own, local = np.unique(index, return_inverse=True)
                x = _some_inputs(net, d, own)
                dense, rows = net.gradients(x, local.reshape(index.shape), mask, label[doc[batch]])
                step += 1
                for name, g in dense.items():
                    m, v = memory[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.dense[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                real = own < blank
                net.word -= RATE * _sums(d.row[own[real]], rows[real, :EMBED], WORD_ROWS)
                many = np.diff(d.first)[own[real]]
                share = rows[real, EMBED : 2 * EMBED] / np.maximum(many, 1)[:, None]
                net.gram -= RATE * _sums(_grams_of(d, own[real]), np.repeat(share, many, axis=0), GRAM_ROWS)
    net.word_odds, net.gram_odds = whole
    return net


def _grams_of(d: Distinct, word: np.ndarray) -> np.ndarray:
    """The n-gram rows of the given distinct words, end to end."""
    many = np.diff(d.first)[word]
    return d.gram[np.arange(int(many.sum())) + np.repeat(d.first[:-1][word] - np.cumsum(many) + many, many)]


def _some_inputs(net: Network, d: Distinct, own: np.ndarray) -> np.ndarray:
    real = own[own < len(d.row)]
    first = np.concatenate([[0], np.cumsum(np.diff(d.first)[real])])
    return net.inputs(Distinct(d.which, d.name, d.row[real], _grams_of(d, real), first))[: len(own)]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """(text, label): labelled rows that aren't held out, by the order of a hash of doc_id.

    At most ``rows`` rows and ``most_bytes`` bytes of text, long and short ones alike; null texts count
    as empty.  A doc_id with several labels has the largest; repeated rows each count.
    """
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    ids = ids.filter(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(modulus)) != held)
    ids = ids.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    labelled = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")  # broadcast: at most ``rows`` ids
    return common.sample(labelled, [F.xxhash64("_id"), F.col("_id")], rows, most_bytes).select(["text", "label"])


def score_toxicity(df: DataFrame, net: Network, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``df`` with the probability that ``text`` is toxic in ``into`` (replaced if there).

    Every word of a whole text is in a window of ``WINDOW`` words, ``STRIDE`` apart, and the worst
    window counts.  Null and empty texts, and texts without words, score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # of fixed size
    rows = common.carried(df, text, [into])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, text):
                found = common.words(data, offsets, _IS_WORD)
                score = np.zeros(len(offsets) - 1)
                if len(found.start):
                    start, size, doc = windows(found.first)
                    np.maximum.at(score, doc, window_scores(shared.value, distinct_words(data, found), start, size).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1))], ["row", "score"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != into], F.col("score").alias(into))


def fitted(documents: DataFrame, labels: DataFrame) -> Network:
    """A network from labels.toxic, without rows whose crc32 of doc_id is divisible by 5."""
    sample = labelled_sample(documents, labels, "toxic", 5, 0)
    return train(sample["text"].combine_chunks().cast(pa.large_binary()) if sample.num_rows else pa.array([], pa.large_binary()), sample["label"].to_numpy())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    net = fitted(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = score_toxicity(documents, net, into="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
