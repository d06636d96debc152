"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The rules' checked matches are the labelled spans that the network learns from, on a bounded
sample.  In scoring, every character of every text is in a window; windows overlap, each is
decoded by Viterbi, and the tags of a text are put together from the middles of its windows, so a
span may run through several.  Spans of the network that touch no rule's span are added to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    re.compile(r"[0-9](?:[ -]?[0-9])+"),
    re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
]
SAMPLE_ROWS = 3000  # texts that training takes at most
SAMPLE_BYTES = 16 << 20  # bytes of text that training takes at most, all texts together
HIDDEN, TAGS, SYMBOLS = 8, len(KINDS) + 1, 130  # the last symbol stands after a window's end
TRAIN_WINDOW, WINDOW, OVERLAP = 96, 256, 32
BATCH, EPOCHS, LEAST_STEPS = 128, 5, 250
BLOCK = 2048
SLICE = 1 << 19  # some windows more than a block
SHORTEST = 7
_STARTS = common.table_of(lambda b: b & 0xC0 != 0x80)
_SYMBOL = np.minimum(np.arange(256), 128).astype(np.uint8)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _accepted(kind: int, match: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    digits = "".join(c for c in match if c.isdigit())
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def rule_spans(text: str) -> list[Span]:
    """Checked matches by start, then kind; a match that fails its check is dropped without another try."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        if ("@" in text) if kind == 0 else ("+" in text) if kind == 3 else True:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _accepted(kind, m[0])]
    return sorted(out)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each character of a slice (ASCII, or 128), and the texts' offsets in characters."""
    lead = _STARTS[data]
    return _SYMBOL[data[lead]], np.concatenate([[0], np.cumsum(lead)])[offsets]


class Tagger:
    """Gates are rows, windows columns; tanh serves all gates, the sigmoid's halves are in the weights."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (0.3 * rng.normal(size=s)).astype(np.float32)
        self.p = {"T": np.zeros((TAGS, TAGS), np.float32), "e": np.zeros(TAGS, np.float32)}
        self.p["e"][0] = 1
        for k in "01":
            self.p |= {f"X{k}": draw(4 * HIDDEN, SYMBOLS), f"U{k}": draw(4 * HIDDEN, HIDDEN), f"O{k}": draw(TAGS, HIDDEN)}
            self.p[f"X{k}"][HIDDEN : 2 * HIDDEN] += 1  # remember at first

    def _run(self, index: np.ndarray, side: str, out: np.ndarray, keep: list | None) -> None:
        """Add one direction's part of the tag scores (steps x tags x windows)."""
        x, u, o = self.p[f"X{side}"], self.p[f"U{side}"], self.p[f"O{side}"]
        n = index.shape[1]
        h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
        g, room = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
        for t in range(len(index)) if side == "0" else range(len(index) - 1, -1, -1):
            np.take(x, index[t], 1, out=g, mode="clip")
            g += np.matmul(u, h, out=room)
            np.tanh(g, out=g)
            g[: 3 * HIDDEN] *= 0.5
            g[: 3 * HIDDEN] += 0.5
            i, f, y, z = (g[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            new = f * c
            new += i * z
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, g.copy(), s))
            c, h = new, y * s
            out[t] += o @ h

    def emissions(self, index: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        out = np.empty((len(index), TAGS, index.shape[1]), np.float32)
        out[:] = self.p["e"][:, None]
        for k in (0, 1):
            self._run(index, str(k), out, keep[k] if keep else None)
        return out

    def decode(self, index: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (steps x windows)."""
        e, trans = self.emissions(index), self.p["T"]
        back = np.empty(e.shape, np.uint8)
        score = e[0].copy()
        for t in range(1, len(e)):
            new = np.empty_like(score)
            for j in range(TAGS):
                best, where = score[0] + trans[0, j], back[t, j]
                where[:] = 0
                for i in range(1, TAGS):
                    other = score[i] + trans[i, j]
                    where[other > best] = i
                    np.maximum(best, other, out=best)
                new[j] = best
            score = new + e[t]
        tags = np.empty(index.shape, np.uint8)
        tags[-1] = score.argmax(0)
        columns = np.arange(index.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], columns]
        return tags

    def gradients(self, index: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags, and its slopes."""
        kept: tuple[list, list] = ([], [])
        e, trans, steps, n = self.emissions(index, kept), self.p["T"], len(index), index.shape[1]
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        summed = lambda x: (m := x.max(0)) + np.log(np.exp(x - m).sum(0))
        ahead[0] = e[0]
        for t in range(1, steps):
            ahead[t] = summed(ahead[t - 1][:, None] + trans[:, :, None]) + e[t]
        for t in range(steps - 1, 0, -1):
            behind[t - 1] = summed((trans[:, :, None] + (e[t] + behind[t])[None]).transpose(1, 0, 2))
        total = summed(ahead[-1])
        by_e = np.exp(ahead + behind - total)
        gold_score = np.take_along_axis(e, gold[:, None].astype(np.int64), 1).sum((0, 1)) + trans[gold[:-1], gold[1:]].sum(0)
        pairs = np.exp(ahead[:-1, :, None] + trans[None, :, :, None] + (e[1:] + behind[1:])[:, None] - total).sum((0, 3))
        seen = np.zeros((TAGS, TAGS), np.float32)
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        np.put_along_axis(by_e, gold[:, None].astype(np.int64), np.take_along_axis(by_e, gold[:, None].astype(np.int64), 1) - 1, 1)
        by_e /= n
        out = {"T": (pairs - seen) / n, "e": by_e.sum((0, 2))}
        for k in "01":
            u, o = self.p[f"U{k}"], self.p[f"O{k}"]
            by_x, by_u, by_o = np.zeros_like(self.p[f"X{k}"]), np.zeros_like(u), np.zeros_like(o)
            carried_h, carried_c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t, h, c, g, s in reversed(kept[int(k)]):
                i, f, y, z = (g[q * HIDDEN : (q + 1) * HIDDEN] for q in range(4))
                by_o += by_e[t] @ (y * s).T
                by_h = o.T @ by_e[t] + carried_h
                by_c = by_h * y * (1 - s * s) + carried_c
                gate = np.concatenate([2 * by_c * z * i * (1 - i), 2 * by_c * c * f * (1 - f), 2 * by_h * s * y * (1 - y), by_c * i * (1 - z * z)])
                by_u += gate @ h.T
                for row, values in zip(by_x, gate, strict=True):
                    row += np.bincount(index[t], values, SYMBOLS)
                carried_h, carried_c = u.T @ gate, by_c * f
            out |= {f"X{k}": by_x, f"U{k}": by_u, f"O{k}": by_o}
        return float((total - gold_score).mean()), out


def train(texts: list[str], seed: int = 1, epochs: int = EPOCHS) -> Tagger:
    """Fit on windows about the rules' spans and on others, from whole texts."""
    net, rng = Tagger(seed), np.random.default_rng(seed)
    index, gold = [], []
    for text in texts:
        own = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128).astype(np.int64)
        tags = np.zeros(len(own), np.int64)
        spans = rule_spans(text)
        for start, kind, end in reversed(spans):
            tags[start:end] = kind + 1
        middles = [(a + b) // 2 for a, _, b in spans for _ in range(2)] + ([int(rng.integers(len(own)))] if len(own) else [])
        for middle in middles:
            at = int(middle - rng.integers(TRAIN_WINDOW))
            x, y = np.full(TRAIN_WINDOW, SYMBOLS - 1), np.zeros(TRAIN_WINDOW, np.int64)
            lo, hi = max(0, at), min(len(own), at + TRAIN_WINDOW)
            x[: hi - lo], y[: hi - lo] = own[lo:hi], tags[lo:hi]
            index.append(x)
            gold.append(y)
    if not index:
        return net
    index, gold = np.array(index).T, np.array(gold).T
    memory, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    batches = max(1, index.shape[1] // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // batches)) if epochs else 0):
        for batch in np.array_split(rng.permutation(index.shape[1]), batches):
            step += 1
            for k, g in net.gradients(index[:, batch], gold[:, batch])[1].items():
                m, v = memory[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def network_tags(net: Tagger, own: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A tag for each character of a slice: windows of each text overlap, and of two that hold a character the one in whose middle it is decides."""
    size, step = np.diff(ends), WINDOW - OVERLAP
    many = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // step)) + 1, 0)
    doc = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = ends[doc] + number * step
    length = np.minimum(WINDOW, ends[doc + 1] - start)
    lo = np.where(number > 0, OVERLAP // 2, 0)
    hi = np.where(number < many[doc] - 1, WINDOW - OVERLAP // 2, length)
    out = np.zeros(len(own), np.uint8)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        place = np.arange(int(length[rows[0]]))[:, None]
        inside = place < length[rows]
        index = np.where(inside, own[np.minimum(start[rows] + place, len(own) - 1)], SYMBOLS - 1)
        tags = net.decode(index)
        keep = (place >= lo[rows]) & (place < hi[rows])
        out[(start[rows] + place)[keep]] = tags[keep]
    return out


def runs(tags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end (in the document) and tag of each maximal run of one tag but 0."""
    edge = np.concatenate([[True], tags[1:] != tags[:-1]]) if len(tags) else np.zeros(0, bool)
    edge[ends[:-1][ends[:-1] < len(tags)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(tags))[: len(start)]
    some = tags[start] > 0
    start, end = start[some], end[some]
    doc = np.searchsorted(ends, start, "right") - 1
    return doc, start - ends[doc], end - ends[doc], tags[start]


def _added(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    """The network's spans, without white space or closing stops at their ends, that touch no rule's span and hold a digit or an @."""
    out = []
    for start, kind, end in found:
        while end > start and text[end - 1] in " \n\t.,;:":
            end -= 1
        while start < end and text[start] in " \n\t.,;:":
            start += 1
        body = text[start:end]
        if end - start >= SHORTEST and any(c == "@" or "0" <= c <= "9" for c in body) and all(b <= start or a >= end for a, _, b in base):
            out.append((start, kind, end))
    return out


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fitted(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Tagger:
    """A tagger from at most ``rows`` texts and ``most_bytes`` bytes, most of them with digits or an @, by the order of a hash of doc_id.

    Rows without a doc_id or a text aren't learned from; repeated rows each count.
    """
    plain = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).dropna()
    marked, order, texts = F.col("text").rlike("[0-9@]"), [F.xxhash64("_id"), F.col("_id")], []
    for some, share in ((marked, 5), (~marked, 1)):
        texts += common.sample(plain.filter(some), order, rows * share // 6, most_bytes * share // 6)["text"].to_pylist()
    return train(texts)


def find_personal_data(df: DataFrame, net: Tagger, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): one row a row of ``df``; spans are kind:start:end, comma-joined, by start and then kind.

    Offsets count characters, ends are exclusive.  base holds the rules' spans alone, spans those
    and the network's.  Null and empty texts have none; rows may repeat; a null doc_id stays null.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text", SLICE):
                own, ends = symbols(data, offsets)
                doc, start, end, tag = runs(network_tags(shared.value, own.astype(np.int64), ends), ends)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                digit = (own >= 48) & (own <= 57) | (own == 64)
                marked = np.diff(np.concatenate([[0], np.cumsum(digit)])[ends]) > 0
                base, every = [], []
                for i in range(len(offsets) - 1):
                    if not marked[i]:  # no rule and no added span can do without a digit or an @
                        base.append("")
                        every.append("")
                        continue
                    body = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    mine = rule_spans(body)
                    found = [(int(start[r]), int(tag[r]) - 1, int(end[r])) for r in range(first[i], first[i + 1])]
                    base.append(_named(mine))
                    every.append(_named(sorted(mine + _added(body, found, mine))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "base", "spans"])

    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.documents(spark, sf_dir).select("doc_id", "text")
    found = find_personal_data(documents, fitted(documents))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
