"""SentencePiece encoding and decoding by streaming Viterbi over a given piece vocabulary.

A text is a space, then its bytes; pieces are byte strings with a space for the meta symbol.  The
best path has the largest sum of piece scores, the longest last piece at ties.  The search holds
open only the nodes that a piece can still reach, and commits ids whenever the backpointer paths of
all open nodes meet in one boundary.  No piece that can win holds a space but at its start, so they
always meet before a space, and ids are committed there: ``search`` runs the windows between two such
boundaries side by side, each distinct one once.  In a longer stretch ``stream`` looks for the
boundaries in the backpointers.  Pieces are followed byte by byte in a trie, so what is found is equal.
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

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
HOPELESS = -1e8
SHORT = 40  # bytes of a stretch that is searched as one window
CACHE = 1 << 18
SLICE = 1 << 19
_STARTS = common.table_of(lambda b: b & 0xC0 != 0x80)


@dataclass
class Vocabulary:
    """Pieces as bytes, with scores; ``fallback`` maps a byte to the id of its piece."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray  # ids that a search may use
    fallback: np.ndarray
    table: dict[bytes, tuple[float, int]] = field(default_factory=dict)
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the trie: node * 256 + byte, sorted
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # node of a byte, -1 if none
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # id of the piece that ends in a node, -1 if none
    unknown: float = 0.0  # what a character costs that no piece has
    longest: int = 0


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file with byte pieces, of at most a few hundred thousand pieces.

    Pieces of hopeless score (runs of meta symbols) are only decoded: their parts score better.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, fallback, normal = [], np.zeros(256, np.int64), []
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            fallback[int(name[1:-1], 16)] = i
            pieces.append(bytes([int(name[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.replace("▁", " ").encode())
            if model.get_score(i) > HOPELESS:
                normal.append(i)
    return prepared(Vocabulary(pieces, np.array([model.get_score(i) for i in range(model.vocab_size())]), np.array(normal), fallback))


def prepared(v: Vocabulary) -> Vocabulary:
    v.unknown = float(v.scores[v.normal].min()) - UNKNOWN_PENALTY
    v.longest = max(len(v.pieces[i]) for i in v.normal)
    for i in v.normal:
        if b" " in v.pieces[i][1:]:
            raise ValueError(f"piece {i} has a space inside")
        v.table.setdefault(v.pieces[i], (float(v.scores[i]), int(i)))
    ends, edges = [-1], {}
    for name in sorted(v.table):
        node = 0
        for byte in name:
            if (to := edges.get(node * 256 + byte)) is None:
                to = edges[node * 256 + byte] = len(ends)
                ends.append(-1)
            node = to
        ends[node] = v.table[name][1]
    v.edges = np.array(sorted(edges), np.int64)
    v.child, v.ends = np.array([edges[e] for e in v.edges.tolist()], np.int64), np.array(ends)
    v.first = np.array([edges.get(byte, -1) for byte in range(256)])
    return v


def stream(v: Vocabulary, text: bytes) -> Iterator[list[int]]:
    """Ids of a text (its leading space included), as soon as they are certain."""
    longest, unknown = v.longest, v.unknown
    score, back = {0: 0.0}, {}  # of open nodes, by end; node: (start, id or -1)
    committed, position = 0, 0
    while position < len(text):
        end = position + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        best, node = score[position] + unknown, (position, -1)
        for start in range(max(0, end - longest), end):
            piece = v.table.get(text[start:end]) if start in score else None
            if piece and score[start] + piece[0] > best:
                best, node = score[start] + piece[0], (start, piece[1])
        score[end], back[end] = best, node
        position = end
        for old in [k for k in score if k <= end - longest and k != end]:
            del score[old]
        if end - committed >= 4 * longest:
            paths = set(score)
            while len(paths) > 1:
                last = max(paths)
                paths.remove(last)
                paths.add(back[last][0] if last > committed else committed)
            meet = paths.pop()
            if meet > committed:
                yield _path(v, text, back, committed, meet)
                for old in [k for k in back if k <= meet]:
                    del back[old]
                committed = meet
    if position > committed:
        yield _path(v, text, back, committed, position)


def _path(v: Vocabulary, text: bytes, back: dict, begin: int, end: int) -> list[int]:
    out: list[int] = []
    while end > begin:
        start, piece = back[end]
        out.extend([piece] if piece >= 0 else [int(v.fallback[b]) for b in reversed(text[start:end])])
        end = start
    return out[::-1]


def search(v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of each short stretch, end to end, and how many each has."""
    order = np.argsort(-length, kind="stable")
    n, most = len(order), int(length.max(initial=0))
    at, size = start[order], length[order]
    lead = np.append(_STARTS[data], True)
    score = np.full((most + 1, n), -np.inf)
    score[0] = 0
    source = np.zeros((most + 1, n), np.int32)
    piece = np.full((most + 1, n), -1, np.int32)
    for begin in range(most):
        live = int(np.searchsorted(-size, -begin, "left"))
        open_ = np.flatnonzero(score[begin, :live] > -np.inf)
        rows, node, width = open_, np.zeros(len(open_), np.int64), 0
        while len(rows):  # as far as a piece goes on
            byte = data[at[rows] + begin + width].astype(np.int64)
            if width:
                edge = node * 256 + byte
                place = np.minimum(np.searchsorted(v.edges, edge), len(v.edges) - 1)
                known, node = v.edges[place] == edge, v.child[place]
            else:
                node = v.first[byte]
                known = node >= 0
            rows, node, width = rows[known], node[known], width + 1
            full = v.ends[node] >= 0
            good, ids = rows[full], v.ends[node[full]]
            new = score[begin, good] + v.scores[ids]
            better = new > score[begin + width, good]
            good = good[better]
            score[begin + width, good], source[begin + width, good], piece[begin + width, good] = new[better], begin, ids[better]
            more = size[rows] > begin + width
            rows, node = rows[more], node[more]
        # the character alone, in bytes, if nothing else does better
        end = np.full(len(open_), begin + 1)
        while (inside := ~lead[at[open_] + end] & (end < size[open_])).any():
            end[inside] += 1
        new = score[begin, open_] + v.unknown
        better = new > score[end, open_]
        score[end[better], open_[better]], source[end[better], open_[better]], piece[end[better], open_[better]] = new[better], begin, -1
    row, end, steps = np.arange(n), size.copy(), []
    while len(row):
        begin, ids = source[end, row].astype(np.int64), piece[end, row]
        steps.append((row, begin, end, ids))
        more = begin > 0
        row, end = row[more], begin[more]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    row, begin, end, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
    by = np.lexsort((begin, order[row]))
    row, begin, end, ids = row[by], begin[by], end[by], ids[by]
    many = np.where(ids < 0, end - begin, 1)
    out = np.repeat(ids, many)
    byte = np.flatnonzero(out < 0)
    where = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[row] + begin, many)
    out[byte] = v.fallback[data[where[byte]]]
    counts = np.zeros(n, np.int64)
    np.add.at(counts, order[row], many)
    return out.astype(np.int32), counts


class Encoder:
    """Encodes slices, and remembers a bounded number of stretches by their bytes."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their offsets."""
        n, size = len(offsets) - 1, np.diff(offsets)
        filled = size > 0
        shift = np.cumsum(filled)
        text = np.full(len(data) + int(filled.sum()), 0x20, np.uint8)
        text[np.arange(len(data)) + np.repeat(shift, size)] = data
        begins = offsets + np.concatenate([[0], shift])
        start = np.flatnonzero(text == 0x20)
        end = np.append(start[1:], len(text))[: len(start)]
        doc = np.searchsorted(begins, start, "right") - 1
        hashes = common.Rolling(text).of(start, end)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        odd = np.flatnonzero(~common.same_bytes(text, start, end, text, start[first[which]], end[first[which]]))
        which[odd] = len(first) + np.arange(len(odd))  # of equal hash but other bytes: each by itself
        first = np.concatenate([first, odd])
        if len(self.known) > CACHE:
            self.forget()
        body = text.tobytes()
        names = [body[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        place = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            a, b = start[first[new]], end[first[new]]
            short = b - a <= SHORT
            ids, counts = search(self.v, text, a[short], (b - a)[short])
            long = [np.array([i for part in stream(self.v, text[x:y].tobytes()) for i in part], np.int32) for x, y in zip(a[~short], b[~short], strict=True)]
            base = len(self.offsets) - 1
            ends = np.cumsum(np.concatenate([counts, [len(x) for x in long]]).astype(np.int64)) + self.offsets[-1]
            self.flat = np.concatenate([self.flat, ids, *long])
            self.offsets = np.concatenate([self.offsets, ends])
            at = np.empty(len(new), np.int64)
            at[short], at[~short] = base + np.arange(int(short.sum())), base + int(short.sum()) + np.arange(len(long))
            place[new] = at
            self.known.update(zip((names[k] for k in new), at.tolist(), strict=True))
        row = place[which]
        many = self.offsets[row + 1] - self.offsets[row]
        total = np.cumsum(many)
        take = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.offsets[row] - total + many, many)
        return self.flat[take], np.concatenate([[0], total])[np.searchsorted(doc, np.arange(n + 1))]


class Decoder:
    def __init__(self, v: Vocabulary):
        self.data, self.offsets = common.flat(pa.array(v.pieces, pa.large_binary()))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of lists of ids; the leading space of a text that has ids goes."""
        many = np.diff(self.offsets)[ids]
        total = np.concatenate([[0], np.cumsum(many)])
        out = self.data[np.arange(int(total[-1])) + np.repeat(self.offsets[ids] - total[:-1], many)]
        ends = total[first]
        return pa.array([out[a + 1 : b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()).cast(pa.string())


def encode(df: DataFrame, text: str = "text", into: str = "ids", decoded: str | None = None, path: str = MODEL) -> DataFrame:
    """``df`` with the piece ids of ``text`` in ``into`` (replaced if there), an array of int.

    ``decoded`` names a column for the text that those ids decode to, in the same pass.

    A null or empty text has no ids.  Characters that no piece has become byte pieces, so do meta
    symbols in the text, and decoding gives each text back exactly.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))  # the size of a vocabulary, not of the data
    made = [into, *([decoded] if decoded else [])]
    kept = [c for c in df.columns if c not in made]
    rows = common.carried(df, text, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for part, data, offsets in common.slices(batch, text, SLICE):
                ids, first = encoder.encode(data, offsets)
                back = [decoder.decode(ids, first)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), common.lists(ids, first, pa.int32()), *back], ["row", "ids", "decoded"][: 2 + len(back)])

    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    out = rows.mapInArrow(run, T.StructType(fields[: 1 + len(made)]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[F.col(x).alias(c) for x, c in zip(("ids", "decoded"), made, strict=False)])


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str = MODEL) -> DataFrame:
    """``df`` with the text of the piece ids in ``into`` (replaced if there); null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != into]).alias("row"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                first = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), decoder.decode(ids, first)], ["row", "text"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != into], F.col("text").alias(into))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, exact): exact says whether decoding gave the text back."""
    texts = common.documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    back = encode(texts, decoded="decoded", path=path).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("exact"))
