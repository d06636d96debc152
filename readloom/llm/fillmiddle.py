"""Fill-in-the-middle: a text is cut in three at two drawn places, and the middle goes last.

A text is laid out in blocks of ``BLOCK`` bytes.  A Fenwick tree over its blocks holds how many
units and how many code points begin in each.  A drawn place is a number of units: a descent by
halving steps finds the block in which that unit begins and the code points before it, and the
boundary itself is then looked for in that block alone.  The trees of all texts of a slice lie in
one array, and all their places go down together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

BLOCK = 256
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
_POINTS = common.table_of(lambda b: b & 0xC0 != 0x80)
_SOLID = common.table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit: a code point; a word with the white space after it; a line with its newline."""
    if unit == "char":
        return _POINTS[data]
    starts = np.zeros(len(data), bool)
    if unit == "line":
        starts[1:] = data[:-1] == 0x0A
    elif unit == "word":
        solid = _SOLID[data]
        starts[1:] = solid[1:] & ~solid[:-1]
        # white space before the first word belongs to that word
        inside = np.flatnonzero(starts | np.isin(np.arange(len(data)), offsets[:-1]) & solid)
        text = np.searchsorted(offsets, inside, "right") - 1
        starts[inside[np.unique(text, return_index=True)[1]]] = False
    else:
        raise ValueError(f"no unit is called {unit}")
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return starts


class Fenwick:
    """One tree over the blocks of each text: units and code points that begin in them."""

    def __init__(self, units: np.ndarray, points: np.ndarray, offsets: np.ndarray):
        self.size = -(-np.diff(offsets) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        text = np.repeat(np.arange(len(self.size)), self.size)
        local = np.arange(self.first[-1]) - self.first[text]
        begin = offsets[text] + local * BLOCK
        place = local + 1
        low = place & -place
        upto = np.arange(1, self.first[-1] + 1)
        trees = []
        for marks in (units, points):
            sums = np.concatenate([[0], np.cumsum(np.add.reduceat(marks.astype(np.int64), begin))]) if len(begin) else np.zeros(1, np.int64)
            trees.append(sums[upto] - sums[upto - low])
        self.units, self.points = trees

    def total(self) -> np.ndarray:
        """Units of each text: down from its last block by lowest bits."""
        left, out = self.size.copy(), np.zeros(len(self.size), np.int64)
        while (some := np.flatnonzero(left)).size:
            out[some] += self.units[self.first[some] + left[some] - 1]
            left[some] &= left[some] - 1
        return out

    def descend(self, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the unit with this number (from 0): whole blocks before it, units still to go in its block, code points in those blocks."""
        block, left, points = np.zeros(len(text), np.int64), number.copy(), np.zeros(len(text), np.int64)
        step = 1 << int(self.size.max(initial=0)).bit_length()
        while step := step >> 1:
            at = block + step
            some = np.flatnonzero(at <= self.size[text])
            some = some[self.units[self.first[text[some]] + at[some] - 1] <= left[some]]
            node = self.first[text[some]] + at[some] - 1
            block[some] = at[some]
            left[some] -= self.units[node]
            points[some] += self.points[node]
        return block, left, points


def places(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, tree: Fenwick, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte place where the unit with this number begins (the text's end, if there are only so many), and code points before it."""
    block, left, points = tree.descend(text, number)
    place, end = offsets[text] + block * BLOCK, offsets[text + 1]
    some = np.flatnonzero(place < end)
    window = place[some, None] + np.arange(BLOCK)
    within = window < end[some, None]
    window[~within] = 0
    begins = starts[window] & within
    step = np.argmax(np.cumsum(begins, 1) == left[some, None] + 1, 1)
    before = np.arange(BLOCK) < step[:, None]
    points[some] += (_POINTS[data[window]] & within & before).sum(1)
    place[some] += step
    return np.minimum(place, end), points


def _draws(doc_id: str, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels that could begin or end within one another would not be found again for certain."""
    marks = [x.encode() for x in sentinels]
    for a in marks:
        for b in marks:
            if not a or a is not b and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {sentinels}")


def fill_in_middle(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "output", unit: str = "char", seed: int = 1, rate: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """The rows of ``df`` with n, form, prefix_chars and middle_chars, and the rearranged text in ``into``.

    A text has n units (``unit``: char, a code point; word; line).  Four numbers come from the SHA-256
    of ``seed``:``doc_id``.  The prefix ends after the smaller of the first two modulo n + 1 units, the
    middle after the larger.  ``rate`` of 100 texts are rearranged (by the third number), and of those
    ``suffix_first`` of 100 as suffix, prefix, middle (spm, by the fourth), the others as prefix, suffix,
    middle (psm), each part behind its sentinel.  A text that is empty or holds a sentinel stays as it
    is (plain, prefix_chars and middle_chars null), so ``restored`` always finds the text again.

    Null texts are empty; a null doc_id is an empty string in the hash; rows that repeat a doc_id are
    cut by the same numbers, each to its own length.  Columns already called as the new ones are
    replaced; ``into`` may be ``text`` itself.  An empty table gives an empty table.
    """
    _check(sentinels)
    own = [into, "n", "form", "prefix_chars", "middle_chars"]
    others = [c for c in df.columns if c not in own and c != text]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").alias("_text"), _draws(doc_id, seed).alias("_draws"))
    before, after, between = (x.encode() for x in sentinels)
    keeps = into != text and text not in own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "_text"):
                n_texts = len(offsets) - 1
                starts = unit_starts(data, offsets, unit)
                tree = Fenwick(starts, _POINTS[data], offsets)
                n = tree.total()
                draws = part.column(2).flatten().to_numpy().reshape(n_texts, 4)
                cuts = np.sort(draws[:, :2] % (n + 1)[:, None], 1)
                each = np.arange(n_texts)
                one, chars = places(data, offsets, starts, tree, each, cuts[:, 0])
                two, chars_two = places(data, offsets, starts, tree, each, cuts[:, 1])
                body, forms, plain = [], [], np.zeros(n_texts, bool)
                for i in range(n_texts):
                    whole = data[offsets[i] : offsets[i + 1]].tobytes()
                    plain[i] = not whole or draws[i, 2] % 100 >= rate or any(x in whole for x in (before, after, between))
                    a, b = int(one[i] - offsets[i]), int(two[i] - offsets[i])
                    if plain[i]:
                        forms.append("plain")
                        body.append(whole)
                    elif draws[i, 3] % 100 < suffix_first:
                        forms.append("spm")
                        body.append(b"".join((after, whole[b:], before, whole[:a], between, whole[a:b])))
                    else:
                        forms.append("psm")
                        body.append(b"".join((before, whole[:a], after, whole[b:], between, whole[a:b])))
                out = [part.column(0), pa.array(body, pa.binary()).cast(pa.string()), pa.array(n), pa.array(forms), pa.array(chars, mask=plain), pa.array(chars_two - chars, mask=plain)]
                names = ["_row", "_into", *own[1:]]
                yield pa.RecordBatch.from_arrays([*out, part.column(1)] if keeps else out, [*names, "_text"] if keeps else names)

    long = T.LongType()
    fields = [rows.schema["_row"], T.StructField("_into", T.StringType()), T.StructField("n", long), T.StructField("form", T.StringType()), T.StructField("prefix_chars", long), T.StructField("middle_chars", long)]
    made = rows.mapInArrow(run, T.StructType([*fields, rows.schema["_text"]] if keeps else fields))
    source = {text: F.col("_text")} if keeps else {}
    return made.select(*[source.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns if c not in own and (c != text or keeps)], F.col("_into").alias(into), *own[1:])


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a rearranged one was made of: its parts end at the first of the sentinel that follows."""
    before, after, between = sentinels
    whole = F.col(f"`{output}`")

    def part(text: Column, mark: str, number: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(number))

    tail = part(whole, after, 2)
    psm = F.concat(F.substr(part(whole, after, 1), F.lit(len(before) + 1)), part(tail, between, 2), part(tail, between, 1))
    head = F.substr(part(whole, before, 1), F.lit(len(after) + 1))
    rest = part(whole, before, 2)
    spm = F.concat(part(rest, between, 1), part(rest, between, 2), head)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.documents(spark, sf_dir).select("doc_id", "text"), into="text")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(restored("text"), 256).alias("restored_sha256"))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(x, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS r4
  FROM drawn
), parts AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain'
              WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), made AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM made
"""
