import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from readloom.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, most):
    model = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), most)):
            part = np.array(ids[at : at + most], "<u4").tobytes()
            out.append((i, k, at, len(part) // 4, zlib.crc32(part)))
    return sorted(out, key=str)


def gapless(rows, most):
    """Rows (length, sequence_id, offset): no gap, no overlap, no sequence over ``most``."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= most
    return len(by)


def texts():
    rng = random.Random(4)
    pool = ["Hello", "don't", "naïve", "ÉTÉ", "日本語", "é", "́x", "a.b,c", "12345", "😀😀", "\t", "\x0b", "　", " ", " ", "<|endoftext|>", "x<|startoftext|>y", "'s", "’ll", "İ", "ΑΣ", "ﬁ", "한", "ᄒ", "ᅡ", "\x00", "q" * 300]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["", " ", "  ", "\n", " \n"]) for _ in range(rng.randrange(80)))) for i in range(150)]
    return [*rows, (400, None), (401, ""), (402, " \n "), (403, "many words of one text " * 3000), (1, "again"), (None, "no id")]


@pytest.mark.parametrize("most", [2048, 64])
def test_pieces_and_sequences(spark, most):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.pieces(df, most=most).withColumn("crc", F.crc32("ids"))
    packed = packing.pack(cut, most)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got), key=str) == brute(rows, most)
    n = gapless([(r.length, r.sequence_id, r.offset) for r in got], most)
    assert n <= 1.02 * sum(r.length for r in got) / most + 2
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert len(whole) == n
    for r in got:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = packing.op13_packing(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute(rows, 2048)
    assert gapless([(r.length, r.sequence_id, r.offset) for r in got], 2048) <= -(-sum(r.length for r in got) // 2048) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'sT.,<|> \n\té\u0301\u0338=1日İ😀\u00a0\u3000", max_size=30), min_size=1, max_size=5))
def test_parts_give_the_ids_of_whole_texts(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    with open(PATH, encoding="utf-8") as file:
        encoder = packing._encoder(file.read())
    ids, first = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, 0)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*encoder.model.encode(t, add_special_tokens=False).ids, 0]


def test_another_tokenizer_and_a_full_memory(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = packing.pieces(spark.createDataFrame(texts()[:40], "doc_id long, text string"), tokenizer=path, most=10**6, end=50256).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: [*model.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in texts()[:40]}
    monkeypatch.setattr(packing, "CACHED", 3)
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for text in ("one two three four five", "six one two", "", "three, four"):
        raw = text.encode()
        assert encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0)[0].tolist() == [*encoder.model.encode(text, add_special_tokens=False).ids, 0]


def exact(lengths, most):
    """Fewest sequences, by trying all ways."""
    best = len(lengths)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= most and bins[i] not in bins[:i]:
                go(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        go(left[1:], [*bins, left[0]])

    go(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_few_pieces_against_all_ways(lengths):
    counts = np.bincount(lengths, minlength=31)
    made = packing.plan(counts, 30)
    used = np.zeros(31, int)
    for chosen, times in made.configurations:
        assert sum(k * n for k, n in chosen) <= 30
        for k, n in chosen:
            used[k] += n * times
    assert (used == counts).all()
    assert made.sequences <= exact(lengths, 30) + 1


def test_fractions_cover_and_stay_near_the_bound():
    counts = np.zeros(2049, np.int64)
    rng = np.random.default_rng(1)
    np.add.at(counts, rng.integers(1, 2048, 20_000), 1)
    share = packing.fractions(counts, 2048)
    cover = np.zeros(2049)
    for chosen, x in share.items():
        assert sum(k * n for k, n in chosen) <= 2048
        for k, n in chosen:
            cover[k] += n * x
    assert (cover >= counts * (1 - 1e-6)).all()
    bound = max(counts @ np.arange(2049) / 2048, counts[1025:].sum())
    assert sum(share.values()) <= 1.02 * bound
    assert packing.plan(counts).sequences <= 1.02 * bound + 1


def test_a_hot_length_and_huge_counts():
    counts = np.zeros(2049, np.int64)
    counts[[700, 682, 1366, 2048, 1]] = [10**12, 10**12, 10**9, 10**12, 5]
    made = packing.plan(counts)
    bound = -(-int(counts @ np.arange(2049)) // 2048)
    assert bound <= made.sequences and made.sequences - 10**12 <= 10**12 // 2 + 10**12 // 3 + 10**9 and len(made.configurations) < 10_000


def test_hot_lengths_extra_columns_and_odd_tables(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 128 + 1).cast("long").alias("length"), F.lit("x").alias("offset"), F.lit("y").alias("_row"))
    got = packing.pack(df, 128)
    assert got.columns == ["id", "length", "_row", "sequence_id", "offset"]
    rows = got.collect()
    assert len({r.id for r in rows}) == 3000
    gapless([(r.length, r.sequence_id, r.offset) for r in rows], 128)
    assert packing.pack(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, 5), (1, 5), (1, 5)], "id long, length long")
    assert gapless([(r.length, r.sequence_id, r.offset) for r in packing.pack(same, 16).collect()], 16) == 1
    for bad in (None, 0, 17):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "id long, length long"), 16)
    none = spark.createDataFrame([], "doc_id long, text string, length string")
    assert packing.pack(packing.pieces(none)).count() == 0
