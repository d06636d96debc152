import random

import numpy as np
import pytest

from readloom.llm import common, pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def brute(v, text):
    """Viterbi over the whole text at once."""
    body = b" " + text.encode() if text else b""
    edges = [i for i in range(len(body) + 1) if i == len(body) or body[i] & 0xC0 != 0x80]
    best, back = {0: 0.0}, {}
    for k, end in enumerate(edges[1:]):
        best[end], back[end] = best[edges[k]] + v.unknown, (edges[k], -1)
        for start in edges[: k + 1]:
            piece = v.table.get(body[start:end]) if end - start <= v.longest else None
            if piece and best[start] + piece[0] > best[end]:
                best[end], back[end] = best[start] + piece[0], (start, piece[1])
    out, end = [], len(body)
    while end:
        start, i = back[end]
        out += [i] if i >= 0 else [int(v.fallback[b]) for b in reversed(body[start:end])]
        end = start
    return out[::-1]


def texts(rng):
    words = ["the", "Theaing", "ciónadoja", "日本語", "▁", "▁x", "\n", "\t", "", "a" * 70, "ß" * 50, "🙂", "x@y.z", "0123456789"]
    out = [None, "", " ", "  a  b ", "é", "\n"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["zq" * 900]


def test_equal_to_whole_text_search(spark, vocabulary):
    rows = [(i, t, 7) for i, t in enumerate(texts(random.Random(2)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = pieces.encode(df)
    got = {r.doc_id: r for r in pieces.decode(coded).collect()}
    for i, t, _ in rows:
        assert got[i].ids == brute(vocabulary, t or ""), (i, t)
        assert got[i].decoded == (t or "")


def test_equal_only_if_the_bytes_are(spark, vocabulary, monkeypatch):
    """Texts whose rolling hashes agree modulo a power of two, with and without the cache between them."""
    words = []
    for k in (10, 11, 12):
        one = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        words += [one, one.translate(str.maketrans("ab", "ba"))]
    rows = [*enumerate(words), (6, " ".join(words))]
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), decoded="back").collect()}
    for i, t in rows:
        assert got[i].back == t
        assert got[i].ids == brute(vocabulary, t)
    monkeypatch.setattr(common, "mixed", lambda x: x & np.uint64(3))  # nearly all hashes collide
    encoder = pieces.Encoder(vocabulary)
    for text in ("one two three four five six", "one seven two"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == brute(vocabulary, text)


def test_null_ids_and_repeated_rows(spark):
    got = pieces.decode(spark.createDataFrame([(1, None), (1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert [r.decoded for r in got] == ["", "", ""]


def test_stream_commits_early(vocabulary):
    body = b" " + b"thequickbrown" * 60
    parts = list(pieces.stream(vocabulary, body))
    assert len(parts) > 3
    assert [i for p in parts for i in p] == brute(vocabulary, body[1:].decode())


def test_bounded_cache(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    encoder = pieces.Encoder(vocabulary)
    for text in ("one two three four five", "six", "one two"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, first = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == brute(vocabulary, text) and first.tolist() == [0, len(ids)]


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_one_pass_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(4)))]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), decoded="back").collect()
    assert all(r.back == (r.text or "") for r in got) and len(got) == len(rows)
