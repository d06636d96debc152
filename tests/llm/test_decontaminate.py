import random
import re

import numpy as np

from readloom.llm import decontaminate
from readloom.llm.decontaminate import find_benchmark

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (k := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def case(rng):
    vocab = ["alpha", "Beta", "gamma", "é", "x1", "日本", "delta", "o"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.randrange(1, 26))) for k in range(12)] + [(90, None), (91, "..."), (92, "o"), (93, "alpha BETA"), (None, prose(14)), (5, prose(12))]
    docs = [(None, prose(30)), (500, None), (501, ""), (502, "- . !")]
    for i in range(60):
        parts = [prose(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            item = words(rng.choice(items)[1]) or ["q"]
            at = rng.randrange(len(item))
            parts.append("; ".join(item[at : at + rng.randrange(1, 20)]))
        docs.append((i, " ZZ ".join(parts) + rng.choice(["", " alpha"])))
    docs.append((700, " ".join([items[3][1] or ""] * 900)))
    return docs, items


def test_equal_to_brute_force_in_one_block_and_in_many(spark):
    docs, items = case(random.Random(3))
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        got = [(r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in find_benchmark(df, benchmark, block_bytes=block).collect()]
        assert sorted(got, key=str) == brute(docs, items)


def test_clean_text_and_empty_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before. {passage.title()}, after."), (2, "one two three")], "doc_id long, text string")
    got = {r.row.doc_id: (r.clean, r.n_hit) for r in find_benchmark(docs, benchmark).collect()}
    assert got == {1: ("Before. , after.", 11), 2: ("one two three", 0)}
    assert find_benchmark(docs.limit(0), benchmark).count() == 0
    assert [r.n_hit for r in find_benchmark(docs, benchmark.limit(0)).collect()] == [0, 0]


def test_words_are_equal_only_if_their_bytes_are(spark):
    """The Thue-Morse words over a, b and b, a agree in every rolling hash modulo a power of two."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, one), (2, other), (3, f"x {one.upper()} {other}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for items in ([(7, one)], [(7, one), (8, other)], [(9, f"{one} {other}")]):
        found = find_benchmark(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found) == brute(docs, items)


def test_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, None, 1, 2), (1, "A b", 3, 4), (1, "A b", 3, 4)], "doc_id long, text string, row int, _text int")
    benchmark = spark.createDataFrame([(None, "a b"), (2, None)], "item_id long, text string")
    got = [(r.row.doc_id, r.row.row, r.row._text, r.n_hit, list(r["items"]), r.clean) for r in find_benchmark(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 2, 0, [], ""), (1, 3, 4, 2, [], ""), (1, 3, 4, 2, [], "")], key=str)


def test_index_counts_and_locates():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 5, 3000)
    text[rng.integers(0, 3000, 120)] = 0
    text[-1] = 0
    index = decontaminate.FMIndex(text, 4)
    patterns = rng.integers(1, 5, (60, 5))
    length = rng.integers(1, 6, 60)
    low, high = index.search(patterns, length)
    for k in range(60):
        p = patterns[k, 5 - length[k] :]
        want = [i for i in range(3000 - len(p)) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[k], high[k]))) == want
