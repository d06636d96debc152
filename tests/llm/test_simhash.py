import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from readloom.llm import common, simhash


def brute_fingerprint(text):
    found, word = [], b""
    for b in (text or "").encode() + b" ":
        if b == 0x20 or 9 <= b <= 13:
            if word:
                found.append(word.lower())
            word = b""
        else:
            word += bytes([b])
    grams = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and ids[i] != ids[j]:
                    ids[i] = ids[j] = min(ids[i], ids[j])
                    changed = True
    return ids


def texts(rng, n=120):
    vocab = ["alpha", "Bêta", "gamma,", "d", "e" * 40, "f" * 700, "ZÜ", "日本", "\x0b", "42"]
    out = ["", None, " \t\n", "one", "One two", "A b c d", "a  b\nc\td"]
    while len(out) < n:
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        out.append(" ".join(words))
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append("\n".join(words))
    return out[:n]


def test_xxh64_every_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, np.uint8)
    start = rng.integers(0, 2000, 700)
    length = np.arange(700)
    got = simhash.xxh64(data, start, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(start, length)]


def test_components_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(random.Random(3)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    assert [got[i][0] for i in range(len(rows))] == prints
    assert [got[i][1] for i in range(len(rows))] == brute_components(prints)


def test_links_with_many_close_fingerprints_and_split_shards(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        v = rng.choice(list(values)[:40]) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.fingerprint_links(df, len(values), shard_size=30).collect()
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in links:
        x, y = root(a & (1 << 64) - 1), root(b & (1 << 64) - 1)
        label[max(x, y)] = min(x, y)
    want = brute_components(values)
    roots = [root(v) for v in values]
    groups = lambda ids: sorted(sorted(i for i in range(len(ids)) if ids[i] == c) for c in set(ids))
    assert groups(roots) == groups(want)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, None), (9, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(twice).collect())
    assert got == [("5", 5), ("5", 5), ("7", 7), ("9", 7), ("None", 5)]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_folder(spark)
    assert simhash.fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string")).filter(F.col("fp").isNull()).count() == 0
