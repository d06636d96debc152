import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from readloom.llm import common, importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=25, least=20, buckets=10000, longest=2):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest)[1])
    g = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    ss, gg = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (ss + buckets) / ((s[b] + 1) * (gg + buckets))))
    out = []
    for i, t in rows:
        n, f = features(t, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    race = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(race[: percent * len(race) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def table(rng):
    words = ["Alpha", "beta", "GAMMA", "été", "日本", "x9", "-", "...", "é́", "w" * 90, "\n", "\n\n", "\x7f"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(300 + i, "the same hot line of words\n" * 40 + f"own {i}") for i in range(60)]
    return [*rows, (900, None), (901, ""), (902, "alpha beta " * 30_000), (903, "1-2_3"), (None, "beta gamma alpha " * 9)]


TARGET = ["alpha beta\ngamma", None, "", "x9 x9 x9", "own words of the target"]


def compared(spark, rows, target, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    mine = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    return mine, sorted(brute(rows, target, **{k: v for k, v in more.items() if k in ("percent", "buckets", "longest")}), key=str)


def test_equal_to_brute_force(spark):
    rows = table(random.Random(5))
    mine, want = compared(spark, rows, TARGET)
    assert mine == want
    mine, want = compared(spark, rows, TARGET, percent=100, buckets=17, longest=3)
    assert mine == want


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c " * 10, 1, "r"), (1, "a b c " * 10, 2, "s"), (1, "d " * 40, 3, "t"), (2, "e " * 40, 4, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight int, _row string")
    got = importance.resample(df, df.select("text"), percent=100)
    assert got.columns == ["doc_id", "_row", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4]
    assert len({r.score for r in got.filter("_row in ('r', 's')").collect()}) == 1


def test_empty_tables(spark):
    kind = "doc_id long, text string"
    some, none = spark.createDataFrame([(1, "word " * 30)], kind), spark.createDataFrame([], kind)
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none, percent=100).collect()[0]["rank"] == 1


def test_checksums_of_spans():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(200))) for _ in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    assert importance.crc_on(np.zeros(300, np.uint32), data, start, end).tolist() == [zlib.crc32(w) for w in words]


def test_segments_count_each_line_once(spark):
    df = spark.createDataFrame([("One line\nTwo",), ("one LINE\n\ntwo",), ("one line",)], "text string")
    got = {(bytes(r.words).decode(), r.crossing): r.times for r in importance.segments(df, "text", 2).collect()}
    assert got == {("one line", False): 3, ("two", False): 2, ("line two", True): 2}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = importance.op11_resample(spark, sf)
    order = sorted(got.columns)
    rows = sorted(map(tuple, got.select(order).collect()), key=str)
    assert rows == sorted(con.sql(importance.OP11_SQL).select(*order).fetchall(), key=str)
    texts = common.documents(spark, sf).select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect() if r["rank"]) == sorted(r for r in brute([tuple(r) for r in texts], target) if r[4])
