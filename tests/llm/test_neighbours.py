import math
import random

from readloom.llm.neighbours import search


def brute(rows, k):
    fine = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            found = []
            for j, w in fine:
                if j != i:
                    score = 0.0
                    for a, b in zip(v, w):
                        score += a * b
                    found.append((-score, j))
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(600)]
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [None] + [1.0] * 7), (5060, [math.nan] * 8), (5080, [math.inf] * 8), (5100, []), (5120, [1.0]), (None, [1.0] * 8)]
    got = {}
    for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    floats = [(r.vec_id, r.embedding) for r in spark.createDataFrame([x for x in rows if x[0] != 5120], "vec_id long, embedding array<float>").collect()]
    want = brute(floats, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda x: (-x[1], x[0]))
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.93


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>, leaf string, id int"
    assert search(spark.createDataFrame([], kind)).count() == 0
    rows = [(i, [1.0, float(i)], "x", 1) for i in range(5)] + [(3, [1.0, 3.0], "x", 1)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(spark.createDataFrame(rows, kind)).orderBy("rank").collect()]
    assert got == [(0, k + 1, k + 1, 1.0) for k in range(4)]
