import random

from readloom.operators import intervals


def test_coverage_runs_equal_brute_force(spark):
    rng = random.Random(1)
    spans = [(r, s := rng.randrange(100), s + rng.randrange(0, 30)) for r in "ab" for _ in range(40)]
    extents = [("a", 0, 140), ("b", 0, 130), ("c", 5, 9)]
    frames = spark.createDataFrame(spans, "region string, start long, end long"), spark.createDataFrame(extents, "region string, start long, end long")
    runs = intervals.coverage_runs(*frames).collect()
    assert sorted(map(tuple, runs)) == sorted(map(tuple, intervals.coverage_runs(*frames, width=7).collect()))
    for region, lo, hi in extents:
        depth = [sum(s <= p < e for r, s, e in spans if r == region) for p in range(lo, hi)]
        own = sorted((r.start, r.end, r.depth) for r in runs if r.region == region)
        assert [d for s, e, d in own for _ in range(s, e)] == depth
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(own, own[1:]))
    assert sum((r.end - r.start) * r.depth for r in runs) == sum(e - s for _, s, e in spans)


def test_overlap_join_has_each_pair_once(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), s := rng.randrange(400), s + rng.randrange(90), i) for i in range(60)]
    right = [(rng.choice("ab"), s := rng.randrange(400), s + rng.randrange(90), i) for i in range(60)]
    got = intervals.overlap_join(spark.createDataFrame(left, "region string, start long, end long, l int"), spark.createDataFrame(right, "region string, q_start long, q_end long, r int"), 16)
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[2] > b[1] and a[1] < b[2])
    assert sorted((r.l, r.r) for r in got.collect()) == want


def test_as_of_gaps_and_edges(spark):
    spans = spark.createDataFrame([("x", 10, 20, 1), ("x", 20, 25, 2), ("x", 40, 41, 3)], "region string, start long, end long, contig_id long")
    points = spark.createDataFrame([(i, "x", i) for i in (0, 10, 19, 20, 24, 25, 40, 41)] + [(99, "y", 12)], "point_id long, region string, pos long")
    for width in (1 << 16, 8, 1):
        got = {r.point_id: r.contig_id for r in intervals.as_of_span(points, spans, width).collect()}
        assert got == {0: None, 10: 1, 19: 1, 20: 2, 24: 2, 25: None, 40: 3, 41: None, 99: None}


def test_union_of_spans(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 12), ("a", 1, 2), ("b", 0, 1)], "region string, start long, end long")
    for width in (1 << 16, 4, 1):
        assert sorted(map(tuple, intervals.union_of_spans(rows, width).collect())) == [("a", 0, 7), ("a", 9, 12), ("b", 0, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "region string, start long, end long")
    assert intervals.coverage_runs(none, none).count() == 0
    assert intervals.union_of_spans(none).count() == 0


def test_window_mean_over_chunks(spark):
    depth = spark.createDataFrame([("a", p, p * p % 17) for p in range(60)], "region string, pos long, depth long")
    whole = sorted(map(tuple, intervals.window_mean(depth, 5).collect()))
    assert whole == sorted(map(tuple, intervals.window_mean(depth, 5, 12).collect())) and len(whole) == 60
    assert [r[3] for r in whole][30] == sum(p * p % 17 for p in range(25, 36)) // 11
