"""Matches by minimizers: the plain rule's runs, with fewer rows than seeds."""

import random

from pyspark.sql import functions as F

from readloom.operators import calling, references

TURN = str.maketrans("ACGT", "TGCA")


def plain_runs(texts: dict[int, str], seed: int, most: int, turned: bool) -> set:
    held = {i: t.translate(TURN)[::-1] if turned else t for i, t in texts.items()}
    places: dict[str, list] = {}
    for i, t in held.items():
        for p in range(len(t) - seed + 1):
            places.setdefault(t[p : p + seed], []).append((i, len(t) - p - seed if turned else p, p))
    found = set()
    for d, t in texts.items():
        for p in range(len(t) - seed + 1):
            for s, forward, q in sorted(places.get(t[p : p + seed], []))[:most]:
                if not (s < d or s == d and (turned or forward < p)):
                    continue
                a, b, size, other = p, q, seed, held[s]
                while a and b and t[a - 1] == other[b - 1]:
                    a, b, size = a - 1, b - 1, size + 1
                while a + size < len(t) and b + size < len(other) and t[a + size] == other[b + size]:
                    size += 1
                src = len(other) - b - size if turned else b
                if s < d or src <= a:
                    found.add((d, s, a, src, size))
    return found


def test_runs_of_the_plain_rule(spark):
    draw = random.Random(5)
    for letters, most in (("ACGT", 64), ("ACGTN", 3), ("AC", 3), ("ACGTé", 1)):
        repeats = ["".join(draw.choices(letters, k=23)) for _ in range(3)]
        texts = {i: "".join(draw.choice(repeats) if draw.random() < 0.4 else "".join(draw.choices(letters, k=9)) for _ in range(6)) for i in range(9)} | {9: "A" * 30, 10: "ACG", 11: ""}
        df = spark.createDataFrame(list(texts.items()) + [(12, None)], "contig_id long, seq string")
        for turned in (False, True):
            got = [tuple(r) for r in references.self_matches(df, 8, most, turned=turned).collect()]
            assert len(got) == len(set(got)) and set(got) == plain_runs(texts, 8, most, turned)


def test_seeds_are_not_shuffled_one_by_one(spark):
    draw = random.Random(6)
    rows = [(2 * i + j, t) for i, t in enumerate("".join(draw.choices("ACGT", k=400)) for _ in range(60)) for j in (0, 1)]
    df = spark.createDataFrame(rows, "contig_id long, seq string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = written()
    assert references.self_matches(df).agg(F.sum("size")).first()[0] == 60 * 400
    assert written() - before < sum(len(t) - 23 for _, t in rows)  # seeds, which went through several shuffles


def written_rows(spark, made) -> int:
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = written()
    made()
    return written() - before


def test_held_windows(spark):
    draw = random.Random(7)
    texts = [(i, "".join(draw.choices("ACN", k=draw.randrange(40)))) for i in range(60)]
    wanted = sorted({"".join(draw.choices("AC", k=6)) for _ in range(20)})
    got = references.held_windows(spark.createDataFrame(texts, "id long, seq string"), spark.createDataFrame([(w, w[0]) for w in wanted], "kmer string, first string"), 6, "id")
    want = [(i, p, t[p : p + 6], t[p]) for i, t in texts for p in range(len(t) - 5) if t[p : p + 6] in wanted]
    assert sorted(map(tuple, got.select("id", "start", "kmer", "first").collect())) == sorted(want)


def test_reads_windows_are_not_shuffled_one_by_one(spark):
    draw = random.Random(8)
    reads = [(i, "".join(draw.choices("ACGT", k=60))) for i in range(200)]
    fragments = spark.createDataFrame([(i, t[20:44]) for i, t in reads[:20]], "fragment_id long, seq string")
    found = calling.coherent_reads(spark.createDataFrame(reads, "read_id long, seq string"), fragments, 20)
    got = []
    assert written_rows(spark, lambda: got.extend(map(tuple, found.collect()))) < 200 * 41 / 2
    assert sorted(got) == [(i, 1) for i in range(20)]
