"""What goes through shuffles, and how often reads are made anew."""

import random

import __spark_entry__
from readloom.operators import assembly, product, reads, search

TABLES = "/root/testdata/sf0.001"


def shuffled(spark, made) -> tuple[int, int]:
    """Rows and bytes that tasks write to shuffles."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    sums = lambda: [sum(f(stages().apply(i)) for i in range(stages().size())) for f in (lambda s: s.shuffleWriteRecords(), lambda s: s.shuffleWriteBytes())]
    before = sums()
    made()
    return tuple(b - a for a, b in zip(before, sums(), strict=True))


def drawn(n: int, size: int, seed: int, letters: str = "ACGT") -> list[tuple[int, str]]:
    draw = random.Random(seed)
    return [(i, "".join(draw.choices(letters, k=size))) for i in range(n)]


def test_probes_meet_windows_without_their_texts(spark):
    texts = drawn(300, 600, 1)
    probes = [(i, t[50:80] if i % 2 else t[50:60] + "T" + t[61:80]) for i, t in texts[:40]]
    found, got = search.seed_matches(spark.createDataFrame(probes, "probe_id long, probe string"), spark.createDataFrame(texts, "contig_id long, seq string"), 1), []
    _, size = shuffled(spark, lambda: got.extend((r.probe_id, r.strand, r.contig_id, r.start, r.n_mm) for r in found.collect()))
    assert sorted(got) == [(i, "+", i, 50, sum(a != b for a, b in zip(p, texts[i][1][50:80], strict=True))) for i, p in probes]
    assert size < 25 * 300 * 586  # bytes a window


def test_postings_go_through_one_shuffle(spark):
    rows = drawn(400, 60, 2)
    unique = spark.createDataFrame(rows, "uid long, seq string")
    found, got = search.complete(spark.createDataFrame([(i, t[10:40]) for i, t in rows[:30]], "probe_id long, probe string"), search.completion_index(unique), unique), []
    n, _ = shuffled(spark, lambda: got.extend(map(tuple, found.collect())))
    assert sorted(got) == [(i, i) for i in range(30)]
    assert n < 2 * 400 * 6  # a read has 6 postings
    again = search.completion_index(spark.createDataFrame([(1, "AC" * 20), (2, "ACGT")], "uid long, seq string")).collect()
    assert sorted((r.code, r.uid) for r in again) == [("AC" * 10, 1)]


def test_containment_asks_for_reads_once(spark):
    rows = [(i, t[: 40 if i % 3 else 60]) for i, t in drawn(300, 60, 3, "AC")]
    rows += [(1000 + i, t[:40]) for i, t in rows[:30:3]]
    found = reads.contain_prefixes(reads.deduplicate(spark.createDataFrame(rows, "read_id long, seq string"))[0])
    assert "min(read_id" not in found._jdf.queryExecution().optimizedPlan().toString()  # it was made three times
    assert sorted((r.uid, r.into) for r in found.collect()) == [(1000 + i, i) for i in range(0, 30, 3)]


def test_both_rows_of_a_duplicate_come_from_one_drawing(spark):
    found = __spark_entry__.queries()["dup_expansion"](spark, TABLES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_reconstruction_reads_what_was_drawn_once(spark):
    plan = __spark_entry__.queries()["read_reconstruct"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_overlaps_without_a_row_a_seed(spark):
    draw, text = random.Random(4), "".join(random.Random(5).choices("ACGT", k=900))
    rows = list(enumerate({text[i : i + draw.choice([17, 33, 50, 60])] for i in draw.sample(range(840), 250)} | {"AC" * 9, "CA" * 20, "AC" * 32, "AC" * 33, "A" * 16}))
    found, got = assembly.overlap_edges(spark.createDataFrame(rows, "uid long, seq string")), []
    n, _ = shuffled(spark, lambda: got.extend(map(tuple, found.collect())))
    assert sorted(got) == sorted((a, b, k) for a, x in rows for b, y in rows if a != b for k in range(16, min(len(x), len(y))) if x[-k:] == y[:k])
    assert n < 0.7 * sum(max(0, len(t) - 16) for _, t in rows)


def plain_gaps(reads, contigs, k=25, context=40, most=30, flank=10, least_reads=3):
    places, votes = {}, {}
    for c, t in contigs:
        for p in range(len(t) - k + 1):
            places.setdefault(t[p : p + k], []).append((c, p, t))
    for r, t in reads:
        for q in range(len(t) - k + 1):
            if len(hit := places.get(t[q : q + k], [])) == 1:
                c, p, whole = hit[0]
                x, y = whole[max(0, p - context) : p][::-1], t[max(0, q - context) : q][::-1]
                at = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), None)
                if at is not None:
                    size = lambda a, b: next((n for n in range(1, most + 1) if len(a[at : at + flank]) == flank and a[at : at + flank] == b[at + n : at + n + flank]), 0)  # noqa: B023, E731
                    kind, n = next(((kind, n) for kind, n in (("I", size(x, y)), ("D", size(y, x))) if n), (None, 0))
                    if kind:
                        votes.setdefault((c, p - at - n if kind == "D" else p - at, kind, n), set()).add(r)
    return sorted((*v, len(ids)) for v, ids in votes.items() if len(ids) >= least_reads)


def test_anchored_gaps_without_a_row_a_kmer(spark):
    draw = random.Random(6)
    shared = "A" * 30  # of more contigs than may meet by it
    contigs = [(c, t[:60] + (shared if c < 70 else "") + t[60:]) for c, t in drawn(90, 120, 7)]
    rows = []
    for c, t in contigs[::3]:
        for i in range(5):
            at, lo = 50 + 3 * i, draw.randrange(10)
            cut = t[:50] + (t[52:] if c % 2 else "GT" + t[50:])
            rows += [(10 * c + i, cut[lo : lo + 75]), (10 * c + i + 5, t[at : at + 60])]
    rows += rows[:3] + [(rows[0][0], contigs[9][1][:70]), (5000, "ACG")]
    found, got = product.anchored_gaps(spark.createDataFrame(rows, "read_id long, seq string"), spark.createDataFrame(contigs, "contig_id long, seq string")), []
    got.extend((r.contig_id, r.pos, r.kind, r.size, r.n_reads) for r in found.collect())
    assert sorted(got) == plain_gaps(rows, contigs) != []
    contigs = drawn(10, 120, 8)
    rows = [(100 * c + i, t[i : i + 60]) for c, t in contigs for i in range(60)]
    found = lambda: product.anchored_gaps(spark.createDataFrame(rows, "read_id long, seq string"), spark.createDataFrame(contigs, "contig_id long, seq string")).collect()
    assert shuffled(spark, found)[0] < sum(len(t) - 24 for _, t in rows)
