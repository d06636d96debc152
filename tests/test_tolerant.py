import random

import pytest
from readloom.operators import references, search


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def changed(s, *places):
    return "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in places else c for i, c in enumerate(s))


def joined(exact, texts, most):
    """Exact runs (dst_id, src_id, dst, src, size, turned) of one diagonal, one by one, with at most ``most`` bases between."""
    out = []
    for r in sorted(exact, key=lambda r: (r[0], r[1], r[5], r[3] + r[4] + r[2] if r[5] else r[2] - r[3], r[2])):
        d, s, dst, src, size, turned = r
        last = out[-1] if out else None
        along = lambda x: x[2] + x[3] + x[4] if x[5] else x[2] - x[3]
        if last and last[:2] == [d, s] and last[5] == turned and along(last) == along(r) and dst - last[2] - last[4] <= most:
            last[3], last[4] = min(last[3], src), dst + size - last[2]
        else:
            out.append([*r])
    rows = set()
    for d, s, dst, src, size, turned in out:
        ours, theirs = texts[d][dst : dst + size], texts[s][src : src + size]
        theirs = rc(theirs) if turned else theirs
        rows.add((d, s, dst, src, size, turned, tuple((i, x) for i, (x, y) in enumerate(zip(ours, theirs, strict=True)) if x != y)))
    return rows


def test_runs_over_differences_equal_one_pass_and_rebuild(spark):
    rng = random.Random(8)
    a = dna(rng, 120)
    texts = {1: a, 2: dna(rng, 7) + changed(a[10:100], 20, 45, 46, 70), 3: rc(changed(a, 30, 60, 61, 62, 90)), 4: changed(a[40:], 3, 40), 5: "ACG", 6: dna(rng, 50)}
    df = spark.createDataFrame([*texts.items()], "contig_id long, seq string")
    exact = references.both_strand_matches(df, 12).select("dst_id", "src_id", "dst", "src", "size", "turned").cache()
    for most in (0, 1, 2, 3):
        found = references.tolerant(exact, df, most).cache()
        got = {(r.dst_id, r.src_id, r.dst, r.src, r.size, r.turned, tuple((e.off, e.base) for e in r.edits)) for r in found.collect()}
        assert got == joined([tuple(r) for r in exact.collect()], texts, most)
        assert any(r[6] for r in got) == (most > 0)
        refs = references.trimmed(found)
        assert dict(map(tuple, references.rebuilt(df, refs, references.literals(df, refs)).collect())) == texts
    calls = {(r.chrom, r.pos, r.ref, r.alt) for r in references.edit_calls(references.tolerant(exact, df, 2), df).collect()}
    assert (1, 31, a[30], changed(a, 30)[30]) in calls and all(texts[c][p - 1] == ref != alt for c, p, ref, alt in calls)


def test_differences_are_passed_only_where_texts_look_heterozygous(spark):
    rng = random.Random(9)
    a = dna(rng, 200)
    two = spark.createDataFrame([(1, a), (2, changed(a, 80))], "contig_id long, seq string")
    edits = lambda **more: [e for r in references.adaptive_matches(two, **more).collect() for e in r.edits]
    assert edits() and not edits(least_share=1.1)
    assert references.adaptive_matches(two.limit(0)).count() == 0


def test_adaptive_probes(spark):
    rng = random.Random(10)
    text = dna(rng, 400)
    df = spark.createDataFrame([(1, text), (2, rc(text[:200]))], "contig_id long, seq string")
    probes = [(1, changed(text[50:74], 9)), (2, changed(text[100:148], 5)), (3, text[210:250] + dna(rng, 33)), (4, text[300:316])]
    got = search.adaptive_matches(spark.createDataFrame(probes, "probe_id long, probe string"), df, 3).collect()
    assert search.least_seed(600) == 8 and search.least_seed(4**16) == 14 and search.least_seed(4**30) == 16
    # 24 bases have three pieces of 8, so two differences, whatever is asked; 16 have two
    by = {i: {(r.contig_id, r.strand, r.start, r.n_mm, r.whole) for r in got if r.probe_id == i} for i in (1, 2, 3, 4)}
    assert (1, "+", 50, 1, True) in by[1] and (2, "-", 126, 1, True) in by[1]
    assert (1, "+", 100, 1, True) in by[2] and (1, "+", 210, 0, False) in by[3] and (1, "+", 300, 0, True) in by[4]
    for i, p in probes:
        allowed = min(3, len(p) // 8 - 1)
        want = {(c, s, at) for c, t in ((1, text), (2, rc(text[:200]))) for s, q in (("+", p), ("-", rc(p))) for at in range(len(t) - len(q) + 1) if sum(x != y for x, y in zip(q, t[at : at + len(q)], strict=True)) <= allowed}
        assert {(c, s, at) for c, s, at, _, whole in by[i] if whole} == want
    with pytest.raises(search.ProbeTooShort):
        search.adaptive_matches(spark.createDataFrame([(1, "ACGTACG")], "probe_id long, probe string"), df)
