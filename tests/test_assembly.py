import random

from readloom.operators import assembly, graph, kmers, references


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, len(s)) for i, s in rows], "uid long, seq string, len int")


def brute_edges(rows, least):
    return {(a, b, n) for a, x in rows for b, y in rows if a != b for n in range(least, min(len(x), len(y))) if x[-n:] == y[:n]}


def test_overlaps_and_links_equal_one_pass(spark):
    rng = random.Random(1)
    genome = dna(rng, 300)
    rows = [(i, genome[s : s + 30]) for i, s in enumerate(sorted({rng.randrange(270) for _ in range(60)}))]
    rng.shuffle(rows)
    edges = assembly.overlap_edges(frame(spark, rows), 8)
    want = brute_edges(rows, 8)
    assert {tuple(r) for r in edges.collect()} == want
    tails, heads, links = set(), set(), set()
    for a, b, n in sorted(want, key=lambda e: (-e[2], e[0], e[1])):
        if a not in tails and b not in heads:
            tails.add(a)
            heads.add(b)
            links.add((a, b, n))
    got = assembly.greedy_links(edges)
    assert {tuple(r) for r in got.collect()} == links  # a line has no cycle
    built = {r.contig_id: r.seq for r in assembly.contigs(frame(spark, rows), got).collect()}
    assert all(seq in genome for seq in built.values())
    assert sum(r.n_reads for r in assembly.contigs(frame(spark, rows), got).collect()) == len(rows)


def test_a_cycle_loses_its_last_link(spark):
    links = spark.createDataFrame([(1, 2, 9), (2, 3, 8), (3, 1, 7), (5, 6, 9), (6, 7, 9)], "a long, b long, overlap long")
    assert {tuple(r) for r in assembly.greedy_links(links).collect()} == {(1, 2, 9), (2, 3, 8), (5, 6, 9), (6, 7, 9)}
    assert assembly.greedy_links(links.limit(0)).count() == 0


def one_pass_opened(edges):
    """Links in the order (overlap desc, a, b), then without the last of each cycle."""
    tails, heads = {}, {}
    for a, b, n in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in tails and b not in heads:
            tails[a], heads[b] = (b, n), a
    links = {(a, b, n) for a, (b, n) in tails.items()}
    for start in list(tails):
        seen, at = [], start
        while at in tails and at not in seen:
            seen.append(at)
            at = tails[at][0]
        if at == start and at in seen:
            last = max(((a, *tails[a]) for a in seen), key=lambda e: (-e[2], e[0], e[1]))
            links.discard(last)
    return links


def test_sweep_equals_one_pass(spark):
    rng = random.Random(21)
    periodic = ["A" * 12, "A" * 13, "A" * 20, "AC" * 8, "CA" * 8, "ACA" * 5, "AC" * 9]
    drawn = [*periodic, *(dna(rng, rng.choice([8, 9, 10])) for _ in range(60)), *("".join(rng.choice("AC") for _ in range(rng.randrange(6, 10))) for _ in range(60))]
    hot = [(9, "A" * 12), (3, "A" * 13), (5, "A" * 14), (4, "A" * 10 + "C"), (8, "C" + "A" * 10), (1, "A" * 15)]
    for rows in ([*enumerate(dict.fromkeys(drawn))], hot, [(1, "ACG")]):
        rng.shuffle(rows)
        got = [tuple(r) for r in assembly.sweep_links(frame(spark, rows), 4).collect()]
        assert len(got) == len(set(got)) and set(got) == one_pass_opened(brute_edges(rows, 4))
    assert assembly.sweep_links(spark.createDataFrame([], "uid long, seq string")).count() == 0


def test_two_rounds_equal_one_pass(spark):
    rng = random.Random(22)
    genome, repeat = dna(rng, 200), dna(rng, 25)
    genome = genome[:60] + repeat + genome[60:120] + repeat + genome[120:]
    rows = [(i, s) for i, s in enumerate(dict.fromkeys(genome[p : p + 30] for p in (rng.randrange(len(genome) - 29) for _ in range(90))))]
    first = one_pass_opened(brute_edges(rows, 22))
    admitted = {a for a, _, _ in first} & {b for _, b, _ in first}
    want = one_pass_opened(brute_edges([r for r in rows if r[0] in admitted], 12))
    links, left = assembly.two_rounds(frame(spark, rows), 22, 12)
    assert {tuple(r) for r in links.collect()} == want and want
    assert {r.uid for r in left.collect()} == {i for i, _ in rows} - {a for a, _, _ in want} - {b for _, b, _ in want}


def test_collapse(spark):
    rng = random.Random(2)
    a, b = dna(rng, 200), dna(rng, 150)
    rows = [(1, a), (2, a[20:180]), (3, rc(a[:150])), (4, b), (5, b[:60] + dna(rng, 100)), (6, "ACGT")]
    got = dict(map(tuple, assembly.collapse(spark.createDataFrame(rows, "contig_id long, seq string")).collect()))
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def one_pass_collapse(rows, k, stride, share):
    claimed, kept = set(), {}
    for i, s in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        mers = [min(s[j : j + k], rc(s[j : j + k])) for j in range(len(s) - k + 1)]
        asked = mers[::stride]
        kept[i] = not asked or sum(m in claimed for m in asked) < share * len(asked)
        if kept[i]:
            claimed.update(mers)
    return kept


def test_collapse_of_linked_contigs_equals_one_pass(spark):
    rng = random.Random(12)
    repeat = dna(rng, 30)  # links all of them
    blocks = [dna(rng, 20) for _ in range(9)]
    rows = [(i, "".join(rng.choices(blocks, k=rng.randrange(1, 5))) + (repeat if i % 2 else rc(repeat))) for i in range(60)] + [(99, "ACG"), (98, repeat), (97, repeat)]
    for share in (0.45, 0.92):
        got = assembly.collapse(spark.createDataFrame(rows, "contig_id long, seq string"), 9, 3, share)
        assert dict(map(tuple, got.collect())) == one_pass_collapse(rows, 9, 3, share)
    assert assembly.collapse(spark.createDataFrame([], "contig_id long, seq string")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5)], "a long, b long")
    assert dict(map(tuple, graph.connected(links).collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_bubble_of_one_substitution(spark):
    rng = random.Random(3)
    a = dna(rng, 60)
    b = a[:30] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[30]] + a[31:]
    counts = kmers.count(spark.createDataFrame([(i, s) for i, s in enumerate([a, a, a, b, b])], "read_id long, seq string"), 11)
    found = graph.bubbles(kmers.successors(kmers.oriented(counts), 11), 11).collect()
    assert {frozenset((r.ref, r.alt)) for r in found} == {frozenset((a[30], b[30])), frozenset((rc(a[30]), rc(b[30])))}
    assert {tuple(sorted((r.ref_min, r.alt_min))) for r in found} == {(2, 3)}


def test_tips(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "a")], "node string, next string")
    assert {r.node for r in graph.tips(edges).collect()} == {"b", "c"}


def test_edges_into_tips_go_where_there_is_another_way(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n3", "t1"), ("t1", "t2")]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "node string, next string, cnt long")
    assert {(r.node, r.next) for r in graph.without_tips(df, 4).collect()} == set(edges) - {("n3", "t1")}


def brute_turned(rows, least):
    """Maximal runs where one text equals the other strand of another, or of itself."""
    found = set()
    for s, a in rows:
        for d, b in rows:
            turn = rc(a)
            for x in range(len(b)):
                for t in range(len(turn)):
                    if s <= d and b[x] == turn[t] and not (x and t and b[x - 1] == turn[t - 1]):
                        n = 0
                        while x + n < len(b) and t + n < len(turn) and b[x + n] == turn[t + n]:
                            n += 1
                        src = len(a) - t - n
                        if n >= least and (s < d or src <= x):
                            found.add((d, s, x, src, n))
    return found


def test_references_of_the_other_strand(spark):
    rng = random.Random(14)
    a, hairpin = dna(rng, 70), dna(rng, 15)
    rows = [(1, a), (2, dna(rng, 9) + rc(a[10:60]) + dna(rng, 9)), (3, hairpin + rc(hairpin)), (4, hairpin + dna(rng, 7) + rc(hairpin)), (5, a[:8]), (6, a[20:50])]
    rows += [(10 + i, dna(rng, 6) + (a[25:40] if i % 2 else rc(a[25:40])) + dna(rng, 6)) for i in range(6)]
    texts = spark.createDataFrame(rows, "contig_id long, seq string")
    got = references.self_matches(texts, 10, turned=True)
    assert {tuple(r) for r in got.collect()} == brute_turned(rows, 10) and got.count() == len(brute_turned(rows, 10))
    few = {tuple(r) for r in references.self_matches(texts, 10, most=2, turned=True).collect()}
    assert few < brute_turned(rows, 10)  # whole runs all the same
    refs = references.trimmed(references.both_strand_matches(texts, 10)).cache()
    assert refs.filter("turned").count() and refs.filter("not turned").count()
    assert dict(map(tuple, references.rebuilt(texts, refs, references.literals(texts, refs)).collect())) == dict(rows)


def test_substitutions_between_references(spark):
    rng = random.Random(15)
    a = dna(rng, 90)
    b = a[:40] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[40]] + a[41:]
    texts = spark.createDataFrame([(1, a), (2, dna(rng, 5) + b), (3, a[:30] + a[33:])], "contig_id long, seq string")
    got = references.gap_substitutions(references.self_matches(texts), texts)
    assert {tuple(r) for r in got.collect()} == {(2, 1, 45, 40, a[40], b[40])}


def test_references_rebuild(spark):
    rng = random.Random(4)
    a = dna(rng, 120)
    rows = [(1, a), (2, a[10:90] + dna(rng, 30)), (3, dna(rng, 40) + a[50:110]), (4, a[:20]), (5, "AC" * 30)]
    texts = spark.createDataFrame(rows, "contig_id long, seq string")
    refs = references.trimmed(references.self_matches(texts)).cache()
    assert dict(map(tuple, references.rebuilt(texts, refs, references.literals(texts, refs)).collect())) == dict(rows)
    assert any(r.dst_id == 2 and r.src_id == 1 and r.dst == 0 and r.src == 10 and r["size"] >= 80 for r in refs.collect())


def test_near_overlaps(spark):
    rng = random.Random(5)
    a = dna(rng, 60)
    b = a[20:40] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[40]] + a[41:] + dna(rng, 15)
    assert {tuple(r) for r in assembly.near_overlaps(frame(spark, [(1, a), (2, b)]), 30).collect()} == {(1, 2, 40, 1)}


def test_a_repeat_of_many_contigs_has_references(spark):
    rng = random.Random(6)
    repeat, hot, left, right = dna(rng, 60), dna(rng, 24), dna(rng, 40), dna(rng, 40)
    rows = [(i, dna(rng, 20) + repeat + dna(rng, 20)) for i in range(80)]
    rows += [(100 + i, dna(rng, 30) + hot + dna(rng, 30)) for i in range(70)]
    rows += [(200, left + hot + right), (201, dna(rng, 9) + left + hot + right + dna(rng, 9))]
    refs = references.self_matches(spark.createDataFrame(rows, "contig_id long, seq string")).cache()
    seqs, got = dict(rows), {(r.dst_id, r.src_id, r.dst, r.src, r["size"]) for r in refs.collect()}
    assert len(got) == refs.count()
    for d, s, x, y, n in got:  # equal, and maximal
        assert seqs[d][x : x + n] == seqs[s][y : y + n]
        assert not (x and y and seqs[d][x - 1] == seqs[s][y - 1]) and seqs[d][x + n : x + n + 1] != seqs[s][y + n : y + n + 1]
    for i in range(1, 80):  # all sources of the first 65, the first 64 of later ones
        assert {s for d, s, x, y, n in got if d == i and x <= 20 and x + n >= 80} >= set(range(min(i, 64)))
    assert (201, 200, 9, 0, 104) in got
    assert not any(d == 201 and s == 200 and n < 104 for d, s, x, y, n in got)


def one_pass(edges):
    tails, heads, links = set(), set(), set()
    for a, b, n in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in tails and b not in heads:
            tails.add(a)
            heads.add(b)
            links.add((a, b, n))
    return links


def linked(spark, edges, monkeypatch):
    """Links before cycles are opened, and the rounds they took."""
    rounds, tied = [], assembly._tied
    monkeypatch.setattr(assembly, "_opened", lambda links: links)
    monkeypatch.setattr(assembly, "_tied", lambda ranked: rounds.append(1) or tied(ranked))
    got = {tuple(r) for r in assembly.greedy_links(spark.createDataFrame(sorted(edges), "a long, b long, overlap long")).collect()}
    monkeypatch.undo()
    return got, len(rounds)


def test_ties_are_linked_in_few_rounds(spark, monkeypatch):
    k = 210  # as many tails and heads of one tie took as many rounds, which were limited to 200
    for tails, heads in ((range(k), range(1000, 1000 + k)), (range(k), range(k)), (range(0, k, 2), range(0, k, 3))):
        edges = {(a, b, 20) for a in tails for b in heads if a != b}
        got, rounds = linked(spark, edges, monkeypatch)
        assert got == one_pass(edges)
        assert rounds < 20


def test_links_of_any_edges_equal_one_pass(spark, monkeypatch):
    rng = random.Random(7)
    for share, depth in ((0.9, 1), (0.7, 2), (0.3, 3), (0.95, 2)):
        edges = {(a, b, rng.randrange(depth)) for a in range(14) for b in range(4, 18) if a != b and rng.random() < share}
        assert linked(spark, edges, monkeypatch)[0] == one_pass(edges)


def test_near_overlaps_with_differences_at_seed_edges(spark):
    rng = random.Random(8)
    turn = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows, want = [], set()
    for n, places in ((30, (10,)), (31, (11,)), (30, (9, 10)), (30, (11, 20)), (40, (10, 21)), (30, (0, 29)), (45, (19, 20))):
        a = dna(rng, 60)
        b = "".join(turn[x] if i in places else x for i, x in enumerate(a[-n:])) + dna(rng, 15)
        want.add((len(rows), len(rows) + 1, n, len(places)))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    brute = {(a, b, n, d) for a, x in rows for b, y in rows if a != b for n in range(30, min(len(x), len(y))) for d in [sum(p != q for p, q in zip(x[-n:], y[:n]))] if d in (1, 2)}
    assert brute >= want
    assert {tuple(r) for r in assembly.near_overlaps(frame(spark, rows), 30).collect()} == brute
