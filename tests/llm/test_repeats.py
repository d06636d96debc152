import hashlib
import random
from collections import Counter

from readloom.llm import repeats
from readloom.llm.repeats import remove_repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, length):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", "x", "ab" * length, "a" * (3 * length), "a" * (length - 1), "a" * length]
    passage = prose(length // 2)[: length + rng.randrange(-2, 60)]
    out += [prose(rng.randrange(40)) + passage + prose(rng.randrange(40)) for _ in range(12)]
    out += [passage[k:] + prose(9) for k in range(3)]
    base = prose(length)
    out += [base, base, base + "z", "z" + base]
    for _ in range(10):
        cut = rng.randrange(len(base))
        out.append(base[:cut] + word() + base[cut + rng.randrange(5) :])
    block = prose(length // 3)[:length]
    out.append(block + block + block)
    out += [prose(rng.randrange(2 * length)) for _ in range(12)]
    return out


def check(spark, texts, length):
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, r1 int"), length=length, digest=True).collect()}
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        spans = list(zip(r.starts, r.ends))
        assert (r.n_bytes, sum(b - a for a, b in spans), len(spans), r.kept) == want, i
    assert len(got) == len(texts)


def test_equal_to_brute_force(spark):
    for length, seed in ((400, 1), (50, 2)):
        check(spark, corpus(random.Random(seed), length), length)


def test_runs_that_cross_chunks(spark, monkeypatch):
    """Texts of several chunks: repeats across a chunk's end, at other places of the chunk, and of whole chunks."""
    monkeypatch.setattr(repeats, "CHUNK", 150)
    rng = random.Random(3)
    texts = corpus(rng, 60)
    long = "".join(rng.choice("abcde ") for _ in range(1500))
    check(spark, [*texts, long, "zz" + long[100:700] + "y" * 9 + long[650:], long[:149] + "q" + long[149:], long[:300] * 3], 60)


def test_equal_only_if_the_bytes_are(spark):
    """The Thue-Morse words over a, b and b, a agree in every rolling hash modulo a power of two."""
    for k in (10, 11, 12):
        one = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        other = one.translate(str.maketrans("ab", "ba"))
        check(spark, [one, other, "c" + one[: 1 << (k - 1)]], 1 << (k - 1))


def test_empty_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "q" * 500), (1, "q" * 500), (None, None), (None, "w")]
    got = sorted((str(r.doc_id), r.n_bytes, len(r.starts), r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 500, 1, b""), ("1", 500, 1, b""), ("None", 0, 0, b""), ("None", 1, 0, b"w")]
