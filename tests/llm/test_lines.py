import hashlib
import random

from readloom.llm.linededup import drop_repeated_lines


def brute(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and i != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    pool = ["A common line here", "  a COMMON line here\t", "short", "été été ét", "ÉTÉ été été", "x" * 300, "", "\x0b\x0c", "tab\tinside line", "line with\rreturn", "日本語日本語日本語日本"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.randrange(99)} {i}" for _ in range(rng.randrange(12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A common line here\n" * 3000)]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, n_lines string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in drop_repeated_lines(df, digest=True).collect())
    assert got == brute(rows)


def test_other_columns_and_odd_rows(spark):
    kind = "doc_id long, text string, _row string, a int"
    rows = [(1, "the same long line\nmine", "r", 1), (2, "The Same Long Line\nmine", "s", 2), (2, "The Same Long Line", "t", 3), (None, "the same long line", "u", 4)]
    got = drop_repeated_lines(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "_row", "a", "n_lines", "n_dropped"]
    assert sorted((r.a, r.text, r._row, r.n_dropped) for r in got.collect()) == [(1, "the same long line\nmine", "r", 0), (2, "mine", "s", 1), (3, "", "t", 1), (4, "the same long line", "u", 0)]
    assert drop_repeated_lines(spark.createDataFrame([], kind)).count() == 0


def test_lines_are_equal_only_if_their_bytes_are(spark):
    """The Thue-Morse words over a, b and b, a agree in every rolling hash modulo a power of two."""
    rows = []
    for k in (10, 11, 12):
        one = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        rows += [(2 * k, one), (2 * k + 1, one.translate(str.maketrans("ab", "ba"))), (100 + k, f" {one.upper()} \nx")]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute(rows)
