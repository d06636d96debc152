import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from readloom.llm import fillmiddle as fim


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    words = re.findall(r"[^ \t-\r]+[ \t-\r]*", text)
    lead = re.match(r"[ \t-\r]*", text)[0]
    return [lead + words[0], *words[1:]] if words else [lead] if lead else []


def brute(doc_id, text, unit="char", rate=90, spm=20):
    text, x = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text, unit)
    n = len(parts)
    assert "".join(parts) == text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, n, "plain", None, None
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return out, n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m)


def rows():
    rng = random.Random(3)
    pool = ["plain word", "é", "日本語", "\n", "\n\n", "😀", " ", "\t", "<", "<S", "P>", "M>", "\x00", "a" * 300, "́"]
    some = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(150)]
    return [*some, (500, None), (501, ""), (None, "no id at all"), (7, "again the same id"), (502, "has <P> in it"), (503, "é😀 x\n" * 60_000), (504, "   "), (505, "  lead"), (506, "\n\n")]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equal_to_brute_force(spark, unit):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    made = fim.fill_in_middle(df, unit=unit).withColumn("back", fim.restored())
    got = made.collect()
    assert made.columns == ["doc_id", "text", "output", "n", "form", "prefix_chars", "middle_chars", "back"]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.output, r.n, r.form, r.prefix_chars, r.middle_chars) for r in got), key=key) == sorted(((i, *brute(i, t, unit)) for i, t in rows()), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = lambda **more: {r.form for r in fim.fill_in_middle(df, **more).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=100) == {"spm"} and forms(rate=100, suffix_first=0) == {"psm"}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc def", 5, "x", "r")], "doc_id long, text string, n int, form string, _row string")
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "text", "_row", "output", "n", "form", "prefix_chars", "middle_chars"]
    assert [(r._row, r.n, r.text) for r in got.collect()] == [("r", 7, "abc def")]
    assert fim.fill_in_middle(df, into="text").columns == ["doc_id", "_row", "text", "n", "form", "prefix_chars", "middle_chars"]
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aba", "x", "y"), ("", "x", "y"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            fim._check(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=700), min_size=1, max_size=6), st.data())
def test_places_by_the_tree(texts, data):
    raw = [t.encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    starts = fim.unit_starts(flat, offsets, "char")
    tree = fim.Fenwick(starts, starts, offsets)
    texts = [x.decode() for x in raw]
    assert tree.total().tolist() == [len(t) for t in texts]
    number = np.array([data.draw(st.integers(0, len(t))) for t in texts])
    place, points = fim.places(flat, offsets, starts, tree, np.arange(len(texts)), number)
    assert (place - offsets[:-1]).tolist() == [len(t[:k].encode()) for t, k in zip(texts, number, strict=True)]
    assert points.tolist() == number.tolist()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = fim.op12_fill_middle(spark, sf)
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(order).collect())) == sorted(con.sql(fim.OP12_SQL).select(*order).fetchall())
