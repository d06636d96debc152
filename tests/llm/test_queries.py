"""Each numbered query on small tables: columns, types, and the contract's values by plain loops."""

import hashlib
import random
import zlib

import pytest

from readloom.llm import pii
from readloom.llm.queries import QUERIES

COLUMNS = {
    "op1_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_sentencepiece": "doc_id bigint, n_pieces bigint, ids array<int>, decoded_sha256 string, exact boolean",
    "op3_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_licenses": "doc_id bigint, n_sentences bigint, sentence_ids string, licenses string",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}
PASSAGE = " ".join(f"passage{i}word" for i in range(60))


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9)))
    out = [None, "", "a few words", "mail x.y@example.org, +1 415 555 0100; 10.1.2.3, card: 4111 1111 1111 1111"]
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(3, 14))) for _ in range(rng.randrange(1, 7))]
        out.append("\n".join([*lines, *(["zlorg vexupa zlorg"] if i % 4 == 0 else []), *(["one repeated line of words"] if i % 3 == 0 else [])]))
    return [*out, f"begin {PASSAGE} end", f"other {PASSAGE} finish", out[9], out[9]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = list(enumerate(texts()))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), int("zlorg" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "a few words"), (20, PASSAGE), (3, PASSAGE), (4, "not there at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rng = random.Random(8)
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(70)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at, dict(rows)


def rows_of(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    return df.collect()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_repeats(spark, tables):
    bodies = {i: (t or "").encode() for i, t in tables[1].items()}
    seen = {}
    for b in bodies.values():
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    for r in rows_of(spark, tables, "op1_repeats"):
        b = bodies[r.doc_id]
        gone = {k + j for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for j in range(400)}
        spans = sum(1 for k in gone if k - 1 not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(gone), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()
    assert any(seen[x] > 1 for x in seen)


def test_sentencepiece(spark, tables):
    for r in rows_of(spark, tables, "op2_sentencepiece"):
        assert r.exact and r.n_pieces == len(r.ids) and r.decoded_sha256 == sha(tables[1][r.doc_id] or "")


def test_neighbours(spark, tables):
    got = rows_of(spark, tables, "op3_neighbours")
    assert {r.query_id for r in got} == {0, 20, 40, 60}
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()}
    for q in (0, 20, 40, 60):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        assert all(abs(r.score - sum(a * b for a, b in zip(vectors[q], vectors[r.vec_id], strict=True))) < 1e-12 for r in mine)


def test_decontaminate(spark, tables):
    got = {r.doc_id: r for r in rows_of(spark, tables, "op4_decontaminate")}
    for i, t in tables[1].items():
        items = ["20", "3"] if PASSAGE in (t or "") else ["1"] if i == 2 else []
        assert (got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (60 * (PASSAGE in (t or "")) + 3 * (i == 2), len(items), sha(",".join(items)), bool(items))


@pytest.mark.parametrize(("name", "modulus", "held", "limit"), [("op5_quality", 4, 2, 0.7), ("op9_toxicity", 5, 0, 0.5)])
def test_scores(spark, tables, name, modulus, held, limit):
    got = rows_of(spark, tables, name)
    assert sorted(r.doc_id for r in got) == sorted(tables[1])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    if name == "op9_toxicity":
        assert sum(r.predicted == ("zlorg" in (tables[1][r.doc_id] or "")) for r in got) > 0.9 * len(got)


def test_one_class_of_labels(spark, tables, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{tables[0]}/{table}.parquet").filter("doc_id % 3 = 1").write.parquet(f"{tmp_path}/{table}.parquet")
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in QUERIES["op5_quality"](spark, str(tmp_path)).collect())


def test_licenses(spark, tables):
    assert all((r.n_sentences, r.sentence_ids, r.licenses) == (0, "", "") for r in rows_of(spark, tables, "op6_licenses"))


def test_lines(spark, tables):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t in tables[1].items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    for r in rows_of(spark, tables, "op7_line_dedup"):
        lines = (tables[1][r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))


def test_personal_data(spark, tables):
    for r in rows_of(spark, tables, "op8_pii"):
        base = pii.rule_spans(tables[1][r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == sha(",".join(named)) and set(named) <= set(r.spans.split(","))
        assert r.doc_id != 3 or [r.n_email, r.n_ip, r.n_card, r.n_phone] == [1, 1, 1, 1]


def test_simhash(spark, tables):
    got = {r.doc_id: r for r in rows_of(spark, tables, "op10_simhash")}
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in got.values())
    print_of = {i: int(r.fingerprint, 16) for i, r in got.items()}
    root = {i: i for i in got}
    for _ in got:
        for a in got:
            for b in got:
                if (print_of[a] ^ print_of[b]).bit_count() <= 4:
                    root[a] = min(root[a], root[b])
    assert {i: r.component_id for i, r in got.items()} == root and got[0].fingerprint == "0" * 16
