import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_hits
from test_lines import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint

from readloom.llm import linededup, pieces, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, (one, two, three, four, five) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    kept = one(spark, docs, SF).cache()
    net = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = toxicity.score_toxicity(docs, net, into="score").filter("score < 0.5")
    assert kept.columns == columns and kept.exceptAll(want.select(*columns)).count() == 0 and kept.count() == want.count()

    lined = two(spark, kept, SF).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.drop_repeated_lines(kept, digest=True).collect())
    assert found == brute_lines(rows) and lined.columns == columns
    assert {r.doc_id: r.s for r in lined.select("doc_id", F.sha2("text", 256).alias("s")).collect()} == {i: s for i, _, _, s in found}
    assert lined.filter("n_chars <> length(text)").count() == 0

    single = three(spark, lined, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in lined.collect())
    first = brute_components([brute_fingerprint(t) for _, t in rows])
    assert sorted(map(tuple, single.select("doc_id", "text").collect())) == [rows[k] for k in sorted(set(first))] and single.columns == columns

    clean = four(spark, single, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: n for i, _, n, _ in brute_hits([tuple(r) for r in single.select("doc_id", "text").collect()], items)}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (single, clean))
    assert set(before) == set(after) and clean.columns == columns
    assert all((after[i] == before[i]) == (hits[i] == 0) for i in before)
    assert all(n == 0 for _, _, n, _ in brute_hits(list(after.items()), items))

    coded = five(spark, clean, SF).collect()
    assert {r.doc_id: r.text for r in coded} == after
    v = pieces.load()
    assert all(b"".join(v.pieces[i] for i in r.ids)[1:].decode() == r.text and r.n_pieces == len(r.ids) for r in coded)


def test_odd_rows_go_through(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "kind words here", None, "s", 15), (3, "kind words here", None, "s", 15), (None, "no id at all", "en", None, 1)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [("1", ""), ("3", "kind words here"), ("3", "kind words here"), ("None", "no id at all")]
