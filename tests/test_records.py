import gzip
import random

import pytest
from readloom.functions import registered
from readloom.operators import calling
from readloom.sources import files, records

RECORDS = [(f"@r{i}", "ACGTN"[: i % 6] * 3, "+" if i % 2 else f"+r{i}", "@+I"[i % 3] * (3 * min(5, i % 6))) for i in range(24)]


def text(rows, end="\n"):
    return "".join(end.join(r) + end for r in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_every_size_give_each_record_once(tmp_path, end):
    path = tmp_path / "a.fastq"
    body = text(RECORDS, end)
    for data in (body, body.removesuffix(end)):
        path.write_text(data, newline="")
        for step in range(1, len(data) + 2):
            got = [r for part in records.ranges(records.listed(str(path)), step) for r in records.records(part, True)]
            assert [tuple(x.decode() for x in r[1:]) for r in got] == RECORDS
            assert [data[r[0] :].startswith("@r") for r in got] == [True] * len(RECORDS)


def test_source_equals_the_reader_by_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text(text(RECORDS))
    with gzip.open(tmp_path / "in" / "b.fastq.gz", "wt") as f:
        f.write(text(RECORDS))
    (tmp_path / "in" / "_SUCCESS").write_text("")
    spark.dataSource.register(records.FastqRecords)
    got = spark.read.format("fastq_records").option("split_bytes", 100).load(str(tmp_path / "in"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 5
    columns = ["name", "seq", "plus", "qual"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, files.read_fastq(spark, str(tmp_path / "in" / "*fastq*")).select(columns).collect()))
    (tmp_path / "none").mkdir()
    assert spark.read.format("fastq_records").load(str(tmp_path / "none")).count() == 0


def test_malformed_records(tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text(text(RECORDS[:5]) + "@bad\nACGT\n+\nII\n" + text(RECORDS[5:8]) + "@cut\nACGT\n")
    part = records.ByteRange(str(path), 0, 10**6)
    with pytest.raises(files.MalformedFastq):
        list(records.records(part, True))
    assert [r[1].decode() for r in records.records(part, False)] == [r[0] for r in RECORDS[:8]]


def test_stream_reads_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.dataSource.register(records.FastqRecords)
    (tmp_path / "in" / "a.fastq").write_text(text(RECORDS[:10]))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        rows = spark.readStream.format("fastq_records").option("split_bytes", 50).load(str(tmp_path / "in"))
        run = rows.writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="0 seconds").start(out)
        run.processAllAvailable()
        run.stop()
        return sorted(r.name for r in spark.read.parquet(out).collect())

    assert go() == sorted(r[0] for r in RECORDS[:10])
    (tmp_path / "in" / "b.fastq").write_text(text(RECORDS[10:]))
    assert go() == sorted(r[0] for r in RECORDS)


def test_functions_in_sql_text(spark):
    registered.register(spark)
    row = spark.sql("SELECT revcomp('AACN') AS r, canonical('TTT') AS c, kmers('ACGT', 3) AS k, kmers('A', 3) AS none, hamming('ACG', 'ATG') AS h, packed('ACGT') AS p").first()
    assert (row.r, row.c, row.k, row.none, row.h, row.p) == ("NGTT", "AAA", ["ACG", "CGT"], [], 1, 27)
    rng = random.Random(3)
    rows = []
    for i in range(20):
        a = "".join(rng.choice("ACGT") for _ in range(90))
        rows.append((i, a, [a, a[:40] + a[43:], a[:40] + "ACGTT" + a[40:], a[:20] + "T" + a[21:]][i % 4]))
    rows.append((99, None, "ACGT"))
    spark.createDataFrame(rows, "pair_id long, left string, right string").createOrReplaceTempView("drawn_pairs")
    got = spark.sql("SELECT * FROM extract_bubbles(TABLE(SELECT pair_id, left, right FROM drawn_pairs))")
    want = [(i, *e) for i, a, b in rows if a for e in calling.gap_events(a, b)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert sorted(map(tuple, calling.scan_pairs(spark.table("drawn_pairs")).collect())) == sorted(want)
