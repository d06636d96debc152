"""k-mers: counts, spectrum, depth, neighbours, graph edges, shared anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequence as S


def occurrences(seqs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, pos, kmer, rc): canonical k-mers without N; rc says whether the canonical form is the other strand's."""
    # the other strand is turned round once a read; both k-mers are substrings then, in compiled code
    rows = seqs.filter(F.length("seq") >= k).withColumn("turned", S.reverse_complement(F.col("seq")))
    rows = rows.select(key, "seq", "turned", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    rows = rows.select(key, "pos", F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("own"), F.substring("turned", F.length("seq") - F.col("pos") - k + 1, F.lit(k)).alias("other"))
    return rows.filter(~F.contains("own", F.lit("N"))).select(key, "pos", F.least("own", "other").alias("kmer"), (F.col("own") > F.col("other")).alias("rc"))


def sums(digits: np.ndarray, k: int, turned: bool) -> np.ndarray:
    """Numbers of two bits a base of all runs of k digits, first digit highest, or lowest if ``turned``; put together from runs of powers of two."""
    n, run, size, done, out = len(digits) - k + 1, digits, 1, 0, np.zeros(len(digits) - k + 1, np.int64)
    while size <= k:
        if k & size:
            out = out | run[done : done + n] << 2 * done if turned else out << 2 * size | run[done : done + n]
            done += size
        run, size = (run[:-size] | run[size:] << 2 * size if turned else run[:-size] << 2 * size | run[size:]), 2 * size
    return out


def _canonical(text: str) -> str:
    return min(text, text.translate(_TURN)[::-1])


_TURN = str.maketrans("ACGT", "TGCA")
_KIND = np.full(256, 5, np.uint8)  # 4: N, 5: any other letter
_KIND[list(b"ACGTN")] = range(5)


def _packed(data: np.ndarray, offsets: np.ndarray, k: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Of joined sequences: numbers of canonical k-mers without N with their counts, and one by one those with other letters than A, C, G, T."""
    kind, odd = _KIND[data], []
    for row in np.unique(np.searchsorted(offsets, np.flatnonzero(data >= 128), "right") - 1):  # letters of several bytes: read as text
        text, kind[offsets[row] : offsets[row + 1]] = data[offsets[row] : offsets[row + 1]].tobytes().decode(), 4
        odd += [_canonical(w) for w in (text[i : i + k] for i in range(len(text) - k + 1)) if "N" not in w]
    yield np.empty(0, np.int64), np.empty(0, np.int64), odd
    for at in range(0, len(data) - k + 1, chunk):
        part = kind[at : at + chunk + k - 1]
        starts = np.arange(at, at + len(part) - k + 1)
        inside = offsets[np.searchsorted(offsets, starts, "right")] - starts >= k
        has = lambda m: (c := np.concatenate(([0], np.cumsum(m))))[k:] > c[:-k]
        inside &= ~has(part == 4)
        other = inside & has(part == 5) if (part == 5).any() else np.zeros(len(starts), bool)
        digits = (part & 3).astype(np.int64)
        found, n = np.unique(np.minimum(sums(digits, k, False), sums(3 - digits, k, True))[inside & ~other], return_counts=True)
        yield found, n, [_canonical(data[i : i + k].tobytes().decode()) for i in starts[other]]


def count(seqs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(kmer, cnt), partially aggregated before the shuffle; k-mers of up to 31 bases are numbers until then."""
    if k > 31:
        return occurrences(seqs, k, key).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return counted(seqs, k).select(F.coalesce("odd", S.unpacked(F.col("code"), k)).alias("kmer"), "cnt")


def counted(seqs: DataFrame, k: int) -> DataFrame:
    """(code, odd, cnt): canonical k-mers of up to 31 bases as numbers, those with other letters as text."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            lengths = texts.buffers()[1]
            offsets = np.frombuffer(lengths, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            for found, n, odd in _packed(data, offsets - offsets[0], k):
                code, n = pa.concat_arrays([pa.array(found), pa.nulls(len(odd), pa.int64())]), pa.concat_arrays([pa.array(n), pa.array([1] * len(odd), pa.int64())])
                yield pa.RecordBatch.from_arrays([code, pa.concat_arrays([pa.nulls(len(found), pa.string()), pa.array(odd, pa.string())]), n], ["code", "odd", "n"])

    # k-mers that are text in a row with other letters, yet hold none themselves, are numbers too
    plain = F.col("odd").rlike("^[ACGT]+$")
    rows = seqs.filter(F.length("seq") >= k).select("seq").mapInArrow(numbers, "code long, odd string, n long")
    rows = rows.select(F.when(plain, S.packed(F.col("odd"))).otherwise(F.col("code")).alias("code"), F.when(~plain, F.col("odd")).alias("odd"), "n")
    return rows.groupBy("code", "odd").agg(F.sum("n").alias("cnt"))


def _other_strand(rows: DataFrame, code: str, name: str, k: int) -> DataFrame:
    """With the number of the other strand: digits complemented, then swapped in pairs, fours, and so on; a column a step, as each asks for the last twice."""
    rows = rows.withColumn(name, F.bitwise_not(code))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x, m = F.col(name), F.lit(mask).cast("long")
        rows = rows.withColumn(name, F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift)))
    return rows.withColumn(name, F.shiftrightunsigned(name, 64 - 2 * k))


def spectrum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def haploid_depth(histogram: DataFrame, most: int = 2000, fallback: int = 30, least: int = 5) -> DataFrame:
    """One row (h): the peak of the histogram after its first valley in the first third; the earlier at ties.

    Works on the histogram, of at most ``most`` rows, so its one-partition window is bounded.
    """
    rows = histogram.filter(F.col("cnt").between(2, most))
    top = rows.agg(F.max("cnt").alias("top"))
    by = Window.orderBy("cnt")
    near = rows.withColumns({"before": F.lag("n_kmers").over(by), "after": F.lead("n_kmers").over(by)}).crossJoin(F.broadcast(top))
    valley = near.filter((F.col("cnt") <= F.col("top") / 3) & (F.col("n_kmers") <= F.col("before")) & (F.col("n_kmers") < F.col("after"))).agg(F.min("cnt").alias("valley"))
    peak = rows.crossJoin(F.broadcast(valley)).filter(F.col("cnt") >= F.coalesce("valley", F.lit(2))).agg(F.max_by("cnt", F.struct("n_kmers", -F.col("cnt"))).alias("peak"))
    return peak.select(F.when(F.col("peak") >= least, F.col("peak")).otherwise(F.lit(fallback)).cast("long").alias("h"))


def _neighbours(kmers: DataFrame, k: int) -> DataFrame:
    """(asked, kmer): the canonical k-mers that differ from each in one base; plain projections, so that they compile."""
    places = kmers.select(F.col("kmer").alias("asked"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    changed = [F.when(F.substring(F.col("asked"), F.col("i"), F.lit(1)) != b, F.overlay("asked", F.lit(b), F.col("i"), F.lit(1))) for b in "ACGT"]
    return places.select("asked", F.explode(F.array(*changed)).alias("other")).filter("other is not null").select("asked", S.canonical(F.col("other")).alias("kmer"))


def neighbour_share(counts: DataFrame, k: int, least: Column, stride: int = 1) -> DataFrame:
    """One row: among k-mers counted at least ``least`` times, the share with a neighbour that is too.

    With ``stride`` only k-mers whose hash it divides are looked up (a sampling operator)."""
    solid = counts.filter(F.col("cnt") >= least).select("kmer")
    asked = solid.filter(F.pmod(F.crc32("kmer"), F.lit(stride)) == 0)
    near = _neighbours(asked, k).join(solid.hint("merge"), "kmer", "left_semi").select("asked").distinct()
    found = asked.join(near.hint("merge"), F.col("kmer") == F.col("asked"), "left")
    return found.agg(F.count("*").alias("n_kmers"), F.count("asked").alias("n_with"), F.round(F.count("asked") / F.count("*"), 6).alias("share"))


def pair_share(counts: DataFrame) -> DataFrame:
    """One row: the share of k-mers seen exactly twice."""
    return counts.agg(F.count("*").alias("n_kmers"), F.count_if(F.col("cnt") == 2).alias("n_twice"), F.round(F.count_if(F.col("cnt") == 2) / F.count("*"), 6).alias("share"))


def oriented(counts: DataFrame, least: int = 2) -> DataFrame:
    """Both strands of each solid k-mer; a palindrome once."""
    solid = counts.filter(F.col("cnt") >= least)
    return solid.select(F.explode(F.array_distinct(F.array(F.col("kmer"), S.reverse_complement(F.col("kmer"))))).alias("node"), "cnt")


def successors(nodes: DataFrame, k: int) -> DataFrame:
    """(node, next, cnt): edges of the implicit de Bruijn graph, as an equi-join on k-1 bases."""
    a = nodes.select("node", F.substring("node", 2, k - 1).alias("shared"))
    b = nodes.select(F.col("node").alias("next"), F.substring("node", 1, k - 1).alias("shared"), "cnt")
    return a.join(b.hint("merge"), "shared").select("node", "next", "cnt")


def solid_edges(counts: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(node, next, cnt): ``successors`` of the ``oriented`` k-mers that are counted (as by ``counted``, k of 2 to 31), found on one strand of each shared run of k-1 bases.

    An edge over a run is an edge over the run's other strand, the other way round, so only the ends
    that have the smaller strand of their run outwards meet, as numbers, and give both edges.
    """
    solid = counts.filter(F.col("cnt") >= least)
    mask, digit = F.lit((1 << 2 * (k - 1)) - 1).cast("long"), lambda x: F.substring(F.lit("ACGT"), x.cast("int") + 1, F.lit(1))
    plain = _other_strand(solid.filter("odd is null").select(F.col("code").alias("own"), "cnt"), "own", "turned", k)
    front, rest = lambda x: F.shiftrightunsigned(x, 2), lambda x: F.col(x).bitwiseAND(mask)
    plain = plain.select("cnt", (F.col("own") != F.col("turned")).alias("twice"), front("own").alias("p"), rest("own").alias("q"), rest("turned").alias("rp"), front("turned").alias("rq"), digit(F.shiftrightunsigned("own", 2 * k - 2)).alias("first"), digit(F.col("own").bitwiseAND(F.lit(3).cast("long"))).alias("last"))
    turned = S.reverse_complement(F.col("odd"))
    texts = solid.filter("odd is not null").select("cnt", (F.col("odd") != turned).alias("twice"), F.left("odd", F.lit(k - 1)).alias("p"), F.right("odd", F.lit(k - 1)).alias("q"), F.right(turned, F.lit(k - 1)).alias("rp"), F.left(turned, F.lit(k - 1)).alias("rq"), F.left("odd", F.lit(1)).alias("first"), F.right("odd", F.lit(1)).alias("last"))
    other = lambda x: F.translate(x, "ACGT", "TGCA")

    def ends(rows: DataFrame, run: str, back: str, base: str, run_2: str, back_2: str, base_2: str) -> DataFrame:
        own = F.when(F.col(run) <= F.col(back), F.struct(F.col(run).alias("run"), F.col(base).alias("base")))
        theirs = F.when(F.col("twice") & (F.col(run_2) <= F.col(back_2)), F.struct(F.col(run_2).alias("run"), other(F.col(base_2)).alias("base")))
        return rows.select("cnt", F.inline(F.array_compact(F.array(own, theirs))))

    def side(*names: str) -> DataFrame:
        odd = F.when(~F.col("run").rlike("^[ACGT]*$"), F.col("run"))
        named = ends(texts, *names).select(F.when(odd.isNull(), S.packed(F.col("run"))).otherwise(F.xxhash64("run")).alias("code"), odd.alias("odd"), "base", "cnt")
        return ends(plain, *names).select(F.col("run").alias("code"), F.lit(None).cast("string").alias("odd"), "base", "cnt").union(named)

    before = side("q", "rq", "first", "rp", "p", "last").select("code", F.col("odd").alias("odd_a"), F.col("base").alias("a"), F.col("cnt").alias("cnt_a"))
    after = side("p", "rp", "last", "rq", "q", "first").withColumnRenamed("base", "b")
    met = before.join(after.hint("merge"), "code").filter(F.col("odd").eqNullSafe(F.col("odd_a")))
    met = met.withColumn("run", F.coalesce("odd", S.unpacked(F.col("code"), k - 1))).withColumn("back", S.reverse_complement(F.col("run")))
    edge = F.struct(F.concat("a", "run").alias("node"), F.concat("run", "b").alias("next"), F.col("cnt").alias("cnt"))
    mirrored = F.struct(F.concat(other(F.col("b")), "back").alias("node"), F.concat("back", other(F.col("a"))).alias("next"), F.col("cnt_a").alias("cnt"))
    return met.select(F.inline(F.when(F.col("run") == F.col("back"), F.array(edge)).otherwise(F.array(edge, mirrored))))


def anchor_pairs(occ: DataFrame, key: str = "contig_id", most: int = 4) -> DataFrame:
    """Pairs of contigs that share a k-mer that occurs 2 to ``most`` times, with how many anchors they share.

    The occurrence bound is the operator's definition, and keeps a k-mer's pairs to a few.
    """
    few = occ.groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most)).select("kmer")
    kept = occ.join(few.hint("merge"), "kmer")
    a, b = kept.select("kmer", F.col(key).alias("a"), "pos", "rc"), kept.select("kmer", F.col(key).alias("b"), F.col("pos").alias("pos_b"), F.col("rc").alias("rc_b"))
    return a.join(b.hint("merge"), "kmer").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_anchors"), F.count_if(F.col("rc") != F.col("rc_b")).alias("n_turned"))


def junction_support(counts: DataFrame, junctions: DataFrame, k: int) -> DataFrame:
    """(junction_id, support): the smallest count of the k-mers that span each junction sequence; missing counts as 0."""
    spanning = junctions.select("junction_id", F.inline(S.kmers(F.col("seq"), k))).select("junction_id", S.canonical(F.col("kmer")).alias("kmer"))
    return spanning.join(counts.hint("merge"), "kmer", "left").groupBy("junction_id").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("support"), F.max(F.coalesce("cnt", F.lit(0))).alias("strongest"))
