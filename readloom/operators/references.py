"""Maximal exact matches inside a set of sequences, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.session import cut


def self_matches(texts: DataFrame, seed: int = 24, most: int = 64, key: str = "contig_id", turned: bool = False) -> DataFrame:
    """(dst_id, src_id, dst, src, size): maximal runs of equal bases of at least ``seed`` between two places.

    Both places are read forward, or the source on its other strand if ``turned``; then a run that is
    its own other strand has itself as its source.

    Each occurrence of a seed meets the seed's first ``most`` occurrences, by key and place.  So all
    pairs of a seed that occurs up to ``most`` times meet, and no occurrence of a hotter one is left
    without sources.  A run goes on as far as the bases agree.

    Seeds aren't made one by one: two texts that share a seed share its minimizer, so minimizers meet
    in an equi-join, and each pair of texts is compared along the diagonals on which some met.  A seed
    occurs no more often than its minimizer; only those of minimizers above ``most`` are ranked.
    """
    held = texts.select(key, S.reverse_complement(F.col("seq")).alias("seq")) if turned else texts
    ours = cut(minimizers(texts, seed, key))
    theirs = cut(minimizers(held, seed, key)) if turned else ours
    # written, so that a hot one's rows can be split in the join; joins are merges, as a written table's size is guessed far too low for broadcasts
    hot = cut(theirs.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("code"))
    a, b = theirs.select("code", F.col(key).alias("src_id"), F.col("pos").alias("src")), ours.select("code", F.col(key).alias("dst_id"), F.col("pos").alias("dst"), "lo", "hi")
    if hot.isEmpty():
        met = b.join(a.hint("merge"), "code")
    else:
        met = b.join(hot.hint("merge"), "code", "left_anti").join(a.hint("merge"), "code")
        seeds = lambda rows, text: rows.join(hot.hint("merge"), "code", "left_semi").select(key, F.explode(F.sequence("lo", "hi")).alias("pos")).join(text.select(key, "seq").hint("merge"), key).select(key, "pos", F.substring("seq", F.col("pos") + 1, F.lit(seed)).alias("kmer"), F.length("seq").alias("length"))
        place = F.col("length") - F.col("pos") if turned else F.col("pos")  # on the forward strand, but for a constant
        ranked = cut(seeds(theirs, held).withColumn("rank", F.row_number().over(Window.partitionBy("kmer").orderBy(key, place))).filter(F.col("rank") <= most))
        sources = ranked.select("kmer", F.col(key).alias("src_id"), F.col("pos").alias("src"))
        again = seeds(ours, texts).select("kmer", F.col(key).alias("dst_id"), F.col("pos").alias("dst"), F.col("pos").alias("lo"), F.col("pos").alias("hi")).join(sources.hint("merge"), "kmer")
        met = met.drop("code").unionByName(again.drop("kmer"))
    met = met.filter("src_id <= dst_id" if turned else "src_id < dst_id or (src_id = dst_id and src < dst)")
    spans = F.collect_list(F.struct((F.col("dst") - F.col("src")).alias("along"), "lo", "hi"))
    pairs = met.groupBy("dst_id", "src_id").agg(spans.alias("spans"))
    pairs = pairs.join(texts.select(F.col(key).alias("dst_id"), F.col("seq").alias("sd")).hint("merge"), "dst_id").join(held.select(F.col(key).alias("src_id"), F.col("seq").alias("ss")).hint("merge"), "src_id")
    kind = texts.schema[key].dataType.simpleString()
    found = pairs.select("dst_id", "src_id", "spans.along", "spans.lo", "spans.hi", "sd", "ss").mapInArrow(_compare(seed, turned), f"dst_id {kind}, src_id {kind}, dst long, src long, size long")
    return found.filter("src_id < dst_id or src <= dst")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of joined texts, and where each text begins, with their end."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


_STEP = 0x9E3779B97F4A7C15


def _least(texts: list[str], seed: int) -> tuple[np.ndarray, ...]:
    """(row, hash, pos, lo, hi) of the minimizers of all runs of ``seed`` letters: the run from lo to the run from hi have theirs at pos."""
    points, offsets = code_points(texts)
    if len(points) < seed:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    part, hashes = max(seed * 2 // 3, min(seed, 14)), None  # shorter ones would be shared by chance
    run, size, done = points.astype(np.uint64) + np.uint64(1), 1, 0
    while size <= part:  # put together from runs of powers of two, as are the windows' minima
        if part & size:
            hashes = run if hashes is None else hashes[: len(run) - done] * np.uint64(pow(_STEP, size, 1 << 64)) + run[done:]
            done += size
        run, size = run[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + run[size:], 2 * size
    hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)  # the first of equal ones
    window, size = seed - part + 1, 1
    while size < window:
        step = min(size, window - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    best = hashes[at]
    starts = np.arange(len(at))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(at)]
    inside = offsets[row + 1] - starts >= seed
    starts, row, at, best = starts[inside], row[inside], at[inside], best[inside]
    first = np.ones(len(starts), bool)
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(starts)) - 1 if len(begins) else begins
    row = row[begins]
    return row, best[begins].view(np.int64), at[begins] - offsets[row], starts[begins] - offsets[row], starts[ends] - offsets[row]


def minimizers(texts: DataFrame, seed: int, key: str, most: int = 1 << 20) -> DataFrame:
    """(key, code, pos, lo, hi): places of minimizers, by a hash, each with the first and last seed that it is least in."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = np.cumsum([len(t) for t in texts])
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // most)) + 1):  # some MB of letters at a time
                row, *numbers = _least([texts[i] for i in rows], seed)
                code, pos, lo, hi = numbers
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[row])), pa.array(code), *[pa.array(c.astype(np.int32)) for c in (pos, lo, hi)]], [key, "code", "pos", "lo", "hi"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.filter(F.length("seq") >= seed).select(key, "seq").mapInArrow(places, f"{key} {kind}, code long, pos int, lo int, hi int")


def held_windows(texts: DataFrame, wanted: DataFrame, size: int, key: str) -> DataFrame:
    """(key, seq, start, and the columns of ``wanted``): each place of a text that holds a wanted ``kmer`` of ``size`` letters.

    Texts and wanted meet by minimizers, as a text's windows are many and alike; the text is looked at then.
    Keys can repeat: all texts of a key are looked at, so these should be few.
    """
    asked = minimizers(wanted.select("kmer", F.col("kmer").alias("seq")).filter(F.length("seq") == size).distinct(), size, "kmer").select("kmer", "code", F.col("pos").alias("shift"))
    near = minimizers(texts, size, key).join(asked.hint("merge"), "code").withColumn("start", F.col("pos") - F.col("shift")).filter("start between lo and hi").select(key, "kmer", "start").distinct()
    held = near.join(texts.select(key, "seq").hint("merge"), key).filter(F.substring("seq", F.col("start") + 1, F.lit(size)) == F.col("kmer"))
    return held.join(wanted.hint("merge"), "kmer")


def _runs(ours: np.ndarray, theirs: np.ndarray, along: int, lo: np.ndarray, hi: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal runs of a diagonal that hold a seed from one of the spans; lo and hi in order."""
    low, high = max(0, along), min(len(ours), len(theirs) + along)
    equal = np.concatenate(([False], ours[low:high] == theirs[low - along : high - along], [False]))
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + low
    begin, end = edges[::2], edges[1::2]
    held = np.searchsorted(lo, end - seed, "right") > np.searchsorted(hi, begin)
    held &= end - begin >= seed
    return begin[held], end[held]


def _compare(seed: int, turned: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dst_id, src_id, along, lo, hi, sd, ss in zip(*[c.to_pylist() for c in batch.columns]):
                ours, theirs = code_points([sd])[0], code_points([ss])[0]
                along, lo, hi = np.array(along), np.array(lo), np.array(hi)
                order = np.lexsort((lo, along))
                along, lo, hi = along[order], lo[order], hi[order]
                for spans in np.split(np.arange(len(along)), np.flatnonzero(np.diff(along)) + 1):
                    line = int(along[spans[0]])
                    for begin, end in zip(*_runs(ours, theirs, line, lo[spans], np.maximum.accumulate(hi[spans]), seed)):
                        src = len(theirs) - (end - line) if turned else begin - line
                        out.append((dst_id, src_id, int(begin), int(src), int(end - begin)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.column(0).type, batch.column(1).type, pa.int64(), pa.int64(), pa.int64()])], ["dst_id", "src_id", "dst", "src", "size"])

    return rows


def both_strand_matches(texts: DataFrame, seed: int = 24, most: int = 64, key: str = "contig_id") -> DataFrame:
    """Maximal runs as ``self_matches`` gives them, with ``turned``: whether the source is read on its other strand."""
    forward = self_matches(texts, seed, most, key).withColumn("turned", F.lit(False))
    return forward.unionByName(self_matches(texts, seed, most, key, turned=True).withColumn("turned", F.lit(True)))


def tolerant(refs: DataFrame, texts: DataFrame, most: int = 2, key: str = "contig_id") -> DataFrame:
    """References that go on over differences: runs of one diagonal with at most ``most`` bases between them are one.

    refs: maximal exact runs, with ``turned`` or without.  edits: (off, base) of each base of the destination that the
    source doesn't give, off counted from the reference's first base; it begins and ends with equal bases, as exact runs
    do.  Runs are gaps and islands of a diagonal; only references that hold a difference meet their texts.
    """
    sides = ["turned"] if "turned" in refs.columns else []
    turn = F.col("turned") if sides else F.lit(False)
    along = F.when(turn, F.col("dst") + F.col("src") + F.col("size")).otherwise(F.col("dst") - F.col("src"))
    by = Window.partitionBy("dst_id", "src_id", "along", *sides).orderBy("dst")
    rows = refs.withColumn("along", along).withColumn("gap", F.col("dst") - F.lag(F.col("dst") + F.col("size")).over(by))
    rows = rows.withColumn("run", F.sum(F.when(F.col("gap") <= most, 0).otherwise(1)).over(by))
    gaps = F.collect_list(F.when(F.col("gap") <= most, F.struct(F.col("dst").alias("to"), "gap")))
    joined = rows.groupBy("dst_id", "src_id", "along", *sides, "run").agg(F.min("dst").alias("dst"), F.min("src").alias("src"), F.max(F.col("dst") + F.col("size")).alias("end"), gaps.alias("gaps"))
    joined = joined.select("dst_id", "src_id", "dst", "src", (F.col("end") - F.col("dst")).alias("size"), *sides, "gaps")
    plain = joined.filter(F.size("gaps") == 0).select("dst_id", "src_id", "dst", "src", "size", *sides, F.expr("cast(array() as array<struct<off: int, base: string>>)").alias("edits"))
    over = joined.filter(F.size("gaps") > 0).join(texts.select(F.col(key).alias("dst_id"), F.col("seq").alias("sd")).hint("merge"), "dst_id").join(texts.select(F.col(key).alias("src_id"), F.col("seq").alias("ss")).hint("merge"), "src_id")
    source = F.expr("substring(ss, cast(src as int) + 1, cast(size as int))")
    over = over.withColumns({"theirs": F.when(F.col("turned"), S.reverse_complement(source)).otherwise(source) if sides else source, "ours": F.expr("substring(sd, cast(dst as int) + 1, cast(size as int))")})
    places = F.flatten(F.transform("gaps", lambda g: F.sequence(g["to"] - g["gap"] - F.col("dst"), g["to"] - 1 - F.col("dst"))))
    letters = F.transform(places, lambda o: F.struct(o.cast("int").alias("off"), F.substring(F.col("ours"), o.cast("int") + 1, F.lit(1)).alias("base")))
    edits = F.array_sort(F.filter(letters, lambda e: e["base"] != F.substring(F.col("theirs"), e["off"] + 1, F.lit(1))))
    return plain.unionByName(over.select("dst_id", "src_id", "dst", "src", "size", *sides, edits.alias("edits")))


def adaptive_matches(texts: DataFrame, seed: int = 24, most: int = 64, key: str = "contig_id", k: int = 31, stride: int = 41, least_share: float = 0.024, differences: int = 2) -> DataFrame:
    """References of both strands, over up to ``differences`` bases in a row where the texts look heterozygous.

    They do if of the k-mers at every ``stride``-th place (a sampling operator) a share of ``least_share`` is seen exactly twice.
    """
    seen = texts.select(F.inline(S.kmers(F.col("seq"), k))).filter(F.col("pos") % stride == 0).groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))
    share = seen.agg(F.coalesce(F.avg((F.col("n") == 2).cast("double")), F.lit(0.0)).alias("share")).first().share
    return tolerant(both_strand_matches(texts, seed, most, key), texts, differences if share >= least_share else 0, key)


def edit_calls(refs: DataFrame, texts: DataFrame, key: str = "contig_id") -> DataFrame:
    """(chrom, pos from 1, ref, alt, info): substitutions that tolerant references pass over, as calls against the source's text.

    A difference seen from several destinations is one call, with their number; of a source read on its
    other strand, place and letters are turned back.
    """
    turn = F.col("turned") if "turned" in refs.columns else F.lit(False)
    rows = refs.select("src_id", "dst_id", turn.alias("turned"), "src", "size", F.explode("edits").alias("e"))
    at = F.when(F.col("turned"), F.col("src") + F.col("size") - 1 - F.col("e.off")).otherwise(F.col("src") + F.col("e.off"))
    alt = F.when(F.col("turned"), F.translate("e.base", "ACGT", "TGCA")).otherwise(F.col("e.base"))
    votes = rows.groupBy(F.col("src_id").alias("chrom"), at.alias("at"), alt.alias("alt")).agg(F.count_distinct("dst_id").alias("n"))
    letter = F.expr("substring(seq, cast(at as int) + 1, 1)")
    return votes.join(texts.select(F.col(key).alias("chrom"), "seq").hint("merge"), "chrom").select("chrom", (F.col("at") + 1).alias("pos"), letter.alias("ref"), "alt", F.concat(F.lit("MEM;SUP="), F.col("n")).alias("info"))


def trimmed(refs: DataFrame) -> DataFrame:
    """References trimmed at their left to begin where no earlier one reaches, per destination; what is left empty goes.

    With a column ``turned``, a reference of the other strand loses the end of its source; with ``edits``, those that are left move.
    """
    sides = ["turned"] if "turned" in refs.columns else []
    skipped = F.when(F.col("turned"), 0).otherwise(F.col("cut")) if sides else F.col("cut")
    by = Window.partitionBy("dst_id").orderBy("dst", F.desc("size"), "src_id", "src", *sides)
    reach = F.max(F.col("dst") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.greatest(F.coalesce(reach - F.col("dst"), F.lit(0)), F.lit(0))
    rows = refs.withColumn("cut", cut).filter("cut < size")
    edits = [F.transform(F.filter("edits", lambda e: e["off"] >= F.col("cut")), lambda e: F.struct((e["off"] - F.col("cut")).cast("int").alias("off"), e["base"].alias("base"))).alias("edits")] if "edits" in refs.columns else []
    return rows.select("dst_id", "src_id", (F.col("dst") + F.col("cut")).alias("dst"), (F.col("src") + skipped).alias("src"), (F.col("size") - F.col("cut")).alias("size"), *sides, *edits)


def literals(texts: DataFrame, refs: DataFrame, key: str = "contig_id") -> DataFrame:
    """(dst_id, start, bases): what the trimmed references of each sequence leave out."""
    marks = texts.select(F.col(key).alias("dst_id"), F.lit(0).cast("long").alias("dst"), F.lit(0).cast("long").alias("size")).union(texts.select(F.col(key), F.length("seq").cast("long"), F.lit(0).cast("long"))).union(refs.select("dst_id", "dst", "size"))
    by = Window.partitionBy("dst_id").orderBy("dst", "size")
    reach = F.max(F.col("dst") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.withColumn("start", reach).filter("start < dst").select("dst_id", "start", F.col("dst").alias("end"))
    return gaps.join(texts.select(F.col(key).alias("dst_id"), "seq").hint("merge"), "dst_id").select("dst_id", "start", F.expr("substring(seq, cast(start as int) + 1, cast(end - start as int))").alias("bases"))


def rebuilt(texts: DataFrame, refs: DataFrame, literal: DataFrame, key: str = "contig_id") -> DataFrame:
    """(dst_id, seq): literals and references put together again (sources are read from ``texts``)."""
    source = F.expr("substring(seq, cast(src as int) + 1, cast(size as int))")
    bases = F.when(F.col("turned"), S.reverse_complement(source)).otherwise(source) if "turned" in refs.columns else source
    bases = F.when(F.size("edits") > 0, S.with_letters(bases, F.col("edits.off"), F.col("edits.base"))).otherwise(bases) if "edits" in refs.columns else bases
    copied = refs.join(texts.select(F.col(key).alias("src_id"), "seq").hint("merge"), "src_id").select("dst_id", F.col("dst").alias("start"), bases.alias("bases"))
    return copied.union(literal).groupBy("dst_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("start", "bases"))).getField("bases"), "").alias("seq"))


def gap_indels(refs: DataFrame, most_gap: int = 64, most: int = 12) -> DataFrame:
    """(dst_id, src_id, pos, dst_gap, src_gap): neighbouring references whose gaps differ by 1 to ``most`` bases."""
    by = Window.partitionBy("dst_id", "src_id").orderBy("dst", "src")
    rows = refs.withColumns({"pos": F.lag(F.col("dst") + F.col("size")).over(by), "from": F.lag(F.col("src") + F.col("size")).over(by)})
    rows = rows.withColumns({"dst_gap": F.col("dst") - F.col("pos"), "src_gap": F.col("src") - F.col("from")})
    return rows.filter(F.col("dst_gap").between(0, most_gap) & F.col("src_gap").between(0, most_gap) & F.abs(F.col("dst_gap") - F.col("src_gap")).between(1, most)).select("dst_id", "src_id", "pos", "dst_gap", "src_gap")


def gap_substitutions(refs: DataFrame, texts: DataFrame, key: str = "contig_id") -> DataFrame:
    """(dst_id, src_id, pos, src_pos, ref, alt): single bases that differ between neighbouring references of one diagonal.

    ref is the source's base, alt the destination's; references are forward.
    """
    by = Window.partitionBy("dst_id", "src_id", F.col("dst") - F.col("src")).orderBy("dst")
    rows = refs.withColumns({"pos": F.lag(F.col("dst") + F.col("size")).over(by), "src_pos": F.lag(F.col("src") + F.col("size")).over(by)}).filter("dst - pos = 1")
    rows = rows.join(texts.select(F.col(key).alias("dst_id"), F.col("seq").alias("sd")).hint("merge"), "dst_id").join(texts.select(F.col(key).alias("src_id"), F.col("seq").alias("ss")).hint("merge"), "src_id")
    return rows.select("dst_id", "src_id", "pos", "src_pos", F.expr("substring(ss, cast(src_pos as int) + 1, 1)").alias("ref"), F.expr("substring(sd, cast(pos as int) + 1, 1)").alias("alt"))
