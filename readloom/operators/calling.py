"""Variants from piled-up reads and from contigs that share anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators.references import held_windows

EVENTS = "pair_id long, at long, kind string, size long, bases string"
CHUNK, ROWS, BASES, DEFAULT_QUALITY = 1 << 16, 1 << 13, 1 << 22, 40  # of a step: rows, whose groups are numbers of 13 bits, and bases
_LETTER = np.full(256, 4, np.uint8)
_LETTER[list(b"ACGT")] = range(4)
LEAST_DEPTH, LEAST_MINOR, LEAST_QUALITY, LEAST_RATIO, LEAST_SHARE = 6, 2, 20, 10.0, 0.20


def pileup(placed: DataFrame) -> DataFrame:
    """(contig_id, pos, base, q, read_id): each base of each placed read, on the contig's strand.

    placed: read_id, contig_id, start, seq (as on the contig), quals (array of int; missing counts as 40).
    """
    letters = F.posexplode(F.arrays_zip(F.split("seq", "").alias("base"), F.col("quals").alias("q"))).alias("at", "x")
    rows = placed.select("read_id", "contig_id", "start", letters)
    return rows.select("contig_id", (F.col("start") + F.col("at")).cast("long").alias("pos"), F.col("x.base").alias("base"), F.coalesce("x.q", F.lit(40)).alias("q"), "read_id").filter("base in ('A', 'C', 'G', 'T')")


def base_counts(piled: DataFrame) -> DataFrame:
    """(contig_id, pos, n_a, n_c, n_g, n_t, depth)."""
    return piled.groupBy("contig_id", "pos").agg(*[F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGT"], F.count("*").alias("depth"))


def _chunked(placed: DataFrame) -> DataFrame:
    """Placed reads with each chunk of their contig that they reach, dealt by chunk and in order of their starts."""
    last = F.floor((F.col("start") + F.length("seq") - 1) / CHUNK)
    rows = placed.filter(F.length("seq") > 0).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), last)))
    return rows.repartition("contig_id", "chunk").sortWithinPartitions("contig_id", "chunk", "start")


def _cells(batch: pa.RecordBatch, group: np.ndarray, q: bool, base: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of group, place in the chunk, base and quality of all bases of a batch, and how often each is there."""
    texts = batch.column("seq")
    if pc.any(pc.greater(pc.binary_length(texts), pc.utf8_length(texts))).as_py():  # a letter of several bytes is one base
        texts = pc.replace_substring_regex(texts, r"[^\x00-\x7F]", "N")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letter, size = _LETTER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]], np.diff(offsets)
    at = np.arange(len(letter)) - np.repeat(offsets[:-1] - offsets[0], size)
    place = at + np.repeat(batch.column("start").to_numpy() - batch.column("chunk").to_numpy() * CHUNK, size)
    inside = (letter < 4) & (place >= 0) & (place < CHUNK)
    key = np.repeat(group, size) << 50 | place << 34
    if base:
        key |= letter.astype(np.int64) << 32
    if q:
        lists = batch.column("quals")
        first, n = np.repeat(lists.offsets.to_numpy()[:-1], size), np.repeat(lists.value_lengths().to_numpy(), size)
        values = np.append(pc.fill_null(lists.values, DEFAULT_QUALITY).to_numpy(), DEFAULT_QUALITY).astype(np.int64)
        key |= values[np.where(at < n, first + at, -1)] + (1 << 31)
    return np.unique(key[inside], return_counts=True)


def _swept(placed: DataFrame, schema: str, columns: Callable, q: bool, base: bool) -> DataFrame:
    """What ``columns`` makes of the columns of a pile, in one sweep along each chunk of each contig.

    Reads come in the order of their starts, so a column is whole as soon as a read starts after it: a task
    holds the columns that the last read can still reach, as counts, and the pile is never a table.
    """

    def out(ids: pa.Array, chunks: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            first = np.flatnonzero(np.diff(key >> 34, prepend=-1))
            group, place = key[first] >> 50, key[first] >> 34 & (1 << 16) - 1
            made = columns(key, n, first)
            if (kept := made.pop("kept", None)) is not None:
                group, place = group[kept], place[kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(group)), pa.array(chunks[group] * CHUNK + place), *made.values()], ["contig_id", "pos", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # contig, chunk, numbers and counts of the columns that aren't whole yet
        for whole in batches:
            rows = max(1, min(ROWS, BASES // max(1, pc.max(pc.binary_length(whole.column("seq"))).as_py() or 0)))
            for batch in (whole.slice(i, rows) for i in range(0, len(whole), rows)):
                chunk, code = batch.column("chunk").to_numpy(), pc.fill_null(batch.column("contig_id").dictionary_encode().indices, -1).to_numpy()
                new = np.concatenate(([True], (np.diff(code) != 0) | (np.diff(chunk) != 0)))
                group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
                ids, chunks = batch.column("contig_id").take(pa.array(heads)), chunk[heads]
                key, n = _cells(batch, group, q, base)
                if held:
                    if held[0].equals(ids.slice(0, 1)) and held[1] == chunks[:1]:
                        key, back = np.unique(np.concatenate((held[2], key)), return_inverse=True)
                        n = np.bincount(back, np.concatenate((held[3], n)), len(key)).astype(np.int64)
                    else:
                        yield from out(*held)
                reach = batch.column("start")[-1].as_py() - int(chunk[-1]) * CHUNK
                done = np.searchsorted(key, (len(heads) - 1 << 50) + (max(reach, 0) << 34))
                yield from out(ids, chunks, key[:done], n[:done])
                held = ids.slice(len(heads) - 1), chunks[-1:], key[done:] & (1 << 50) - 1, n[done:]
        if held:
            yield from out(*held)

    kind = placed.select("contig_id").schema[0].dataType.simpleString()
    return _chunked(placed).mapInArrow(run, f"contig_id {kind}, pos long, {schema}")


def column_counts(placed: DataFrame) -> DataFrame:
    """(contig_id, pos, n_a, n_c, n_g, n_t, depth): ``base_counts`` of the pile of placed reads (contig_id, start, seq), without making it."""

    def columns(key: np.ndarray, n: np.ndarray, first: np.ndarray) -> dict[str, pa.Array]:
        letter = key >> 32 & 3
        counts = {f"n_{b}": np.add.reduceat(np.where(letter == i, n, 0), first) for i, b in enumerate("acgt")}
        return {name: pa.array(x) for name, x in (counts | {"depth": np.add.reduceat(n, first)}).items()}

    return _swept(placed.select("contig_id", F.col("start").cast("long").alias("start"), "seq"), "n_a long, n_c long, n_g long, n_t long, depth long", columns, False, True)


def column_medians(placed: DataFrame) -> DataFrame:
    """(contig_id, pos, upper_median): of the qualities in each column of the pile of placed reads, that at n div 2 of their order, from 0."""

    def columns(key: np.ndarray, n: np.ndarray, first: np.ndarray) -> dict[str, pa.Array]:
        upto, size = np.cumsum(n), np.add.reduceat(n, first)
        middle = np.searchsorted(upto, upto[first] - n[first] + size // 2, "right")
        return {"upper_median": pa.array(((key[middle] & (1 << 32) - 1) - (1 << 31)).astype(np.int32))}

    rows = placed.select("contig_id", F.col("start").cast("long").alias("start"), "seq", F.col("quals").cast("array<int>").alias("quals")).filter("quals is not null")
    return _swept(rows, "upper_median int", columns, True, False)


def column_pairs(placed: DataFrame, ploidy: int = 2) -> DataFrame:
    """(contig_id, pos, major, minor, n_major, n_minor, depth, ratio, log_hom, log_het): columns of the pile of placed reads that pass depth, count and quality.

    What ``snv_candidates`` makes of a histogram before it asks for the ratio, with the sums of
    ``log_likelihoods``, found as the pile is swept: neither is a table.
    """

    def columns(key: np.ndarray, n: np.ndarray, first: np.ndarray) -> dict[str, pa.Array]:
        size, of = len(first), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        letter, q = key >> 32 & 3, (key & (1 << 32) - 1) - (1 << 31)
        cell = of * 4 + letter
        counts = np.bincount(cell, n, 4 * size).astype(np.int64).reshape(size, 4)
        order = np.argsort(-counts, 1, "stable")
        at = lambda table, r: np.take_along_axis(table, order[:, r : r + 1], 1)[:, 0]
        depth, n_minor = counts.sum(1), at(counts, 1)
        n_extra = at(counts, ploidy) if ploidy < 4 else 0 * depth
        kept = (depth >= LEAST_DEPTH) & (n_minor >= LEAST_MINOR) & (n_minor / depth >= LEAST_SHARE * 2 / ploidy) & (n_extra / depth <= 0.12)
        e = 10.0 ** (-q / 10)
        own, other, half = (np.bincount(cell, np.log(np.maximum(p, 1e-300)) * n, 4 * size).reshape(size, 4) for p in (1 - e, e / 3, (1 - e + e / 3) / 2))
        wrong = other.sum(1) - at(other, 0)
        # of the minor allele's qualities, in their order: the middle one, or the mean of both
        rows = np.flatnonzero(kept[of] & (letter == order[:, 1][of]))
        upto, below = np.cumsum(n[rows]), np.cumsum(np.where(kept, n_minor, 0)) - n_minor
        middle = lambda i: q[rows[np.searchsorted(upto, (below + i)[kept], "right")]]
        kept[kept] = middle((n_minor - 1) // 2) + middle(n_minor // 2) >= 2 * LEAST_QUALITY
        letters = np.array(list("ACGT"))
        hom, het = at(own, 0) + wrong, at(half, 0) + at(half, 1) + wrong - at(other, 1)
        ratio = (at(half, 0) + at(half, 1) - at(own, 0) - at(other, 1)) * 10 / np.log(10.0)
        made = {"major": letters[order[:, 0]], "minor": letters[order[:, 1]], "n_major": at(counts, 0), "n_minor": n_minor, "depth": depth, "ratio": ratio, "log_hom": hom, "log_het": het}
        return {name: pa.array(x[kept]) for name, x in made.items()} | {"kept": kept}

    rows = placed.select("contig_id", F.col("start").cast("long").alias("start"), "seq", F.col("quals").cast("array<int>").alias("quals")).filter("quals is not null")
    found = _swept(rows, "major string, minor string, n_major long, n_minor long, depth long, ratio double, log_hom double, log_het double", columns, True, True)
    return found.withColumn("ratio", F.round("ratio", 4))


def column_candidates(placed: DataFrame, ploidy: int = 2) -> DataFrame:
    """``snv_candidates`` of the pile of placed reads, without making it."""
    return column_pairs(placed, ploidy).filter(F.col("ratio") >= LEAST_RATIO).drop("log_hom", "log_het")


def column_alleles(placed: DataFrame, ploidy: int, share: float = 0.2) -> DataFrame:
    """``multiallelic`` of the pile of placed reads (contig_id, start, seq), without making it."""
    counted = column_counts(placed).filter(F.col("depth") >= LEAST_DEPTH)
    bases = F.array_sort(F.array(*[F.struct((-F.col(f"n_{b.lower()}")).alias("less"), F.lit(b).alias("base")) for b in "ACGT"]))
    enough = F.filter(bases, lambda x: (-x["less"] >= LEAST_MINOR) & (-x["less"] / F.col("depth") >= share * 2 / ploidy))
    out = counted.withColumn("kept", enough).select("contig_id", "pos", F.array_join(F.transform("kept", lambda x: x["base"]), ",").alias("alleles"), F.size("kept").cast("long").alias("n_alleles"))
    return out.filter(F.col("n_alleles").between(2, ploidy))


def histogram(piled: DataFrame) -> DataFrame:
    """(contig_id, pos, base, q, n), dealt by column: all that alleles and likelihoods ask of a pile, so that one is computed."""
    return piled.groupBy("contig_id", "pos", "base", "q").agg(F.count("*").alias("n")).repartition("contig_id", "pos")


def ranked_alleles(counted: DataFrame) -> DataFrame:
    """(contig_id, pos, base, n, median_q, rank): alleles of each column of a histogram by count, ties A, C, G, T."""
    alleles = counted.groupBy("contig_id", "pos", "base").agg(F.sum("n").alias("n"), F.percentile("q", 0.5, F.col("n")).alias("median_q"))
    return alleles.withColumn("rank", F.row_number().over(Window.partitionBy("contig_id", "pos").orderBy(F.desc("n"), "base")))


def log_likelihoods(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(contig_id, pos, log_hom, log_het): of a histogram's reads given the major allele alone, or both alleles at one half."""
    e = S.error_probability(F.col("q"))
    hom = F.when(F.col("base") == F.col("major"), 1 - e).otherwise(e / 3)
    other = F.when(F.col("base") == F.col("minor"), 1 - e).otherwise(e / 3)
    floor = lambda p: F.log(F.greatest(p, F.lit(1e-300))) * F.col("n")
    return counted.join(pairs.select("contig_id", "pos", "major", "minor").hint("merge"), ["contig_id", "pos"]).groupBy("contig_id", "pos").agg(F.sum(floor(hom)).alias("log_hom"), F.sum(floor((hom + other) / 2)).alias("log_het"))


def site_sums(counted: DataFrame) -> DataFrame:
    """(contig_id, pos, depth, alleles): of each column of a histogram, its alleles from the most common (ties A, C, G, T).

    alleles: (n, base, own, other, half), the last three being sums of logarithms over that base's
    reads of being right, of being wrong, and of coming from one of two alleles.  The sums add up,
    so one aggregate has what any pair of alleles is judged by.
    """
    e = S.error_probability(F.col("q"))
    logs = {"own": 1 - e, "other": e / 3, "half": (1 - e + e / 3) / 2}
    rows = counted.select("contig_id", "pos", "base", "n", *[(F.log(F.greatest(p, F.lit(1e-300))) * F.col("n")).alias(name) for name, p in logs.items()])
    of = lambda c, b: F.coalesce(F.sum(F.when(F.col("base") == b, F.col(c))), F.lit(0)).alias(f"{c}_{b}")
    sums = rows.groupBy("contig_id", "pos").agg(F.sum("n").alias("depth"), *[of(c, b) for b in "ACGT" for c in ("n", *logs)])
    # the key of the sort is minus the count, then the letter
    alleles = F.array(*[F.struct((-F.col(f"n_{b}")).alias("less"), F.lit(b).alias("base"), *[F.col(f"{c}_{b}").alias(c) for c in ("n", *logs)]) for b in "ACGT"])
    return sums.select("contig_id", "pos", "depth", F.array_sort(alleles).alias("alleles"))


def snv_candidates(counted: DataFrame, ploidy: int = 2) -> DataFrame:
    """(contig_id, pos, major, minor, n_major, n_minor, depth, ratio): columns of a histogram that pass depth, count, quality and likelihood.

    ratio is ten times the log10 of the odds of two alleles against one, rounded to 4 places.  The
    median quality of the minor allele is taken only where all else passes.
    """
    at = lambda r, c: F.get("alleles", r)[c]
    extra = at(ploidy, "n") if ploidy < 4 else F.lit(0)
    # two alleles against one: reads of the major come from either, those of the minor are right, all others are wrong both ways
    odds = at(0, "half") + at(1, "half") - at(0, "own") - at(1, "other")
    pairs = site_sums(counted).select("contig_id", "pos", at(0, "base").alias("major"), at(1, "base").alias("minor"), at(0, "n").alias("n_major"), at(1, "n").alias("n_minor"), "depth", F.round(odds * 10 / F.log(F.lit(10.0)), 4).alias("ratio"), extra.alias("n_extra"))
    pairs = pairs.filter((F.col("depth") >= LEAST_DEPTH) & (F.col("n_minor") >= LEAST_MINOR) & (F.col("n_minor") / F.col("depth") >= LEAST_SHARE * 2 / ploidy) & (F.col("n_extra") / F.col("depth") <= 0.12) & (F.col("ratio") >= LEAST_RATIO))
    asked = pairs.select("contig_id", "pos", F.col("minor").alias("base"))
    good = counted.join(asked.hint("merge"), ["contig_id", "pos", "base"]).groupBy("contig_id", "pos").agg(F.percentile("q", 0.5, F.col("n")).alias("minor_q")).filter(F.col("minor_q") >= LEAST_QUALITY)
    return pairs.join(good.hint("merge"), ["contig_id", "pos"], "left_semi").select("contig_id", "pos", "major", "minor", "n_major", "n_minor", "depth", "ratio")


def multiallelic(counted: DataFrame, ploidy: int, share: float = 0.2) -> DataFrame:
    """(contig_id, pos, alleles, n_alleles): columns with 2 to ``ploidy`` alleles of that share, by count, then letter."""
    depth = Window.partitionBy("contig_id", "pos")
    kept = ranked_alleles(counted).withColumn("depth", F.sum("n").over(depth)).filter((F.col("depth") >= LEAST_DEPTH) & (F.col("n") >= LEAST_MINOR) & (F.col("n") / F.col("depth") >= share * 2 / ploidy))
    out = kept.groupBy("contig_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "base"))), lambda x: x["base"]), ",").alias("alleles"), F.count("*").alias("n_alleles"))
    return out.filter(F.col("n_alleles").between(2, ploidy))


def over_sites(placed: DataFrame, sites: DataFrame, bin_size: int = 256) -> DataFrame:
    """(contig_id, start, seq, pos, at): placed reads with each site that they cover; an equi-join on bins of the contig, a read being in all its bins."""
    rows = placed.select("contig_id", "start", "seq", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("start") + F.length("seq") - 1) / bin_size))).alias("bin"))
    near = rows.join(sites.select("contig_id", "pos", F.floor(F.col("pos") / bin_size).alias("bin")).hint("merge"), ["contig_id", "bin"])
    return near.select("contig_id", "start", "seq", "pos", (F.col("pos") - F.col("start")).alias("at")).filter("at >= 0 and at < length(seq)")


def flank_modes(placed: DataFrame, sites: DataFrame, flank: int = 15) -> DataFrame:
    """(contig_id, pos, base, flank, n): the most common flank of each allele, ties to the smaller string."""
    rows = over_sites(placed, sites).filter(f"at >= {flank} and at + {flank} < length(seq)")
    seen = rows.select("contig_id", "pos", F.expr("substring(seq, at + 1, 1)").alias("base"), F.expr(f"substring(seq, at - {flank} + 1, {2 * flank + 1})").alias("flank")).groupBy("contig_id", "pos", "base", "flank").agg(F.count("*").alias("n"))
    by = Window.partitionBy("contig_id", "pos", "base").orderBy(F.desc("n"), "flank")
    return seen.withColumn("rank", F.row_number().over(by)).filter("rank = 1").drop("rank")


def distinct_read_votes(votes: DataFrame, least: int = 3) -> DataFrame:
    """(event, n_reads, first): events that ``least`` distinct reads or more speak for; votes: event, read_id, contig_id, pos."""
    return votes.groupBy("event").agg(F.count_distinct("read_id").alias("n_reads"), F.min(F.struct("contig_id", "pos")).alias("first")).filter(F.col("n_reads") >= least)


def cross_contig_snvs(occ: DataFrame, seqs: DataFrame, k: int, reach: int = 12, least_anchors: int = 15) -> DataFrame:
    """(a, b, pos_a, pos_b, ref, alt, n_anchors): single-base differences right after k-mers that two contigs share and no other has.

    The ``reach`` bases after the difference have to be equal.  ``occ`` is of forward k-mers.
    """
    two = occ.groupBy("kmer").agg(F.count("*").alias("n"), F.min("contig_id").alias("a"), F.max("contig_id").alias("b"), F.min_by("pos", "contig_id").alias("pa"), F.max_by("pos", "contig_id").alias("pb")).filter("n = 2 and a < b")
    both = two.join(seqs.select(F.col("contig_id").alias("a"), F.col("seq").alias("sa")).hint("merge"), "a").join(seqs.select(F.col("contig_id").alias("b"), F.col("seq").alias("sb")).hint("merge"), "b")
    both = both.select("a", "b", (F.col("pa") + k).cast("long").alias("pos_a"), (F.col("pb") + k).cast("long").alias("pos_b"), F.expr(f"substring(sa, pa + {k} + 1, 1)").alias("ref"), F.expr(f"substring(sb, pb + {k} + 1, 1)").alias("alt"), F.expr(f"substring(sa, pa + {k} + 2, {reach})").alias("ta"), F.expr(f"substring(sb, pb + {k} + 2, {reach})").alias("tb"))
    differ = both.filter(f"ref <> alt and ta = tb and length(ta) = {reach}").select("a", "b", "pos_a", "pos_b", "ref", "alt")
    anchors = two.groupBy("a", "b").agg(F.count("*").alias("n_anchors")).filter(F.col("n_anchors") >= least_anchors)
    return differ.join(anchors.hint("merge"), ["a", "b"]).distinct()


def extract_gap(left: Column, right: Column, at: Column, most: int = 30, flank: int = 15) -> Column:
    """(kind, at, size, bases) of the first gap that lines up two sequences from their first difference ``at``, as an array of one or none.

    Insertions (in ``right``) of 1 to ``most`` bases are tried before deletions; after the gap
    ``flank`` bases have to be equal.  The smallest size is where the ``flank`` bases of one side are first found in the other.
    """
    def size(text: Column, other: Column) -> Column:
        asked = F.substring(text, at + 1, F.lit(flank))
        return F.when(F.length(asked) == flank, F.nullif(F.instr(F.substring(other, at + 2, F.lit(most + flank - 1)), asked), F.lit(0)))

    inserted, deleted = size(left, right), size(right, left)
    gap = lambda kind, text, n: F.struct(F.lit(kind).alias("kind"), at.alias("at"), n.alias("size"), F.substring(text, at + 1, n).alias("bases"))
    return F.array_compact(F.array(F.when(inserted.isNotNull(), gap("I", right, inserted)).when(deleted.isNotNull(), gap("D", left, deleted))))


def read_gaps(placed: DataFrame, contigs: DataFrame, least_reads: int = 3, most: int = 30, flank: int = 15) -> DataFrame:
    """(contig_id, pos, kind, size, bases, n_reads): gaps of reads against their contig that enough distinct reads show."""
    rows = placed.join(contigs.select("contig_id", F.col("seq").alias("contig")).hint("merge"), "contig_id")
    # no gap looks further than its size and flank past the read
    rows = rows.withColumn("body", F.expr(f"substring(contig, start + 1, length(seq) + {most + flank})")).drop("contig")
    # the first difference is a column of its own, and gaps come out of a generator, so that neither is computed again in a filter
    off = rows.filter("left(body, length(seq)) <> seq").withColumn("at", S.common_prefix(F.col("body"), F.col("seq")))
    off = off.select("read_id", "contig_id", "start", F.inline(extract_gap(F.col("body"), F.col("seq"), F.col("at"), most, flank)))
    events = off.groupBy("contig_id", (F.col("start") + F.col("at")).cast("long").alias("pos"), "kind", F.col("size").cast("long").alias("size"), "bases").agg(F.count_distinct("read_id").alias("n_reads"))
    return events.filter(F.col("n_reads") >= least_reads)


def linked_gaps(placed: DataFrame, contigs: DataFrame, least_reads: int = 3, most: int = 30, least_left: int = 12, tail: int = 20, differences: int = 1) -> DataFrame:
    """(contig_id, pos, kind, size, bases, n_reads): gaps at which reads, left where the assembly placed them, leave their contig.

    placed: read_id, contig_id, start, seq as on the contig, inside it.  A read needs ``least_left``
    equal bases before its first difference; the smallest gap after which ``tail`` bases have at
    most ``differences`` differences is taken, a deletion before an insertion of its size.
    """
    rows = placed.join(contigs.select("contig_id", F.col("seq").alias("contig")).hint("merge"), "contig_id").filter("start >= 0 and start + length(seq) <= length(contig)")
    rows = rows.withColumn("body", F.expr(f"substring(contig, cast(start as int) + 1, length(seq) + {most + tail})")).drop("contig").filter("left(body, length(seq)) <> seq")
    off = rows.withColumn("at", S.common_prefix(F.col("body"), F.col("seq"))).filter(f"at >= {least_left} and length(seq) - at >= {tail + 2}")
    fits = lambda a, x, b, y: (F.length(F.substring(a, x + 1, F.lit(tail))) == tail) & (F.length(F.substring(b, y + 1, F.lit(tail))) == tail) & (S.hamming(F.substring(a, x + 1, F.lit(tail)), F.substring(b, y + 1, F.lit(tail))) <= differences)
    at = F.col("at")
    tried = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.struct(n.alias("size"), F.when(fits("body", at + n, "seq", at), "D").when(fits("body", at, "seq", at + n), "I").alias("kind")))
    hits = off.select("read_id", "contig_id", "start", "at", "body", "seq", F.inline(F.slice(F.filter(tried, lambda x: x["kind"].isNotNull()), 1, 1)))
    bases = F.when(F.col("kind") == "D", F.substring("body", at + 1, F.col("size"))).otherwise(F.substring("seq", at + 1, F.col("size")))
    events = hits.groupBy("contig_id", (F.col("start") + at).cast("long").alias("pos"), "kind", F.col("size").cast("long").alias("size"), bases.alias("bases")).agg(F.count_distinct("read_id").alias("n_reads"))
    return events.filter(F.col("n_reads") >= least_reads)


def anchored_groups(groups: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """(contig_id, pos, ref, alts, n_alleles, support): groups of alleles whose flank a contig holds once, on either strand, put on that contig.

    groups: as from ``graph.variant_groups``.  The allele that the contig itself has from there on is
    ref; pos (from 0) is where the alleles, without the bases that all begin and then end with,
    start.  Groups of whose alleles the contig has none, or whose flank is held more than once, have no place.
    """
    turned = F.transform("alleles", lambda a: F.struct(S.reverse_complement(a["seq"]).alias("seq"), a["support"].alias("support")))
    both = groups.select("flank", "alleles").union(groups.select(S.reverse_complement(F.col("closes")), turned))
    held = contigs.select("contig_id", F.inline(S.kmers(F.col("seq"), k))).join(both.select(F.col("flank").alias("kmer")).distinct().hint("merge"), "kmer", "left_semi")
    once = held.groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.struct("contig_id", "pos")).alias("x")).filter("n = 1").select(F.col("kmer").alias("flank"), "x.contig_id", "x.pos")
    rows = both.join(once.hint("merge"), "flank").join(contigs.select("contig_id", F.col("seq").alias("contig")).hint("merge"), "contig_id")
    own = F.filter("alleles", lambda a: F.expr("substring(contig, cast(pos as int) + 1)").startswith(a["seq"]))
    # of alleles of which one begins with another, the contig has the longest
    rows = rows.select("contig_id", "pos", "alleles", F.array_max(F.transform(own, lambda a: a["seq"])).alias("own")).filter("own is not null")
    others = F.filter("alleles", lambda a: a["seq"] != F.col("own"))
    lead = lambda of: F.array_min(F.transform(others, lambda a: of(F.col("own"), a["seq"])))
    rows = rows.select("contig_id", "pos", "own", others.alias("others"), F.array_min(F.transform("alleles", lambda a: a["support"])).alias("support"), F.array_min(F.transform("alleles", lambda a: F.length(a["seq"]))).alias("least"), lead(S.common_prefix).alias("front"), lead(lambda x, y: S.common_prefix(F.reverse(x), F.reverse(y))).alias("back"))
    # each allele keeps a base, and indels go as far left as they can
    rows = rows.withColumn("back", F.least("back", F.col("least") - 1)).withColumn("front", F.least("front", F.col("least") - F.col("back") - 1))
    cut = lambda c: F.substring(c, F.col("front") + 1, F.length(c) - F.col("front") - F.col("back"))
    alts = F.array_join(F.sort_array(F.transform("others", lambda a: cut(a["seq"]))), ",")
    return rows.select("contig_id", (F.col("pos") + F.col("front")).cast("long").alias("pos"), cut(F.col("own")).alias("ref"), alts.alias("alts"), (F.size("others") + 1).cast("long").alias("n_alleles"), "support").distinct()


def coherent_reads(reads: DataFrame, fragments: DataFrame, k: int = 31) -> DataFrame:
    """(fragment_id, n_reads): distinct reads that hold the whole fragment, on either strand."""
    from readloom.operators.search import both_strands

    asked = both_strands(fragments.select(F.col("fragment_id").alias("probe_id"), F.col("seq").alias("probe"))).withColumn("kmer", F.left("probe", F.lit(k)))
    rows = held_windows(reads, asked, k, "read_id").filter(F.contains("seq", F.col("probe")))
    return rows.groupBy(F.col("probe_id").alias("fragment_id")).agg(F.count_distinct("read_id").alias("n_reads"))


def gap_events(a: str, b: str, flank: int = 15, most: int = 30, least_match: int = 12, events: int = 12) -> Iterator[tuple[int, str, int, str]]:
    """(at, kind, size, bases) of the gaps along two sequences from their starts.

    An event needs ``least_match`` equal bases before it and a tail of ``flank`` bases with at most
    one difference after it; deletions are tried before insertions at each size.  Differences
    without an event are stepped over.
    """
    i, j, run = 0, 0, 0
    while i < len(a) and j < len(b) and events:
        if a[i] == b[j]:
            i, j, run = i + 1, j + 1, run + 1
            continue
        sizes = ((n, kind) for n in range(1, most + 1) for kind in "DI") if run >= least_match else ()
        run = 0
        for n, kind in sizes:
            x, y = (i + n, j) if kind == "D" else (i, j + n)
            ta, tb = a[x : x + flank], b[y : y + flank]
            if len(ta) == len(tb) == flank and sum(p != q for p, q in zip(ta, tb, strict=True)) <= 1:
                yield i, kind, n, a[i:x] if kind == "D" else b[j:y]
                i, j, events = x, y, events - 1
                break
        else:
            i, j = i + 1, j + 1


def scan_pairs(pairs: DataFrame, flank: int = 15, most: int = 30, least_match: int = 12, events: int = 12) -> DataFrame:
    """(pair_id, at, kind, size, bases): ``gap_events`` of each pair.  The walk is sequential in a pair, so pairs run in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from event_batches(batch, flank, most, least_match, events)

    return pairs.select("pair_id", "left", "right").mapInArrow(run, EVENTS)


def event_batches(batch: pa.RecordBatch, *limits: int) -> Iterator[pa.RecordBatch]:
    """``gap_events`` of the rows (pair_id, left, right) of a batch; a null side has none."""
    ids, found = [], []
    for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        for event in gap_events(a or "", b or "", *limits):
            ids.append(i)
            found.append(event)
    at, kind, size, bases = zip(*found, strict=True) if found else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())).cast(pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.string()), pa.array(size, pa.int64()), pa.array(bases, pa.string())], ["pair_id", "at", "kind", "size", "bases"])
