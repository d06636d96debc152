"""Column functions on nucleotide strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """N and anything else but A, C, G, T keep their letter."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def codes(seq: Column) -> Column:
    """A, C, G, T as the digits 0 to 3."""
    return F.translate(seq, "ACGT", "0123")


def packed(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a number of two bits a base."""
    return F.conv(codes(kmer), 4, 10).cast("long")


def unpacked(code: Column, k: int) -> Column:
    """The k-mer of a number of two bits a base."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int) -> Column:
    """(pos from 0, kmer) of each k-mer as an array; empty for a sequence shorter than k."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))


def hamming(a: Column, b: Column) -> Column:
    """Places where two equally long strings differ."""
    # a complemented mask has no built-in: compare letter by letter in one pass of higher-order functions
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def n_offsets(seq: Column) -> Column:
    """Places of N, from 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0))), lambda i: F.substring(seq, i + 1, F.lit(1)) == "N")


def with_letters(seq: Column, offsets: Column, letters: Column) -> Column:
    """The sequence with letters put in at the offsets (from 0)."""
    pairs = F.arrays_zip(offsets.alias("o"), letters.alias("l"))
    return F.aggregate(pairs, seq, lambda s, p: F.overlay(s, p["l"], p["o"] + 1, F.lit(1)))


def phred(qual: Column) -> Column:
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def header_tokens(name: Column) -> Column:
    """Runs of letters, runs of zeros, numbers, and all other characters one by one."""
    return F.regexp_extract_all(name, F.lit(r"([A-Za-z]+|0+|[1-9][0-9]*|[^A-Za-z0-9])"), F.lit(1))


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of at most ``width`` characters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(False))), True)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def upper_median(values: Column) -> Column:
    """Of an array: the element at n div 2 of its sorted order, from 0."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
