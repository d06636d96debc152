"""Intervals on positions: depth, runs, range and as-of joins.  All intervals are half-open.

A region can hold most of the data, so windows never run over a whole region: they run over chunks
of it, and what a chunk has to know of earlier ones (a running sum, the last span) comes from a
second window over one summary row a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 256
CHUNK = 1 << 16


def expand_duplicates(placements: DataFrame, read_map: DataFrame) -> DataFrame:
    """One row an original read: placements are of unique reads."""
    return read_map.join(placements.hint("merge"), "uid")


def depth_changes(spans: DataFrame) -> DataFrame:
    """(region, pos, delta), summed before the shuffle; spans: region, start, end."""
    both = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("delta"))))
    return spans.filter("start < end").select("region", both.alias("e")).groupBy("region", "e.pos").agg(F.sum("e.delta").alias("delta"))


def _chunk(width: int):
    return F.floor(F.col("pos") / width).alias("chunk")


def coverage_runs(spans: DataFrame, extents: DataFrame, width: int = CHUNK) -> DataFrame:
    """(region, start, end, depth): maximal runs of equal depth over each extent, zero depth included.

    extents: region, start, end, one a region.  A run ends where the summed changes of a position
    aren't zero, or the extent ends.
    """
    ends = extents.select("region", F.explode(F.array("start", "end")).alias("pos"), F.lit(0).cast("long").alias("delta"), F.lit(True).alias("edge"))
    moved = depth_changes(spans).withColumn("edge", F.lit(False)).unionByName(ends)
    changes = moved.groupBy("region", "pos").agg(F.sum("delta").alias("delta"), F.max("edge").alias("edge")).filter("edge or delta <> 0").select("region", "pos", "delta", _chunk(width))
    along = Window.partitionBy("region").orderBy("chunk")
    chunks = changes.groupBy("region", "chunk").agg(F.sum("delta").alias("total"), F.min("pos").alias("first"))
    chunks = chunks.select("region", "chunk", F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(along).alias("next"))
    by = Window.partitionBy("region", "chunk").orderBy("pos")
    rows = changes.join(chunks.hint("merge"), ["region", "chunk"])
    end, depth = F.coalesce(F.lead("pos").over(by), F.col("next")), F.col("before") + F.sum("delta").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("region", F.col("pos").alias("start"), end.alias("end"), depth.alias("depth")).filter(F.col("end").isNotNull())


def per_base_depth(runs: DataFrame) -> DataFrame:
    return runs.select("region", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), "depth")


def window_mean(depth: DataFrame, reach: int = 15, width: int = CHUNK) -> DataFrame:
    """Floor of the mean depth within ``reach`` positions; rows near a chunk's ends also go to its neighbour."""
    at = lambda n: F.floor((F.col("pos") + n) / width)
    spread = depth.withColumn("chunk", F.explode(F.array_distinct(F.array(at(-reach), at(0), at(reach)))))
    by = Window.partitionBy("region", "chunk").orderBy("pos").rangeBetween(-reach, reach)
    return spread.withColumn("mean_depth", F.floor(F.avg("depth").over(by))).filter(F.col("chunk") == at(0)).drop("chunk")


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of a left (region, start, end, ...) and a right (region, q_start, q_end, ...) row that overlap.

    Both sides go to the bins that they touch, and a pair is kept in the later of the first bins
    only, so it comes once; the join is an equi-join at any size.
    """
    pairs = _binned(left, "start", "end", width).join(_binned(right, "q_start", "q_end", width).hint("merge"), ["region", "_bin"])
    once = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("q_start") / width))
    return pairs.filter(once & (F.col("end") > F.col("q_start")) & (F.col("start") < F.col("q_end"))).drop("_bin")


def as_of_span(points: DataFrame, spans: DataFrame, width: int = CHUNK) -> DataFrame:
    """points (point_id, region, pos) with the span (contig_id) that holds pos, or null in a gap; spans don't overlap."""
    marks = spans.select("region", F.col("start").alias("pos"), F.struct("start", "contig_id", "end").alias("span"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point_id"))
    asked = points.select("region", "pos", F.lit(None).cast(marks.schema["span"].dataType).alias("span"), F.lit(1).alias("kind"), "point_id")
    rows = marks.unionByName(asked).withColumn("chunk", F.floor(F.col("pos") / width))
    chunks = rows.groupBy("region", "chunk").agg(F.max("span").alias("last"))
    along = Window.partitionBy("region").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("region", "chunk", F.last("last", ignorenulls=True).over(along).alias("carried"))
    by = Window.partitionBy("region", "chunk").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.join(chunks.hint("merge"), ["region", "chunk"]).withColumn("span", F.coalesce(F.last("span", ignorenulls=True).over(by), "carried")).filter("kind = 1")
    return held.select("point_id", "region", "pos", F.when(F.col("pos") < F.col("span.end"), F.col("span.contig_id")).alias("contig_id"))


def union_of_spans(spans: DataFrame, width: int = CHUNK) -> DataFrame:
    """(region, start, end): merged spans; touching ones become one.

    Equal spans count once: two windows may order them unlike each other, and only the first begins a run.
    """
    rows = spans.select("region", "start", "end").distinct().withColumn("chunk", F.floor(F.col("start") / width))
    along = Window.partitionBy("region").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    reaches = rows.groupBy("region", "chunk").agg(F.max("end").alias("reach")).select("region", "chunk", F.max("reach").over(along).alias("carried"))
    by = Window.partitionBy("region", "chunk").orderBy("start", "end")
    before = F.greatest(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    heads = rows.join(reaches.hint("merge"), ["region", "chunk"]).withColumn("head", F.when(F.col("start") <= before, 0).otherwise(1))
    counts = heads.groupBy("region", "chunk").agg(F.sum("head").alias("n")).select("region", "chunk", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("earlier"))
    runs = heads.join(counts.hint("merge"), ["region", "chunk"]).withColumn("run", F.col("earlier") + F.sum("head").over(by))
    return runs.groupBy("region", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def label_regions(df: DataFrame, main_end: int) -> DataFrame:
    return df.withColumn("region", F.when(F.col("start") < main_end, "pg_main").otherwise("pg_second"))
