"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted to a bounded sample; every vector is then put in a leaf.  A query walks the
tree through a priority queue of nodes by the inner product with their centres, raised by a share of
their spread (an inner node's whole spread, so that it is opened before its leaves are passed over),
and visits leaves until it has seen the calibrated number of them: the number at which a bounded sample of queries,
compared with a search of all vectors, reached the recall asked for.  Queries meet the vectors of
their leaves in a shuffle by leaf, where large leaves are dealt into chunks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm import common

FIT_ROWS = 20_000
CALIBRATION_QUERIES = 200
BRANCHES, LEAF = 8, 64
RECALL = 0.93  # of the calibration; 0.9 is asked for
SPREAD = 0.25  # share of a leaf's mean distance from its centre that counts for it
CHUNK = 4096
ROUNDS = 8


@dataclass
class Tree:
    centre: np.ndarray  # of each node; 0 is the root
    children: list[np.ndarray]
    leaf: np.ndarray  # leaf number of a node, or -1
    spread: np.ndarray  # mean distance of a node's vectors from its centre, of a leaf's the share that counts

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=-1)) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row."""
    centre = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        label = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for j in range(k):
            if (mine := label == j).any():
                centre[j] = x[mine].mean(0)
    return label


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    away = lambda rows: float(np.sqrt(((rows - rows.mean(0)) ** 2).sum(1)).mean())
    centre, children, number, spread = [sample.mean(0)], [np.zeros(0, np.int64)], [-1], [away(sample)]
    todo, leaves = [(0, sample)], 0
    while todo:
        node, rows = todo.pop()
        label = _kmeans(rows, branches, rng) if len(rows) > max(leaf, branches) else np.zeros(len(rows), np.int64)
        groups = [rows[label == j] for j in np.unique(label)]
        if len(groups) < 2:
            number[node], leaves = leaves, leaves + 1
            continue
        first = len(centre)
        children[node] = np.arange(first, first + len(groups))
        for k, group in enumerate(groups):
            centre.append(group.mean(0))
            spread.append(away(group))
            children.append(np.zeros(0, np.int64))
            number.append(-1)
            todo.append((first + k, group))
    number = np.array(number)
    return Tree(np.array(centre), children, number, np.array(spread) * np.where(number >= 0, SPREAD, 1))


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row, down the nearest centres."""
    node = np.zeros(len(x), np.int64)
    while True:
        open_ = np.unique(node[tree.leaf[node] < 0])
        if not len(open_):
            return tree.leaf[node]
        for n in open_:
            rows, kids = np.flatnonzero(node == n), tree.children[n]
            c = tree.centre[kids]
            node[rows] = kids[((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)]


def visits(tree: Tree, q: np.ndarray, most: int, sizes: np.ndarray, least_rows: int) -> list[np.ndarray]:
    """Leaves of each query in best-bin-first order: ``most`` of them, and more until they hold ``least_rows`` vectors."""
    out = []
    for row in q:
        near = tree.centre @ row + np.sqrt(row @ row) * tree.spread
        heap, found, rows = [(-near[0], 0)], [], 0
        while heap and (len(found) < most or rows < least_rows):
            _, node = heapq.heappop(heap)
            if tree.leaf[node] >= 0:
                found.append(tree.leaf[node])
                rows += sizes[tree.leaf[node]]
            for kid in tree.children[node]:
                heapq.heappush(heap, (-near[kid], kid))
        out.append(np.array(found, np.int64))
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components whatever the shapes."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j : j + 1] * x[:, j]
    return out


def nearest(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k nearest of each query, but for its own id; ties to smaller ids."""
    order = np.argsort(vec_id, kind="stable")
    rows, cols, scores = [], [], []
    for lo in range(0, len(q), 256):
        score = products(q[lo : lo + 256], x[order])
        score[query_id[lo : lo + 256, None] == vec_id[order]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, best, 1)
        row, col = np.nonzero(value > -np.inf)
        rows.append(row + lo)
        cols.append(order[best[row, col]])
        scores.append(value[row, col])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _matrix(column) -> np.ndarray:
    """A column of equally long lists, from Arrow or pandas."""
    if not len(column):
        return np.zeros((0, 1))
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _table_scan(vectors: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch, _matrix(batch.column(batch.schema.get_field_index("v"))))

    return vectors.mapInArrow(run, schema)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, once each."""
    v = F.col(vector).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).alias("id"), v.alias("v")).filter(fine & F.col("id").isNotNull()).distinct()
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    return rows.filter(F.size("v") == (size.n if size else 0))


def search(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``every`` divides, against all other rows.

    Score is the inner product in double precision; equal scores rank by smaller id.  Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
    an id or with a number of components other than the most common one; rows that repeat count
    once.  A table of fewer than k other vectors gives all of them; an empty one gives no rows.
    """
    spark = df.sparkSession
    rows = common.cut(usable(df, vec_id, vector))
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()["v"].combine_chunks())
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = spark.sparkContext.broadcast(fit(sample))  # the size of the sample at most
    # of equal vectors the k + 1 smallest ids are all that can be among the nearest
    same = Window.partitionBy("v").orderBy("id")
    held = rows.withColumn("same", F.row_number().over(same)).filter(F.col("same") <= k + 1)
    index = common.cut(_table_scan(held.select("id", "v"), lambda b, x: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(assign(tree.value, x))], ["id", "v", "leaf"]), "id long, v array<double>, leaf long"))
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r["leaf"]] = r["count"]
    queries = rows.filter(F.col("id") % every == 0)
    most = _calibrated(queries, index, tree.value, sizes, k, recall)
    return _found(spark, queries, index, tree, sizes, most, k)


def _calibrated(queries: DataFrame, index: DataFrame, tree: Tree, sizes: np.ndarray, k: int, recall: float) -> int:
    """Leaf visits at which a sample of queries finds that share of its true neighbours."""
    few = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_QUERIES).toArrow()
    if not few.num_rows:
        return 1
    ids, q = few["id"].to_numpy(), _matrix(few["v"].combine_chunks())

    def best(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        row, col, score = nearest(ids, q, batch.column(0).to_numpy(), x, k)
        return pa.RecordBatch.from_arrays([pa.array(row), batch.column(0).take(pa.array(col)), batch.column(2).take(pa.array(col)), pa.array(score)], ["q", "id", "leaf", "score"])

    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = _table_scan(index, best, "q long, id long, leaf long, score double").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    true = true.select("q", "leaf").toArrow()  # k rows a sampled query
    order = visits(tree, q, tree.leaves, sizes, 0)
    place = np.array([np.empty(tree.leaves, np.int64) for _ in order])
    for row, leaves in zip(place, order, strict=True):
        row[leaves] = np.arange(1, len(leaves) + 1)
    need = np.sort(place[true["q"].to_numpy(), true["leaf"].to_numpy()])
    return int(need[int(np.ceil(recall * len(need))) - 1]) if len(need) else 1


def _found(spark: SparkSession, queries: DataFrame, index: DataFrame, tree, sizes: np.ndarray, most: int, k: int) -> DataFrame:
    def walk(batch: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        leaves = visits(tree.value, q, most, sizes, k + 1)
        at = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(leaves))], ["id", "v", "leaf"])

    walked = common.cut(_table_scan(queries.select("id", "v"), walk, "id long, v array<double>, leaf long"))
    asked = {r["leaf"]: r["count"] for r in walked.groupBy("leaf").count().collect()}
    plan = [(n, int(-(-int(sizes[n]) // CHUNK)) or 1, -(-asked.get(n, 0) // CHUNK) or 1) for n in range(tree.value.leaves)]
    chunks = F.broadcast(spark.createDataFrame(plan, "leaf long, parts int, groups int"))  # a row for each leaf

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own[:-1])
        return df.join(chunks, "leaf").select("id", "v", "leaf", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]))

    keys = ["leaf", "part", "group"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        row, col, score = nearest(ids, _matrix(left["v"]), others, _matrix(right["v"]), k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": others[col], "score": score})

    pairs = dealt(walked, "groups", "parts").groupBy(*keys).cogroup(dealt(index, "parts", "groups").groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
