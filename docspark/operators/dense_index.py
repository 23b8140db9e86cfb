"""Exact nearest chunks by cosine for many queries: blocks of queries meet blocks of chunks, but for those that clusters rule out.

Chunks in use are dealt to the nearest of CLUSTERS centroids, which are the unit vectors of as many chunks picked by hash
of their id: that sample is bounded, and only how much is skipped depends on it. For each vault and cluster the largest
angle between its chunks and the centroid is kept. Angles obey the triangle inequality, so no chunk of a cluster is nearer
to a query than the angle to the centroid less that radius: a cluster whose bound lies below the k-th best score of the
clusters read first is skipped, and no result is lost.

The chunks of a vault stand on shelves of about SHELF, cluster by cluster, large clusters in blocks of BLOCK; its queries
in blocks of TOGETHER that are nearest to one centroid, and SHELF of them go together. A shelf is sent once to each such
lot of queries, and a block of queries, with the clusters that each of them may meet, once to each shelf that has one: a
vector travels as often as its vault has lots or shelves, not as it has clusters. So a vault or a cluster that holds most
chunks is spread over many tasks. A query has its k best of a shelf alone sent on, and once it has k from the clusters
read first, none below these. What is sent to all tasks is the centroids.

A vector of zeros has a cosine of 0 with everything; such chunks are a cluster of their own that no bound rules out, and
such queries skip nothing. Chunks without a vector and queries without one have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.keyword_index import in_use
from docspark.sources.shared import written

CLUSTERS, BLOCK, TOGETHER, SHELF = 64, 2048, 512, 8192
#: Angles and scores are rounded; bounds are wider by this.
SLACK = 1e-7


@dataclass
class DenseIndex:
    """shelves (vault_id, shelf, clusters, ids, vectors), places (vault_id, cluster, shelf), clusters (vault_id, cluster, n, n_blocks, radius) and centroids. Cluster CLUSTERS has the zero vectors."""

    shelves: DataFrame
    places: DataFrame
    clusters: DataFrame
    centroids: np.ndarray


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them are zero."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.maximum(norms, 1e-300), norms[:, 0] == 0


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def build(chunks: DataFrame) -> DenseIndex:
    """An index of chunks (chunk_id, vault_id, embedding, is_deleted, status), in the application's folder."""
    spark = chunks.sparkSession
    scope = chunks.where(in_use() & F.col("embedding").isNotNull()).select("chunk_id", "vault_id", "embedding")
    sample = scope.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(CLUSTERS).select("embedding").collect()
    centroids, zero = _units(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64()))) if sample else (np.zeros((0, 1)), np.zeros(0, bool))
    centroids = centroids[~zero]
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, zero = _units(batch.column(2))
            near = rows @ sent.value.T if len(sent.value) else np.ones((len(rows), 1))
            cluster = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), cluster], -1, 1))
            cluster[zero], angle[zero] = CLUSTERS, np.pi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(angle), _lists(rows)], names=["chunk_id", "vault_id", "cluster", "angle", "vector"])

    rows = written(scope.mapInArrow(assign, "chunk_id long, vault_id long, cluster int, angle double, vector array<double>"), "dense-rows")
    clusters = rows.groupBy("vault_id", "cluster").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"), (F.max("angle") + SLACK).alias("radius"))
    clusters = written(clusters, "dense-clusters")
    block = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
    before = Window.partitionBy("vault_id").orderBy("cluster", "block").rowsBetween(Window.unboundedPreceding, -1)
    units = clusters.select("vault_id", "cluster", "n_blocks", (F.col("n") / F.col("n_blocks")).alias("n"), block)
    units = written(units.withColumn("shelf", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / SHELF).cast("int")).drop("n"), "dense-units")
    dealt = rows.join(clusters.select("vault_id", "cluster", "n_blocks"), ["vault_id", "cluster"]).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("n_blocks")).cast("int"))
    dealt = dealt.join(units.drop("n_blocks"), ["vault_id", "cluster", "block"])
    shelves = dealt.groupBy("vault_id", "shelf").agg(F.sort_array(F.collect_list(F.struct("cluster", "chunk_id", "vector"))).alias("rows"))
    shelves = shelves.select("vault_id", "shelf", F.col("rows.cluster").alias("clusters"), F.col("rows.chunk_id").alias("ids"), F.col("rows.vector").alias("vectors"))
    return DenseIndex(written(shelves, "dense-shelves"), written(units.select("vault_id", "cluster", "shelf").distinct(), "dense-places"), clusters, centroids)


def _asked(queries: DataFrame, index: DenseIndex) -> DataFrame:
    """(query_id, vault_id, vector, angles): to each centroid; 0 to the cluster of zero vectors, and to all for a query of zeros."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, zero = _units(batch.column(2))
            angles = np.zeros((len(rows), CLUSTERS + 1))
            angles[:, : len(sent.value)] = np.arccos(np.clip(rows @ sent.value.T, -1, 1)) if len(sent.value) else 0
            angles[zero] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(rows), _lists(angles)], names=["query_id", "vault_id", "vector", "angles"])

    picked = queries.where("query_vec is not null").select("query_id", "vault_id", "query_vec")
    return picked.mapInArrow(run, "query_id long, vault_id long, vector array<double>, angles array<double>")


def _together(asked: DataFrame) -> DataFrame:
    """Blocks of queries that are nearest to one centroid: (vault_id, home, group, lot, queries, vectors, angles)."""
    homed = asked.withColumn("home", (F.array_position("angles", F.array_min("angles")) - 1).cast("int"))
    groups = homed.groupBy("vault_id", "home").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("n_groups"))
    groups = written(groups.withColumn("n_lots", F.ceil(F.sum("n_groups").over(Window.partitionBy("vault_id")) * TOGETHER / SHELF).cast("int")), "dense-groups")
    homed = homed.join(groups, ["vault_id", "home"]).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("n_groups")).cast("int"))
    lot = F.pmod(F.xxhash64("home", "group"), F.first("n_lots")).cast("int").alias("lot")
    rows = homed.groupBy("vault_id", "home", "group").agg(lot, F.sort_array(F.collect_list(F.struct("query_id", "vector", "angles"))).alias("rows"))
    return rows.select("vault_id", "home", "group", "lot", F.col("rows.query_id").alias("queries"), F.col("rows.vector").alias("vectors"), F.col("rows.angles").alias("angles"))


def _scores(blocks: DataFrame, pairs: DataFrame, index: DenseIndex, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each query on each shelf, of the clusters that pairs (vault_id, home, group, place, cluster, least) names, none below `least`."""
    own = ["vault_id", "home", "group"]
    wants = pairs.join(index.places, ["vault_id", "cluster"]).groupBy(*own, "shelf").agg(F.collect_list(F.struct("cluster", "place", "least")).alias("w"))
    asked = wants.join(blocks.select(*own, "lot", "queries", F.col("vectors").alias("asked")), own)
    lots = written(asked.select("vault_id", "shelf", "lot", "queries", "asked", F.col("w.cluster").alias("of"), F.col("w.place").alias("place"), F.col("w.least").alias("least")), "dense-lots")
    # Shelves are sent to the lots that ask for them.
    sent = lots.select("vault_id", "shelf", "lot").distinct().join(index.shelves, ["vault_id", "shelf"])
    met = lots.join(sent, ["vault_id", "shelf", "lot"]).select("queries", "asked", "of", "place", "least", "clusters", "ids", "vectors")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries, of, place, least, clusters, ids = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4, 5, 6))
                asked, vectors = (batch.column(c)[row].values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in ((1, len(queries)), (7, len(ids))))
                order = np.argsort(of, kind="stable")
                of, place, least = of[order], place[order], least[order]
                found = []
                for cluster in np.unique(of):
                    i, j = np.searchsorted(of, [cluster, cluster + 1])
                    a, b = np.searchsorted(clusters, [cluster, cluster + 1])
                    if a == b:
                        continue
                    scores = asked[place[i:j]] @ vectors[a:b].T
                    rounded = np.round(scores, 9)
                    low = least[i:j] - SLACK
                    if b - a > k:
                        low = np.maximum(low, np.partition(rounded, b - a - k, axis=1)[:, b - a - k])
                    at, chunk = np.nonzero(rounded >= low[:, None])
                    found.append((place[i:j][at], rounded[at, chunk], ids[a:b][chunk], scores[at, chunk]))
                if not found:
                    continue
                place, rounded, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids, -rounded, place))
                begin = np.searchsorted(place[order], place[order])
                order = order[np.arange(len(order)) - begin < k]
                yield pa.RecordBatch.from_arrays([pa.array(queries[place[order]]), pa.array(ids[order]), pa.array(scores[order])], names=["query_id", "chunk_id", "score"])

    return met.mapInArrow(multiply, "query_id long, chunk_id long, score double")


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _plan(queries: DataFrame, index: DenseIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of queries, the queries' clusters with bounds and whether they come first, and the best of those that do."""
    blocks = written(_together(written(_asked(queries, index), "dense-asked")), "dense-blocks")
    each = blocks.select("vault_id", "home", "group", F.posexplode(F.arrays_zip("queries", "angles")).alias("place", "q"))
    each = each.select("vault_id", "home", "group", "place", F.col("q.queries").alias("query_id"), F.posexplode("q.angles").alias("cluster", "angle"))
    pairs = each.join(index.clusters, ["vault_id", "cluster"])
    pairs = pairs.withColumn("bound", F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))) + SLACK)
    order = Window.partitionBy("query_id").orderBy("angle", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)) < k)
    pairs = written(pairs.drop("angle", "radius", "n_blocks"), "dense-pairs")
    first = pairs.where("first").withColumn("least", F.lit(float("-inf")))
    return blocks, pairs, written(_first(_scores(blocks, first, index, k), k).drop("rank"), "dense-first")


def _rest(pairs: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The pairs that may still hold one of the k best, with `least`, the k-th best score so far."""
    least = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("least")).where(F.col("_n") >= k)
    rest = pairs.where("not first").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("_n")
    return rest.withColumn("least", F.coalesce("least", F.lit(float("-inf"))))


def search(queries: DataFrame, index: DenseIndex, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest chunks of each query's vault; ties to the smaller chunk_id."""
    blocks, pairs, best = _plan(queries, index, k)
    return _first(best.unionByName(_scores(blocks, _rest(pairs, best, k), index, k)), k)


def reads(queries: DataFrame, index: DenseIndex, k: int = 20) -> DataFrame:
    """(query_id, chunks, compared): the chunks of the query's vault, and those that it is compared with."""
    _, pairs, best = _plan(queries, index, k)
    read = pairs.where("first").unionByName(_rest(pairs, best, k).drop("least")).groupBy("query_id").agg(F.sum("n").alias("compared"))
    return pairs.groupBy("query_id").agg(F.sum("n").alias("chunks")).join(read, "query_id")
