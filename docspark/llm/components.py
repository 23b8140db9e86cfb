"""Connected components of a graph given as edges, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of each key in edges (a, b): root is the smallest key that it is connected with.

    Each round takes the smallest label among a key and its neighbours, then that label's own label, so distances
    shrink fast; labels are written between rounds, and it ends when a round changes none.
    """
    both = materialize(edges.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("to"))).where(F.col("key") != F.col("to")).distinct(), "edges")
    labels = materialize(both.groupBy("key").agg(F.min("to").alias("low")).select("key", F.least("key", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("to"), "root"), "to").groupBy("key").agg(F.min("root").alias("near"))
        stepped = labels.join(near, "key", "left").select("key", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = labels.select(F.col("key").alias("_key"), F.col("root").alias("up"))
        jumped = stepped.join(up, F.col("root") == F.col("_key"), "left").select("key", "was", F.least("root", F.coalesce("up", "root")).alias("root"))
        step = materialize(jumped, "labels")
        changed = not step.where("was <> root").isEmpty()
        release(labels)
        labels = step.select("key", "root")
        labels._docspark_path = step._docspark_path
        if not changed:
            return labels
