"""Mixing sources to target weights by fitting document counts of each exact length to the words that a source is to give.

A source's target is 0 to 2 times its size. Whole rounds take every document; what then remains of the budget is fitted
on the source's length histogram: an equal share of each length, from the longest down, of all but RESERVE words, what
one length can't hit going on to the next; then bounded-knapsack dynamic programming over the words that remain, fewer
than RESERVE and the longest document together, which as a rule hits the target exactly. A budget below RESERVE is the
program's alone and fitted as well as any choice can. Within a length, the documents that come first in a seeded order
are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import WORD, materialize, ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words that the shares leave to the dynamic programming.
RESERVE = 20_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Sources by code point, null last, share `share` of all words by weight, each at most `most` times its size; the excess is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), list(order)
    while free:
        per = left / sum(weight[s] for s in free)
        above = [s for s in free if per * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: per * weight[s] for s in free}
        for s in above:
            out[s] = float(most * sizes[s])
        free = [s for s in free if s not in above]
        left = share * sum(sizes.values()) - sum(out[s] for s in order if s not in free)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below `budget` as they can."""
    take = np.zeros(len(lengths), np.int64)
    words = int((lengths * counts).sum())
    if budget <= 0 or words == 0:
        return take
    if budget >= words:
        return np.where(lengths > 0, counts, 0)
    order, spare = np.argsort(-lengths, kind="stable"), counts.copy()
    share, before, taken = max(0, budget - RESERVE), 0, 0
    for i in order:  # Python's integers: counts times budget may pass 64 bits
        length, count = int(lengths[i]), int(counts[i])
        before += length * count
        if length:
            take[i] = min(count, (before * share // words - taken) // length)
            taken += int(take[i]) * length
    spare -= take
    left = budget - taken
    # reached[w]: w words can be had; by[w]: the last item of a set that has them. Items double up, so a count of c needs log c.
    reached, by, items = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64), []
    reached[0] = True
    for i in order:
        length, c, k = int(lengths[i]), int(spare[i]), 1
        while length and c and not reached[left]:
            k = min(k, c)
            if (w := k * length) > left:
                break
            new = reached[:-w] & ~reached[w:]
            by[w:][new] = len(items)
            reached[w:] |= new
            items.append((i, k))
            c, k = c - k, 2 * k
    w = int(np.flatnonzero(reached)[-1])
    while w:
        i, k = items[by[w]]
        take[i] += k
        w -= k * int(lengths[i])
    return take


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_plan(sized: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, rounds, extra) of each source and length: every one of n documents `rounds` times, `extra` of them once more."""
    spark = sized.sparkSession
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "length-histogram")
    whole = {r["source"]: r["words"] for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}  # a row for each source
    goal = targets(whole)
    shared = spark.sparkContext.broadcast((whole, goal))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        whole, goal = shared.value
        source = part["source"].iloc[0]
        source = None if pd.isna(source) else source
        words, target = int(whole[source]), goal[source]
        rounds = int(target // words) if words else 0
        part = part.sort_values("size")
        extra = fit(part["size"].to_numpy(), part["n"].to_numpy(), round(target) - rounds * words)
        return part[["source", "size", "n"]].assign(source_size=words, target=target, rounds=rounds, extra=extra)

    # A group has a row for each length that occurs in a source.
    return histogram.groupBy("source").applyInPandas(one, "source string, size long, n long, source_size long, target double, rounds long, extra long")


def mix(sized: DataFrame, seed: int = 1) -> DataFrame:
    """sized (doc_id, source, size and others but the names here; best a written table) with source_size, target and copies.

    Null sources form a source of their own; empty texts have size 0 and are never taken. Equal rows are interchangeable.
    """
    by_seed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    p = materialize(mix_plan(sized), "mix-plan")
    most = p.agg(F.max("n")).first()[0] or 0
    dealt = ranked(sized, ["source", "size"], [by_seed, F.col("doc_id")], F.xxhash64(by_seed), most)
    p = p.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "rounds", "extra")
    return (
        dealt.join(p, dealt["source"].eqNullSafe(p["_source"]) & (dealt["size"] == p["_size"]))
        .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("rounds") + (F.col("rank") < F.col("extra")).cast("long")))
        .drop("_source", "_size", "rounds", "extra", "rank")
    )


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs, a written table, each row as often as the mix takes it. Columns of any name pass through, held in one struct meanwhile."""
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    taken = mix(sized, seed).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("again"))
    return taken.select("row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
