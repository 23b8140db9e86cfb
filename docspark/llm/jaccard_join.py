"""N-gram Jaccard join by prefix trees: which documents are connected by pairs with similar shingle sets.

1. Each document's set of shingle hashes is made in a task and named by a 64-bit key of the whole set: documents with
   equal sets are one from here on. Shingles that a good part of all documents share are found by their tasks' counts,
   summed; their number is bounded by HOT times the mean set size, so they can be sent to every task.
2. All other hashes are cut into ranges and cross in binary blocks. A range learns how many sets hold each hash and
   answers with those that two or more hold. A set whose shingles are too rarely shared to reach the similarity with
   any other goes no further; as a rule that is nearly every document that isn't a copy.
3. The global order is by that number, rarest first, the hot ones last. Sets that share a hash in their prefixes, the
   part that any similar pair must share, form candidate groups: the connected components of that graph.
4. A candidate group goes to a task as a whole, or in pairs of blocks if it is large. There its sets form a trie. A
   query walks down all branches at once; branches that agree share their overlap, and a subtree goes as soon as its
   overlap so far and what remains on either side can't reach the similarity with any length that it holds. Components
   are what is asked for, so sets within the largest component so far need no query of their own: a link between two
   components always has an end outside the largest.

No pair is ever written; edges lead from a set to the smallest key of its component. Null or empty text, and text
without a word, has an empty set and is linked with nothing. Rows of equal text are linked if they have a word; a
component's id is its smallest doc_id that isn't null. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import WORD, free, look_up, materialize, partitions, temporary
from docspark.llm.components import components
from docspark.llm.textbytes import Spans, buffers, lowered, mix, slices, tidy, words

#: A hash in one set of HOT or more is hot, as its tasks count it.
HOT = 128
#: Shingles of a range of hashes, about, which a task holds at once.
RANGE = 4_000_000
#: Shingles of a candidate group that a task takes as one block.
BLOCK = 1_000_000
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within each, where each row's begin, and each row's key."""
    data = lowered(data)
    starts, ends, rows = words(data, offsets)
    hashes = Spans(data).hash(starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    begins = np.r_[0, np.cumsum(counts)]
    padded = np.r_[hashes, np.zeros(size, np.uint64)]
    shingle = np.zeros(len(hashes), np.uint64)
    place = np.arange(len(hashes)) - begins[rows]
    for k in range(size):
        inside = place + k < counts[rows]
        shingle += np.where(inside, mix(padded[k : k + len(hashes)] + np.uint64(_STEP * (k + 1) % 2**64)), np.uint64(0))
    shingle = mix(shingle)
    # A row with fewer words than a shingle has one shingle, of all its words.
    good = place <= np.maximum(counts[rows] - size, 0)
    shingle, rows = shingle[good], rows[good]
    edges = np.searchsorted(rows, np.arange(n + 1))
    sets = [np.unique(shingle[edges[i] : edges[i + 1]]) for i in range(n)]
    sizes = np.array([len(s) for s in sets], np.int64)
    joined, begins = np.concatenate(sets) if sets else shingle, np.r_[0, np.cumsum(sizes)]
    keys, full = np.zeros(n, np.uint64), np.flatnonzero(sizes)
    if len(full):
        spread = mix(joined)
        keys[full] = mix(np.add.reduceat(spread, begins[:-1][full]) + np.bitwise_xor.reduceat(joined, begins[:-1][full]) * np.uint64(_STEP) + sizes[full].astype(np.uint64))
    return joined, begins, keys


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares at least with any set that is similar."""
    return -(-percent * n // 100)


def _heads(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_key, n, key, hot, n_hot): hot hashes with their counts come as rows of their own, in which n is null."""
    picked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        names = ["doc_id", "row_key", "n", "key", "hot", "n_hot"]
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            n, keys, hashes = [], [], []
            for i, j in slices(offsets):
                sets, begins, key = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n.append(np.diff(begins))
                keys.append(key)
                hashes.append(sets)
            rows = batch.num_rows
            none = pa.nulls(rows, pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n)), pa.array(np.concatenate(keys).view(np.int64)), none, none], names=names)
            value, count = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            often = count >= max(16, rows / HOT)
            if often.any():
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(value[often].view(np.int64)), pa.array(count[often])], names=names)

    return picked.mapInArrow(run, "doc_id long, row_key long, n long, key long, hot long, n_hot long")


_BLOCK_SCHEMA = "slice long, part int, owner binary, hash binary, extra binary"
_BLOCK_NAMES = ["slice", "part", "owner", "hash", "extra"]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_BLOCK_NAMES)


def _hash_blocks(docs: DataFrame, size: int, parts: int, hot) -> DataFrame:
    """For each slice of documents a row for each range of hashes (owner: 16-bit numbers of documents in the slice), and one with part -1.

    The latter has the keys as owner, the sizes as extra, and the sets' hot hashes as hash, after a count for each set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        hot_hashes = hot.value
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in ((a, min(a + 60_000, y)) for x, y in slices(offsets) for a in range(x, y, 60_000)):
                sets, begins, keys = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                sizes = np.diff(begins)
                # Copies within the slice and empty sets are left out.
                first = np.zeros(len(keys), bool)
                first[np.unique(keys, return_index=True)[1]] = True
                first &= sizes > 0
                if not first.any():
                    continue
                sets, keys, sizes = sets[np.repeat(first, sizes)], keys[first], sizes[first]
                owner = np.repeat(np.arange(len(keys), dtype=np.uint16), sizes)
                is_hot = np.isin(sets, hot_hashes)
                # Owners are places within the slice, so the name goes by the keys' order too.
                name = int(mix(keys + np.arange(1, len(keys) + 1, dtype=np.uint64) * np.uint64(_STEP)).sum(dtype=np.uint64).astype(np.int64))
                rows = [(name, -1, keys.tobytes(), np.bincount(owner[is_hot], minlength=len(keys)).astype(np.uint64).tobytes() + sets[is_hot].tobytes(), sizes.astype(np.int64).tobytes())]
                sets, owner = sets[~is_hot], owner[~is_hot]
                part = ((sets >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                sets, owner = sets[order], owner[order]
                rows += [(name, p, owner[a:b].tobytes(), sets[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield _blocks(rows)

    return docs.select("text").mapInArrow(run, _BLOCK_SCHEMA)


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal `column`, which stand together, as lists."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != now:
                yield now, held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield now, held


def _shared_hashes(blocks: DataFrame, parts: int) -> DataFrame:
    """Of each block, the hashes that two sets or more hold, with how many as extra; rows with part -1 as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for part, rows in _grouped(batches, "part"):
            if part < 0:
                yield _blocks([tuple(r[c] for c in _BLOCK_NAMES) for r in rows])
                continue
            hashes = [np.frombuffer(r["hash"], np.uint64) for r in rows]
            joined = np.concatenate(hashes)
            ordered = np.sort(joined)
            new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            count = np.diff(np.r_[new, len(ordered)])
            value, count = ordered[new][count > 1], count[count > 1]
            if not len(value):
                continue
            out = []
            for r, own in zip(rows, hashes, strict=True):
                at = np.minimum(np.searchsorted(value, own), len(value) - 1)
                hit = value[at] == own
                if hit.any():
                    out.append((r["slice"], part, np.frombuffer(r["owner"], np.uint16)[hit].tobytes(), own[hit].tobytes(), count[at[hit]].astype(np.uint32).tobytes()))
                if len(out) >= 200:
                    yield _blocks(out)
                    out = []
            if out:
                yield _blocks(out)

    # Rows with part -1 are dealt by their slice: any place will do for them.
    dealt = blocks.withColumn("_to", F.when(F.col("part") < 0, F.col("slice")).otherwise(F.col("part").cast("long")))
    return dealt.repartition(partitions(blocks.sparkSession), "_to").drop("_to").sortWithinPartitions("part").mapInArrow(run, _BLOCK_SCHEMA)


def _survivors(answers: DataFrame, percent: int) -> DataFrame:
    """(key, n, tokens, prefix) of each set that shares enough: tokens are its shared hashes, rarest first, hot ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for _, rows in _grouped(batches, "slice"):
            heads = {r["owner"]: r for r in rows if r["part"] < 0}  # a slice that occurs twice has equal rows
            head = next(iter(heads.values()))
            keys, sizes = np.frombuffer(head["owner"], np.int64), np.frombuffer(head["extra"], np.int64)
            raw = np.frombuffer(head["hash"], np.uint64)
            n_hot, hot = raw[: len(keys)].astype(np.int64), raw[len(keys) :]
            parts = {r["part"]: r for r in rows if r["part"] >= 0}.values()
            owner = np.concatenate([np.repeat(np.arange(len(keys)), n_hot), *(np.frombuffer(r["owner"], np.uint16).astype(np.int64) for r in parts)])
            hashes = np.concatenate([hot, *(np.frombuffer(r["hash"], np.uint64) for r in parts)])
            often = np.concatenate([np.full(len(hot), 2**32 - 1, np.uint32), *(np.frombuffer(r["extra"], np.uint32) for r in parts)])
            shared, least = np.bincount(owner, minlength=len(keys)), least_overlap(sizes, percent)
            good = shared >= least
            if not good.any():
                continue
            keep = good[owner]
            owner, hashes, often = owner[keep], hashes[keep], often[keep]
            order = np.lexsort((hashes, often, owner))
            owner, hashes = owner[order], hashes[order]
            edges = np.searchsorted(owner, np.arange(len(keys) + 1))
            chosen = np.flatnonzero(good)
            tokens = [hashes[edges[i] : edges[i + 1]] for i in chosen]
            prefix = [t[: s - c + 1].view(np.int64) for t, s, c in zip(tokens, shared[chosen], least[chosen], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), pa.array(sizes[chosen]), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["key", "n", "tokens", "prefix"])

    dealt = answers.repartition(partitions(answers.sparkSession), "slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(run, "key long, n long, tokens binary, prefix array<long>")
    # A set stands in every slice that has a copy.
    return found.groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))


class Trie:
    """Sets of ascending codes as a compressed prefix tree; nodes in depth-first order, each with a run of one set's codes."""

    def __init__(self, codes: np.ndarray, edges: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        raw = codes.astype(">u4").tobytes()
        order = sorted(range(n), key=lambda i: raw[4 * edges[i] : 4 * edges[i + 1]])
        parent, begin, end, depth, ending = [-1], [0], [0], [0], [[]]
        path, before = [0], None  # nodes from the root to the last set
        for s in order:
            a, b = int(edges[s]), int(edges[s + 1])
            shared = 0
            if before is not None:
                m = min(b - a, before[1] - before[0])
                differ = codes[a : a + m] != codes[before[0] : before[0] + m]
                shared = int(differ.argmax()) if differ.any() else m
            while depth[path[-1]] > shared and depth[parent[path[-1]]] >= shared:
                path.pop()
            if depth[path[-1]] > shared:  # cut the node: its upper part gets a node of its own
                low = path.pop()
                top = len(parent)
                at = begin[low] + shared - depth[parent[low]]
                parent.append(parent[low]), begin.append(begin[low]), end.append(at), depth.append(shared), ending.append([])
                parent[low], begin[low] = top, at
                path.append(top)
            if b - a > shared:
                parent.append(path[-1]), begin.append(a + shared), end.append(b), depth.append(b - a), ending.append([s])
                path.append(len(parent) - 1)
            else:
                ending[path[-1]].append(s)
            before = (a, b)
        self.codes, self.sizes, self.lengths = codes, sizes, np.diff(edges)
        self.parent, self.begin, self.end, self.depth = (np.array(x, np.int64) for x in (parent, begin, end, depth))
        m = len(parent)
        self.least, self.most, self.longest = np.full(m, 2**62), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i in np.argsort(-self.depth, kind="stable"):  # children before parents
            for s in ending[i]:
                self.least[i], self.most[i], self.longest[i] = min(self.least[i], sizes[s]), max(self.most[i], sizes[s]), max(self.longest[i], self.lengths[s])
            if (p := self.parent[i]) >= 0:
                self.least[p], self.most[p], self.longest[p] = min(self.least[p], self.least[i]), max(self.most[p], self.most[i]), max(self.longest[p], self.longest[i])
        order = np.argsort(self.parent, kind="stable")
        self.children, self.child_at = order, np.searchsorted(self.parent[order], np.arange(-1, m + 1))
        self.ending_at = np.r_[0, np.cumsum([len(x) for x in ending])]
        self.ending = np.array([s for x in ending for s in x], np.int64)

    def similar(self, own: np.ndarray, size: int, percent: int, mask: np.ndarray) -> np.ndarray:
        """The sets that are similar to one of `size` with the ascending codes `own`. mask: scratch, False for all codes."""
        mask[own] = True
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while True:
            # Sets that end here.
            n = self.ending_at[nodes + 1] - self.ending_at[nodes]
            if n.any():
                sets = self.ending[np.repeat(self.ending_at[nodes], n) + _inner(n)]
                both = np.repeat(overlap, n)
                found.append(sets[100 * both >= percent * (size + self.sizes[sets] - both)])
            n = self.child_at[nodes + 2] - self.child_at[nodes + 1]
            if not n.any():
                break
            above = np.repeat(overlap, n)
            nodes = self.children[np.repeat(self.child_at[nodes + 1], n) + _inner(n)]
            near = (100 * self.most[nodes] >= percent * size) & (percent * self.least[nodes] <= 100 * size)
            nodes, above = nodes[near], above[near]
            if not len(nodes):
                break
            runs = self.end[nodes] - self.begin[nodes]
            hits = mask[self.codes[np.repeat(self.begin[nodes], runs) + _inner(runs)]]
            overlap = above + np.add.reduceat(hits, np.r_[0, np.cumsum(runs)[:-1]], dtype=np.int64)
            remain = np.minimum(self.longest[nodes] - self.depth[nodes], len(own) - np.searchsorted(own, self.codes[self.end[nodes] - 1], "right"))
            best = overlap + remain
            least = np.maximum(self.least[nodes], -(-percent * size // 100))
            live = 100 * best >= percent * (size + least - best)
            nodes, overlap = nodes[live], overlap[live]
            if not len(nodes):
                break
        mask[own] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _inner(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def linked(tokens: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one of its component. tokens: hashes that may be shared; sizes: of the whole sets."""
    joined, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, inverse, count = np.unique(joined, return_inverse=True, return_counts=True)
    # The order within the trie: what most sets share comes first, so that they share their paths.
    code = np.empty(len(count), np.int64)
    code[np.argsort(-count, kind="stable")] = np.arange(len(count))
    keep = count[inverse] > 1
    codes, owner = code[inverse][keep], owner[keep]
    order = np.lexsort((codes, owner))
    codes = codes[order]
    edges = np.searchsorted(owner[order], np.arange(len(tokens) + 1))
    trie, mask = Trie(codes, edges, sizes), np.zeros(len(count), bool)
    label, asked = np.arange(len(tokens)), np.zeros(len(tokens), bool)
    while True:
        largest = np.bincount(label).argmax()
        left = np.flatnonzero(~asked & (label != largest)) if asked.any() else np.arange(1)
        if not len(left):
            return label
        for x in left[:64]:  # the largest component is looked for again now and then only
            asked[x] = True
            hit = trie.similar(codes[edges[x] : edges[x + 1]], int(sizes[x]), percent, mask)
            names = np.unique(np.r_[label[hit], label[x]])
            if len(names) > 1:
                label[np.isin(label, names)] = names[0]


def _linked_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, whole) within each (root, i, j) of (root, i, j, key, n, tokens); whole: the block is all of its candidate group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for name, rows in _grouped(batches, "block"):
            keys, sizes = np.array([r["key"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
            label = linked([np.frombuffer(r["tokens"], np.uint64) for r in rows], sizes, percent)
            low = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(low, label, keys)
            other = low[label] != keys
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[other]), pa.array(low[label][other]), pa.array([rows[0]["whole"]] * int(other.sum()), pa.bool_())], names=["a", "b", "whole"])

    dealt = sets.repartition(partitions(sets.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long, whole boolean")


def _candidate_groups(sets: DataFrame) -> DataFrame:
    """(key, root) of each set that shares a hash of its prefix with another."""
    tokens = sets.select("key", F.explode("prefix").alias("token"))
    least = tokens.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token", "low")
    edges = tokens.join(least, "token").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    return components(edges)


def set_components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Heads (doc_id, row_key, n, key) of all rows, and (key, root) of the sets that are linked with another."""
    spark = docs.sparkSession
    seen = materialize(_heads(docs, size), "set-heads")
    heads = seen.where("n is not null").select("doc_id", "row_key", "n", "key")
    heads._docspark_path = seen._docspark_path
    total, shingles = heads.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = seen.where("hot is not null").groupBy("hot").agg(F.sum("n_hot").alias("n")).where(F.col("n") >= max(1000, total / HOT))
    # At most HOT times the mean set size, since each stands in one set of HOT at least.
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["hot"] for r in often.collect()], np.int64).view(np.uint64)))
    parts = max(4 * partitions(spark), shingles // RANGE)  # so that what a task holds of a range doesn't grow with the data
    sets = materialize(_survivors(_shared_hashes(_hash_blocks(docs, size, parts, hot), parts), percent), "shared-sets")
    groups = _candidate_groups(sets)
    members = sets.join(groups, "key").select("key", "root", "n", "tokens")
    room = members.groupBy("root").agg(F.ceil(F.sum(F.octet_length("tokens")) / (8 * BLOCK)).alias("blocks"))
    members = members.join(room, "root").withColumn("own", F.pmod(F.hash("key"), F.col("blocks")))
    # Every pair of blocks meets: a set goes to as many tasks as its group has blocks.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    edges = materialize(_linked_blocks(members.select(block.alias("block"), (F.col("blocks") == 1).alias("whole"), "key", "n", "tokens"), percent), "links")
    done = edges.where("whole").select(F.col("a").alias("key"), F.col("b").alias("root"))
    parted = edges.where("not whole")
    if not parted.isEmpty():
        done = done.unionByName(components(parted.select("a", "b")).where("key <> root"))
    return heads, done


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, keeper) of each row of (doc_id, text).

    component_id is the smallest doc_id that the row is connected with. keeper is true for the rows of the component's
    one text that stays, the smallest by (doc_id, row_key) with null ids last; equal rows share it.
    """
    with temporary(docs.sparkSession) as keep:
        heads, roots = set_components(docs, size, percent)
        keep(heads)
        rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("row"))
        sets = heads.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min(rank).alias("best"))
        sets = materialize(sets.join(roots.withColumnRenamed("root", "_root"), "key", "left").withColumn("group", F.coalesce("_root", "key")).drop("_root"), "named-sets")
        # Of a component the smallest, over its sets; each set looks it up, then each row looks up its set.
        first = sets.groupBy("group").agg(F.count("*").alias("n_rows"), F.min("low").alias("low"), F.min("best").alias("best"))
        found = look_up(sets.select("key", "group", "copies"), first, "group", sets.count())
        found = keep(materialize(found.select("key", F.col("copies").alias("n_rows"), "low", "best"), "set-components"))
    own = look_up(heads.where("n > 0"), found, "key", heads.count())
    keeper = (F.col("best.row") == F.col("row_key")) & F.col("best.id").eqNullSafe(F.col("doc_id"))
    own = own.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), keeper.alias("keeper"))
    return own.unionByName(heads.where("n = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates; rows without a word all stay, of equal texts of one id one row.

    Null text has no word; null ids are the last choice. Columns of any other name and type pass through.
    """
    key, own, n = (free(x, docs.columns) for x in ("_key", "_id", "_n"))
    found = near_duplicates(docs.select("doc_id", "text"), size, percent).where("keeper and n_shingles > 0")
    kept = found.groupBy("doc_id", "row_key").agg(F.count("*").alias(n)).withColumnsRenamed({"doc_id": own, "row_key": key})
    word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.where(word).withColumn(free("_hash", docs.columns), F.xxhash64(F.coalesce("text", F.lit(""))))
    hashed = keyed[keyed.columns[-1]]
    joined = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[own]) & (hashed == kept[key]))
    # Where several rows have the text and the id, tasks keep one each and the first of those stays.
    once = joined.where(F.col(n) > 1).groupBy(own, key).agg(F.first(F.struct(*[keyed[c] for c in docs.columns])).alias(n)).select(f"{n}.*")
    return docs.where(~word).unionByName(joined.where(F.col(n) == 1).select(*docs.columns)).unionByName(once)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reached r JOIN both_ways e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.root, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM reached GROUP BY 1) r ON r.doc_id = w.doc_id
"""
