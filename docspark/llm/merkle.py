"""A Merkle manifest of a dataset by nested-struct rollup: a hash for each row, a tree for each group of rows, and a proof for each row.

H is the lowercase hex sha256 of its inputs one after another. Leaves are ranked within their group; the digits of the
rank in base FANOUT say where a leaf stands in the tree. Leaves of one block, BLOCK = FANOUT ** DIGITS consecutive ranks,
are dealt to one task once, and there the digit columns are grouped away one after another: each grouping collects the
children of a node as structs within the node's struct, and hashes their hashes. What is left is a row for each block,
a tree of at most BLOCK leaves. Blocks are the leaves of the next tier, rolled up in the same way, until a group has a
single node, its subroot; subroots, ranked by group, are rolled up in the same way to the root. Where fewer nodes than
a tier has levels are left, a node passes its only child's hash on, so every leaf of a group is as deep as the rule says.

Proofs go down the same structs: a transform gives each child its siblings to the left and to the right, level by level,
and an explode ends a block, so no leaf meets another row in a join. Between tiers the path above a block is handed to the
block's row: one join on the block's number, with one row on either side, on rows of at most BLOCK leaves' hashes. (One
struct for a whole group would need no such join, but would be a row that grows with the data.)

Ranks need no group in one task: leaves are sorted by group and order into ranges, counted in each range, and a rank is
the place in the range plus what lies before it. Equal rows differ by where they were read, so no key is too hot to cut.

Nulls: a null field is hashed as `-`, a null group is a group that stands first, null ids stand first in their group and
are never tampered with. Equal ids are ordered by leaf; repeated rows are leaves each. An empty table gives an empty one.
Of the columns of documents only the five that are hashed are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import materialize, partitions, table

FANOUT, DIGITS = 8, 3
BLOCK = FANOUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings of one level, in order, as one string of hashes on either side.
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value that can't be mistaken for its neighbours: byte count, colon, value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a document; changed: other columns in the place of its own."""
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def tampered_leaf() -> Column:
    """The leaf after A-Z of the text went to lower case, where 3 divides crc32 of the id; null elsewhere."""
    upper = "".join(map(chr, range(65, 91)))
    changed = F.translate("text", upper, upper.lower())
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(text=changed))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (group, ...) with `rank`, from 0 in `order` within group, and `count`, the nodes of the group. Written."""
    read = nodes.withColumn("_read", F.monotonically_increasing_id())
    keys = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_read")]
    ranges = read.repartitionByRange(max(1, partitions(nodes.sparkSession)), *keys).sortWithinPartitions(*keys).drop("_read")
    # An id that counts up within each range, after the range's number.
    placed = materialize(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")), "merkle-ranked")
    runs = placed.groupBy("group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # as many rows as ranges and groups
    within = Window.partitionBy("group")
    before = F.coalesce(F.sum("_n").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("group").alias("_group"), F.col("_range").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias("count"))
    joined = placed.join(runs, placed["group"].eqNullSafe(F.col("_group")) & (placed["_range"] == F.col("_of")))
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_group", "_of", "_shift")


def rolled(nodes: DataFrame) -> DataFrame:
    """Blocks (group, rank, count, h, tree) of nodes (group, rank, count, h, item): tree nests DIGITS levels of struct<digit, h, item>, items at the bottom.

    rank and count are the blocks' own. Only the first grouping shuffles: what it is dealt by is what the others group by.
    """
    block = F.floor(F.col("rank") / BLOCK)
    digits = [(F.floor(F.col("rank") / FANOUT**k) % FANOUT).cast("int").alias(f"_d{k}") for k in range(DIGITS)]
    now = nodes.select("group", block.alias("_block"), *digits, "count", "h", "item")
    now = now.repartition(partitions(nodes.sparkSession), "group", "_block")
    for k in range(DIGITS):
        keys = ["group", "_block", *[f"_d{i}" for i in range(k + 1, DIGITS)]]
        children = F.array_sort(F.collect_list(F.struct(F.col(f"_d{k}").alias("digit"), "h", "item")))
        now = now.groupBy(*keys).agg(F.first("count").alias("count"), children.alias("item"))
        many = F.col("count") > FANOUT**k  # nodes are left on the level below
        now = now.withColumn("h", F.when(many, F.sha2(F.array_join(F.transform("item", lambda c: c["h"]), ""), 256)).otherwise(F.col("item")[0]["h"]))
    own = F.ceil(F.col("count") / BLOCK)
    return now.select("group", F.col("_block").alias("rank"), own.alias("count"), F.col("count").alias("below"), "h", F.col("item").alias("tree"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over ranked nodes, each written, until every group has one block."""
    tiers = [materialize(rolled(nodes), "merkle-tier")]
    while not tiers[-1].where("count > 1").isEmpty():
        tiers.append(materialize(rolled(tiers[-1].select("group", "rank", "count", "h", F.lit(0).alias("item"))), "merkle-tier"))
    return tiers


def _side(children: Column, digit: Column, left: bool) -> Column:
    there = F.filter(children, lambda c: c["digit"] < digit if left else c["digit"] > digit)
    return F.array_join(F.transform(there, lambda c: c["h"]), "")


def unrolled(blocks: DataFrame) -> DataFrame:
    """(group, rank, h, item, path) of the nodes that the blocks (group, rank, below, tree, path) hold: path has a STEP for each level, lowest first.

    path of a block is the path above it.
    """

    def down(children: Column, path: Column, level: int) -> Column:
        """Arrays of leaves of this subtree, with their places in the block."""
        step = lambda c: F.struct(_side(children, c["digit"], True).alias("left"), _side(children, c["digit"], False).alias("right"))
        # A level on which nothing was hashed has no step.
        longer = lambda c: F.when(F.col("below") > FANOUT**level, F.concat(F.array(step(c)), path)).otherwise(path)
        if level == 0:
            return F.transform(children, lambda c: F.struct(c["digit"].cast("long").alias("at"), c["h"].alias("h"), c["item"].alias("item"), longer(c).alias("path")))
        deeper = lambda c: F.transform(down(c["item"], longer(c), level - 1), lambda x: x.withField("at", c["digit"].cast("long") * FANOUT**level + x["at"]))
        return F.flatten(F.transform(children, deeper))

    each = blocks.select("group", "rank", F.explode(down(F.col("tree"), F.col("path"), DIGITS - 1)).alias("n"))
    return each.select("group", (F.col("rank") * BLOCK + F.col("n.at")).alias("rank"), "n.h", "n.item", "n.path")


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """unrolled() nodes below the lowest tier. tops (group, path): the path above each group's subroot."""
    path_of = tops.withColumn("rank", F.lit(0).cast("long"))
    for k, tier in reversed(list(enumerate(tiers))):
        above = path_of.select(F.col("group").alias("_group"), F.col("rank").alias("_rank"), "path")
        blocks = tier.join(above, tier["group"].eqNullSafe(F.col("_group")) & (tier["rank"] == F.col("_rank"))).drop("_group", "_rank")
        path_of = unrolled(blocks)
        if k:
            path_of = path_of.drop("h", "item")
    return path_of


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) of each row of documents, in a tree for each lang; changed: the tampered leaf, if any."""
    leaves = docs.select(*FIELDS).select(F.col("lang").alias("group"), "doc_id", leaf().alias("h"), tampered_leaf().alias("changed"))
    placed = ranked(leaves, ["doc_id", "h"])
    tiers = climb(placed.select("group", "rank", "count", "h", F.struct("doc_id", "changed").alias("item")))
    # One node is left of each group: the leaves of the last tree, which is one group.
    subroots = tiers[-1].select(F.lit(0).alias("group"), F.col("group").alias("name"), "h")
    over = climb(ranked(subroots, ["name"]).select("group", "rank", "count", "h", F.col("name").alias("item")))
    root = over[-1].select(F.lit(0).alias("group"), F.col("h").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    names = materialize(descend(over, root.select("group", "path")).select(F.col("item").alias("group"), F.col("h").alias("subroot"), "path"), "merkle-subroots")
    # Every path's last step ends at the root, so the root needn't be joined to anything.
    last = names.withColumn("root", folded(F.col("subroot"), F.col("path")))
    tops = last.select("group", F.concat("path", F.array(F.struct(F.col("subroot").alias("left"), F.col("root").alias("right")))).alias("path"))
    found = descend(tiers, tops)
    named = F.element_at("path", -1)
    own = F.slice("path", F.lit(1), F.size("path") - 1)
    return found.select("item.doc_id", F.col("h").alias("leaf"), "item.changed", named["left"].alias("subroot"), named["right"].alias("root"), own.alias("path"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents."""
    rows = manifest(table(spark, sf_dir, "documents"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 7) -> str:
    """The rule level by level, for up to FANOUT ** levels rows of a group and as many groups.

    A level that has one node passes it on; p places a leaf, and its node on a level is p divided by FANOUT once more a level.
    """

    def tree(name: str, source: str) -> list[str]:
        parts = [f"{name}0 AS MATERIALIZED ({source})"]
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, p // {FANOUT} AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY g, p // {FANOUT})")
        # Siblings of each node, by level.
        for k in range(levels):
            parts.append(f"{name}_s{k} AS MATERIALIZED (SELECT a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r, any_value(a.n) > 1 AS on_path FROM {name}{k} a JOIN {name}{k} b ON a.g IS NOT DISTINCT FROM b.g AND a.p // {FANOUT} = b.p // {FANOUT} GROUP BY a.g, a.p)")
        return parts

    def fold(name: str, source: str, columns: str) -> list[str]:
        """Adds up proofs and folds `f` along the levels; source has g, p, proof, f."""
        parts, at = [], source
        for k in range(levels):
            parts.append(f"{source}_f{k} AS MATERIALIZED (SELECT {columns}, x.g, x.p, x.proof || CASE WHEN on_path THEN l || r ELSE '' END AS proof, CASE WHEN on_path THEN sha256(l || f || r) ELSE f END AS f FROM {at} x JOIN {name}_s{k} s ON s.g IS NOT DISTINCT FROM x.g AND s.p = x.p // {FANOUT**k})")
            at = f"{source}_f{k}"
        return parts

    enc = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    own = " || ".join(enc(c) for c in FIELDS)
    low = " || ".join(enc("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS)
    parts = [
        f"docs AS MATERIALIZED (SELECT doc_id, lang AS g, sha256({own}) AS leaf, sha256({low}) AS low FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM docs)",
        *tree("t", "SELECT g, p, leaf AS h, n FROM placed"),
        f"subroots AS MATERIALIZED (SELECT g AS name, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t{levels})",
        *tree("u", "SELECT 0 AS g, p, h, n FROM subroots"),
        # CRC-32, bit by bit over the digits of the id.
        "crc AS (SELECT doc_id, crc FROM (SELECT DISTINCT doc_id, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS reg FROM documents WHERE doc_id IS NOT NULL), LATERAL (SELECT xor(reg, 4294967295::BIGINT) AS crc))",
        "start AS MATERIALIZED (SELECT d.doc_id, d.leaf, d.g, d.p, '' AS proof, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS f FROM placed d LEFT JOIN crc ON crc.doc_id = d.doc_id)",
        *fold("t", "start", "x.doc_id, x.leaf"),
        f"upper AS MATERIALIZED (SELECT x.doc_id, x.leaf, s.h AS subroot, 0 AS g, s.p, x.proof, x.f FROM start_f{levels - 1} x JOIN subroots s ON s.name IS NOT DISTINCT FROM x.g)",
        *fold("u", "upper", "x.doc_id, x.leaf, x.subroot"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM upper_f{levels - 1}, (SELECT h FROM u{levels})"


ORACLE = _oracle()
