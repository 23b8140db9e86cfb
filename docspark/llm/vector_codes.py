"""Product codes of vectors, whose nearest codebook entries are found by equal-average search.

A vector is cut into PARTS equal parts; each part is replaced by the number of its nearest entry in that part position's
codebook. Codebooks start from the vectors with the smallest ids and are moved, ROUNDS times, to the means of the parts
that chose them. All arithmetic is on whole numbers, so results don't depend on how rows are dealt.

Search: entries stand sorted by the sum of their components. A part starts at the entry whose sum is nearest to its own
and goes outward both ways; since (sum a - sum b)^2 <= d * |a - b|^2, a direction ends as soon as the squared gap of the
sums over the dimension strictly exceeds the best distance. Equal distances go to the lower entry, so a gap that only
equals the best distance is still looked at.

A round is one pass over the vectors: tasks search, add up the parts of each entry, and Spark adds up those sums. What is
sent to every task and returned to the driver is the codebooks, ENTRIES x dimension numbers, whatever the number of rows.

Rows whose vector is null, or holds a null or non-finite component, are dropped. Repeated rows and equal ids count each;
null ids are kept and stand last, equal ids are ordered by their components. The dimension is that of the vector with the
smallest id; one of another length, and one with a component beyond LARGEST after scaling, where 64-bit sums of squares
would no longer be exact, takes no part: its code and error are null. An empty vector is at distance 0 from any other. A
dimension that PARTS doesn't divide is an error.
An empty table gives an empty one. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of this size and 8,192 dimensions keep squared distances below 2**63.
LARGEST = 2**24
#: Parts that are searched together in a task, and labels that hold a row in so many at least go by a broadcast of their sums.
TOGETHER, HOT = 8192, 256


class SortedBook:
    """One part position's codebook (entries x components), in the order of the entries' sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(1)
        self.number = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.number], sums[self.number]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part's nearest entry, the lowest of equal ones, and its squared distance."""
        n, dimension = parts.shape
        best, chosen = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        if not n or not dimension:
            return chosen, np.zeros(n, np.int64)
        sums = parts.sum(1)

        def look(rows: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, int]:
            """One entry further on one side, for the rows that may still find a nearer one there."""
            live = (at >= 0) & (at < len(self.sums))
            rows, at = rows[live], at[live]
            gap = (sums[rows] - self.sums[at]).astype(np.float64)
            # A little more than the bound: rounding may add an entry to look at, never leave one out.
            live = gap * gap <= best[rows].astype(np.float64) * dimension * (1 + 1e-9)
            rows, at = rows[live], at[live]
            away = parts[rows] - self.entries[at]
            distance, number = np.einsum("ij,ij->i", away, away), self.number[at]
            nearer = (distance < best[rows]) | (distance == best[rows]) & (number < chosen[rows])
            best[rows[nearer]], chosen[rows[nearer]] = distance[nearer], number[nearer]
            return rows, at + step, step

        start = np.searchsorted(self.sums, sums)
        sides = [(np.arange(n), start - 1, -1), (np.arange(n), start, 1)]
        while sides:
            sides = [s for s in (look(*side) for side in sides) if len(s[0])]
        return chosen, best


def usable(vector: Column) -> Column:
    """No null, no non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors that are usable, with `ints`: floor(scale * x) of each component, or null where one is beyond LARGEST."""
    scaled = F.transform(F.col(vector), lambda x: F.least(F.greatest(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(-LARGEST - 1)), F.lit(LARGEST + 1)).cast("int"))
    good = ~F.exists("ints", lambda x: F.abs(x) > LARGEST)
    return vectors.where(usable(F.col(vector))).withColumn("ints", scaled).withColumn("ints", F.when(good, F.col("ints")))


def _cut(column: pa.Array, parts: int, dimension: int) -> np.ndarray:
    """Vectors as an array (vector, part, component)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, dimension)


def first_books(ints: DataFrame, id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the smallest ids."""
    rows = ints.where("ints is not null").orderBy(F.col(id_column).asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    dimension = len(rows[0]["ints"])
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} equal parts")
    # One of another length may stand among the smallest; it takes no part.
    kept = [r["ints"] for r in ints.where(F.size("ints") == dimension).orderBy(F.col(id_column).asc_nulls_last(), "ints").limit(entries).select("ints").collect()]
    return np.ascontiguousarray(np.array(kept, np.int64).reshape(len(kept), parts, dimension // parts).transpose(1, 0, 2))


def _sums(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): of the parts that choose each entry, how many there are and the sums of their components."""
    parts, entries, dimension = books.shape
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_books = [SortedBook(b) for b in shared.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dimension), np.int64)

        def sent() -> pa.RecordBatch:
            part, entry = np.nonzero(count)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dimension, pa.int32()), pa.array(total[part, entry].ravel()))
            out = pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])
            count[:], total[:] = 0, 0
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                rows = _cut(batch.column(0).slice(i, TOGETHER), parts, dimension)
                for p, book in enumerate(sorted_books):
                    own = np.ascontiguousarray(rows[:, p])
                    chosen, _ = book.nearest(own)
                    count[p] += np.bincount(chosen, minlength=entries)
                    order = np.argsort(chosen, kind="stable")
                    edges = np.flatnonzero(np.r_[True, chosen[order][1:] != chosen[order][:-1]])
                    total[p, chosen[order][edges]] += np.add.reduceat(own[order], edges, axis=0)
            if count.max(initial=0) > 2**38:  # sums stay below 2**63
                yield sent()
        yield sent()

    found = ints.where(F.size("ints") == parts * dimension).select("ints").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def train(ints: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after `rounds` of assignment and replacement by floored means. ints: a written table."""
    if not books.size:
        return books
    for _ in range(rounds):
        rows = _sums(ints, books).collect()  # a row for each number of the codebooks at most
        books = books.copy()
        for r in rows:
            books[r["part"], r["entry"], r["place"]] = int(r["value"]) // r["n"]
    return books


def encode(ints: DataFrame, books: np.ndarray, columns: list[str]) -> DataFrame:
    """`columns` of ints with `code`, two hex digits for each part (of 256 entries at most), and `error`, the squared distance to what the code stands for."""
    parts, entries, dimension = books.shape
    shared = ints.sparkSession.sparkContext.broadcast(books)
    picked = ints.select(*columns, F.when(F.size("ints") == parts * dimension, F.col("ints")).alias("ints"))
    schema = picked.drop("ints").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    for name in ("code", "error"):
        schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_books = [SortedBook(b) for b in shared.value]
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                vectors = some.column(len(columns))
                has = np.asarray(vectors.is_valid())
                codes, errors = np.full(len(has), None, object), np.zeros(len(has), np.int64)
                if has.any() and entries:
                    rows = _cut(vectors.filter(pa.array(has)), parts, dimension)
                    found = [book.nearest(np.ascontiguousarray(rows[:, p])) for p, book in enumerate(sorted_books)]
                    codes[has] = [c.tobytes().hex() for c in np.stack([f[0] for f in found], 1).astype(np.uint8)]
                    errors[has] = np.sum([f[1] for f in found], 0)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64(), mask=pa.array(~has).to_numpy(zero_copy_only=False))], names=[*columns, "code", "error"])

    return picked.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded, a written table, with `label_error`: error summed over all rows of equal label, nulls together.

    Sums of labels that have one row in HOT, HOT labels at most, are sent to all tasks, so their rows aren't shuffled;
    other labels meet their sums in a join. A sum beyond 64 bits is null.
    """
    n = coded.count()
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = materialize(sums, "label-errors")
    hot = sums.where(F.col("_n") * HOT >= n)
    rows = coded.join(F.broadcast(hot.select("_label", F.col("label_error").alias("_hot"), F.lit(True).alias("_is_hot"))), coded[label].eqNullSafe(F.col("_label")), "left").drop("_label")
    own = rows.where("_is_hot").withColumn("label_error", F.col("_hot"))
    cold = rows.where("_is_hot is null").join(sums.where(F.col("_n") * HOT < n).select("_label", "label_error"), rows[label].eqNullSafe(F.col("_label")))
    return own.select(*coded.columns, "label_error").unionByName(cold.select(*coded.columns, "label_error"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of all usable rows of embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ints = materialize(whole_numbers(vectors).select("vec_id", "label", "ints"), "vectors")
    books = train(ints, first_books(ints))
    coded = with_label_error(materialize(encode(ints, books, ["vec_id", "label"]), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds one after another; squared distances as inner products of whole numbers, which doubles hold exactly."""
    book = "SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)"
    steps = [f"book0 AS MATERIALIZED ({book})"]
    near = """chosen{0} AS MATERIALIZED (SELECT p.vec_id, p.part, p.label, arg_min({{'entry': b.entry, 'd': list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v)}}, {{'d': list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), 'entry': b.entry}}) AS c FROM parts p JOIN book{0} b USING (part) GROUP BY ALL)"""
    for k in range(ROUNDS):
        steps.append(near.format(k).replace("p.label,", "p.v,"))
        steps.append(f"means{k} AS (SELECT part, entry, list(m ORDER BY place) AS v FROM (SELECT part, c.entry AS entry, i AS place, floor(sum(v[i]) / count(*)) AS m FROM chosen{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY ALL)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON m.part = b.part AND m.entry = b.entry)")
    steps.append(near.format(ROUNDS))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM kept, (SELECT unnest(range(4)) AS p)),
{', '.join(steps)},
codes AS (SELECT vec_id, label, string_agg(printf('%02x', c.entry::INTEGER), '' ORDER BY part) AS code, sum(c.d)::BIGINT AS error FROM chosen{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM book{ROUNDS})) AS codebooks_sha256 FROM codes"""


ORACLE = _oracle()
