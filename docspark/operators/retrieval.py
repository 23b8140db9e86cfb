"""Ranked retrieval for tables of queries: dense, keyword and id search, fusion, diversification, context.

Results are rows (query_id, chunk_id, score, rank), ranks from 0. Ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import dense_index, keyword_index
from docspark.operators.dense_index import DenseIndex
from docspark.operators.keyword_index import KeywordIndex, in_use, terms
from docspark.sources.shared import written

#: Numbers in query vectors that are sent to every task at once; more queries meet the chunks in blocks.
SENT = 20_000_000
#: Characters of the runs by which needles are looked up, rows that a task looks at, about, and rows for each needle up to which needles share their first run.
KEY, PAIRS, SHARED = 5, 500_000, 16
#: A word of digits alone, found from its first digit, so that all other characters are passed at once.
WHOLE_NUMBER = r"[0-9](?<![A-Za-z0-9-][0-9])[0-9]*+(?![A-Za-z0-9-])"


def live(chunks: DataFrame) -> DataFrame:
    return chunks.where(in_use())


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows of each query, with rank."""
    order = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def dense(queries: DataFrame, chunks: DataFrame, k: int = 20, index: DenseIndex | None = None) -> DataFrame:
    """Exact nearest chunks by cosine, within the query's vault, for queries that have a vector.

    Up to SENT numbers in query vectors, every task multiplies its chunks with all queries and keeps k of each; more
    queries, and those that come with an index, meet the chunks in blocks.
    """
    queries = queries.where("query_vec is not null")
    if index is None and (queries.agg(F.sum(F.size("query_vec"))).first()[0] or 0) > SENT:
        index = dense_index.build(chunks)
    if index is not None:
        return dense_index.search(queries, index, k)
    scope = live(chunks).where("embedding is not null").select("chunk_id", "vault_id", "embedding")
    rows = queries.select("query_id", "vault_id", "query_vec").collect()  # at most SENT numbers
    if not rows:
        return top(queries.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), k)
    ids, vaults = np.array([r["query_id"] for r in rows]), np.array([r["vault_id"] for r in rows])
    matrix = np.array([r["query_vec"] for r in rows], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    sent = queries.sparkSession.sparkContext.broadcast((ids, vaults, matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vaults, matrix = sent.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            chunk = frame["chunk_id"].to_numpy()
            scores = np.where(vaults[:, None] == frame["vault_id"].to_numpy()[None, :], matrix @ x.T, -np.inf)
            order = np.lexsort((np.broadcast_to(chunk, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
            best = np.take_along_axis(scores, order, 1).ravel()
            out = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "chunk_id": chunk[order.ravel()], "score": best})
            yield out[np.isfinite(best)]

    return top(scope.mapInPandas(run, "query_id long, chunk_id long, score double"), k)


def containing(texts: DataFrame, text: str, wanted: DataFrame, needle: str, by: list[str]) -> DataFrame:
    """Rows of texts beside the needles that their `text` holds, in any case, where the columns `by` agree; a row for each such pair.

    Texts aren't compared with all needles: a needle is looked up by a run of KEY of its characters (a shorter needle is one
    run, of its own length), and where a text has that run, what stands around it is cut out at the needle's length and meets
    the needle on equal keys. So needles of one length that have one run at one place are looked up together: a text gives one
    row for all of them. That run is a needle's first one if needles share it so well that there are at most SHARED rows for
    each; otherwise it is the one that the fewest texts hold. A needle with a run that no text has is nowhere. If all needles
    are numbers, texts give their digits alone. An empty needle is nowhere, and so is a null one.

    How many rows texts give is known before they meet: tasks grow in number with it, and a needle by itself that
    may be in more than PAIRS texts has them dealt over several tasks.
    """
    low, none = F.lower(text), F.array().cast("array<string>")
    in_by = [f"_by_{c}" for c in by]
    needles = wanted.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(needle).alias("_needle"), F.lower(needle).alias("_low")).where("_low <> ''").distinct()
    needles = written(needles.withColumn("_size", F.least(F.char_length("_low"), F.lit(KEY))), "needles")
    kinds = needles.groupBy("_size").agg(F.bool_and(F.rlike("_low", F.lit("^[0-9]+$"))).alias("digits")).collect()  # KEY rows
    numbers = all(r["digits"] for r in kinds)
    body = F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit("[0-9]+"), 0)), " ") if numbers else low

    def cut(of: Column, size: Column | int) -> Column:
        """The runs of `size` characters, in order."""
        last, size = F.char_length(of) - size + 1, F.lit(size) if isinstance(size, int) else size
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(of, i, size))).otherwise(none)

    sizes = [r["_size"] for r in kinds]
    held = texts.withColumn("_body", body)
    each = [F.transform(cut(F.col("_body"), n), lambda run, i: F.struct(run.alias("_run"), (i + 1).alias("_at"))) for n in sizes]
    placed = held.withColumn("_cut", F.explode(F.concat(*each) if each else F.array().cast("array<struct<_run:string,_at:int>>"))).select(*held.columns, "_cut._run", "_cut._at")

    def counted(asked: DataFrame) -> DataFrame:
        """(by, _run, _n): how often texts have the runs asked."""
        asked = written(asked.select(F.col("_run").alias("_asked")).distinct(), "asked")  # few, as a rule, so that they are sent to the texts
        met = placed.select(*by, "_run").join(asked, F.col("_run") == F.col("_asked"), "left_semi")
        return written(met.groupBy(*by, "_run").agg(F.count("*").alias("_n")), "runs").withColumnsRenamed({c: f"_by_{c}" for c in by})

    # A place: a run of a length's needles and where it begins in them.
    first, place = F.substr("_low", F.lit(1), F.col("_size")), [*in_by, "_run", "_off", "_len"]
    needles = needles.select("*", first.alias("_run"), F.lit(0).alias("_off"), F.char_length("_low").alias("_len"))
    alike = needles.groupBy(*place).agg(F.count("*").alias("_m"))
    alike = written(_joined(alike, counted(needles), [*in_by, "_run"]).withColumn("_shared", F.col("_n") <= F.col("_m") * SHARED), "places")
    at_first = _joined(needles, alike.select(*place, "_n", "_m", "_shared"), place)
    others = written(at_first.where("not _shared").select(*in_by, "_needle", "_low", "_size", "_len"), "needles")
    grams = others.select("*", F.posexplode(cut(F.col("_low"), F.col("_size"))).alias("_off", "_run"))
    found = _joined(grams, counted(grams), [*in_by, "_run"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = found.groupBy(*in_by, "_needle", "_low", "_len").agg(F.min(F.struct("_n", "_run", "_off")).alias("_k")).select(*in_by, "_needle", "_low", "_len", "_k.*").where("_n > 0")
    # Needles that share a run are in SHARED texts each at most, on average; one of the others may be in very many.
    chosen = written(at_first.where("_shared").select(*in_by, "_needle", "_low", "_run", "_off", "_len", F.lit(0).cast("long").alias("_n")).unionByName(rarest), "needles")
    places = chosen.groupBy(*in_by, "_run").agg(F.collect_set(F.struct("_off", "_len")).alias("_places"))
    rows = alike.where("_shared").agg(F.sum("_n")).first()[0] or 0
    rows += chosen.groupBy(*place).agg(F.max("_n").alias("_n")).agg(F.sum("_n")).first()[0] or 0
    places = written(places.withColumnsRenamed({c: f"_p{c}" for c in (*in_by, "_run")}), "places")
    met = placed.join(places, [*[placed[c] == places[f"_p_by_{c}"] for c in by], placed["_run"] == places["_p_run"]]).select(*held.columns, "_run", "_at", F.explode("_places").alias("_place")).select(*held.columns, "_run", "_at", "_place.*")
    begin = F.col("_at") - F.col("_off")
    met = met.where((begin >= 1) & (begin + F.col("_len") - 1 <= F.char_length("_body"))).withColumn("_low", F.substr("_body", begin, F.col("_len")))
    met = met.where(F.instr(F.col("_body"), F.col("_low")) == begin)  # a text that holds a needle twice is one row
    key = ["_low", "_run", "_off"]
    hot = chosen.groupBy(*in_by, "_low").agg(F.ceil(F.sum("_n") / PAIRS).cast("int").alias("_deals")).where("_deals > 1")
    hot = written(hot.withColumnsRenamed({c: f"_hot{c}" for c in (*in_by, "_low")}), "hot-needles")
    if not hot.isEmpty():
        chosen = chosen.join(hot, [chosen[c] == hot[f"_hot{c}"] for c in (*in_by, "_low")], "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).select(*chosen.columns, "_deal")
        met = met.join(hot, [*[met[c] == hot[f"_hot_by_{c}"] for c in by], met["_low"] == hot["_hot_low"]], "left").withColumn("_deal", F.pmod(F.xxhash64(*texts.columns), F.coalesce("_deals", F.lit(1))).cast("int")).select(*met.columns, "_deal")
        key.append("_deal")
    tasks = rows // PAIRS
    if tasks > 1:
        tasks = max(tasks, texts.sparkSession.sparkContext.defaultParallelism)
        chosen, met = chosen.repartition(tasks, *in_by, *key), met.repartition(tasks, *by, *key)
    hit = met.join(chosen.drop("_len", "_n"), [*[met[c] == chosen[f"_by_{c}"] for c in by], *[met[c] == chosen[c] for c in key]])
    return hit.select(*[met[c] for c in texts.columns], "_needle")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left beside right, which may come from the same table, on columns of one name."""
    other = right.withColumnsRenamed({c: f"_right{c}" for c in on})
    return left.join(other, [left[c] == other[f"_right{c}"] for c in on], how).drop(*[f"_right{c}" for c in on])


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 20, index: KeywordIndex | None = None) -> DataFrame:
    """Best chunks by Okapi BM25 of (query_id, vault_id, query_text), from a stored index; without one, it is built for these queries."""
    return keyword_index.search(queries, index or keyword_index.build(chunks, queries=queries), k)


def entity_search(asked: DataFrame, chunks: DataFrame, k: int = 20, ids: int = 10, mode: str = "contains") -> DataFrame:
    """Chunks that hold one of the first `ids` of (query_id, vault_id, entity_ids).

    "contains" finds an id within longer numbers too; "token" joins whole words. Neither compares all with all. If all ids
    are numbers, only the numbers of the texts are looked at, each once a vault. The k best chunks of each id are found
    before the queries that ask for it come in: a query's best are among them.
    """
    each = asked.select("query_id", "vault_id", F.explode(F.slice("entity_ids", 1, ids)).alias("entity"))
    wanted = written(each.select("vault_id", "entity").distinct(), "entities")
    numbers = wanted.agg(F.bool_and(F.rlike("entity", F.lit("^[0-9]+$")))).first()[0]
    scope, text, own = live(chunks), F.col("content_with_header"), ["vault_id", "chunk_id", "chunk_index"]
    if mode == "token":
        words = F.regexp_extract_all(text, F.lit(WHOLE_NUMBER), 0) if numbers else F.split(text, r"[^A-Za-z0-9-]+")
        held = scope.select(*own, F.explode(F.array_distinct(words)).alias("entity")).join(wanted, ["vault_id", "entity"], "left_semi")
    elif numbers:
        runs = written(scope.select(*own, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), 0))).alias("run")), "numbers")
        found = containing(runs.select("vault_id", "run").distinct(), "run", wanted, "entity", ["vault_id"])
        held = runs.join(found, ["vault_id", "run"]).select(*own, F.col("_needle").alias("entity")).distinct()
    else:
        held = containing(scope.select(*own, text), "content_with_header", wanted, "entity", ["vault_id"]).select(*own, F.col("_needle").alias("entity"))
    order = [F.col("chunk_index"), F.col("chunk_id")]
    best = held.withColumn("_n", F.row_number().over(Window.partitionBy("vault_id", "entity").orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    once = best.join(each, ["vault_id", "entity"]).select("query_id", "chunk_id", "chunk_index").distinct()
    return once.withColumns({"score": F.lit(1.0), "rank": F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1}).where(F.col("rank") < k)


def fuse(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: 1 / (k + rank + 1) summed over lists; ties by the first list and rank that has the chunk."""
    union = None
    for i, one in enumerate(lists):
        one = one.select("query_id", "chunk_id", F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("at"), (1.0 / (k + F.col("rank") + 1)).alias("part"))
        union = one if union is None else union.unionByName(one)
    fused = union.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "at")
    return fused.withColumn("rank", F.row_number().over(order) - 1).drop("at")


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Indices chosen one by one: weight * likeness to the query - (1 - weight) * largest likeness to those chosen; the first on ties."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    query, vectors = unit(query), unit(vectors)
    near, chosen = vectors @ query, []
    most = np.full(len(vectors), -np.inf)
    while len(chosen) < min(k, len(vectors)):
        value = near if not chosen else weight * near - (1 - weight) * most
        value = np.where(np.isin(np.arange(len(vectors)), chosen), -np.inf, value)
        pick = int(np.argmax(value))
        chosen.append(pick)
        most = np.maximum(most, vectors @ vectors[pick])
    return chosen


def diversify(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's candidates, which are few; scores stay as they were.

    Up to k candidates pass as they are, and so do the first k of a query without a vector. Candidates without a vector follow those chosen.
    """
    vectors = queries.select("query_id", "query_vec")
    plain = ranked.join(vectors.where("query_vec is null").select("query_id"), "query_id")
    plain = plain.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).cast("long")).where(F.col("rank") < k).select("query_id", "chunk_id", "score", "rank")
    rows = ranked.join(vectors.where("query_vec is not null"), "query_id").join(chunks.select("chunk_id", "embedding"), "chunk_id", "left")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        has = part["embedding"].notna().to_numpy()
        if len(part) <= k or not has.any():
            out = part.head(k) if len(part) > k else part
        else:
            with_vector = part[has].reset_index(drop=True)
            vectors = np.stack(with_vector["embedding"].to_numpy()).astype(np.float64)
            picked = with_vector.iloc[mmr_order(np.asarray(part["query_vec"].iloc[0], np.float64), vectors, k, weight)]
            out = pd.concat([picked, part[~has].head(k - len(picked))])
        return out[["query_id", "chunk_id", "score"]].assign(rank=np.arange(len(out)))

    return rows.groupBy("query_id").applyInPandas(one, "query_id long, chunk_id long, score double, rank long").unionByName(plain)


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 5, weight: float = 0.7, index: KeywordIndex | None = None) -> DataFrame:
    """Dense and keyword search, 6k or 40 each, fused, then diversified."""
    fetch = max(6 * k, 40)
    return diversify(fuse(dense(queries, chunks, fetch), bm25(queries, chunks, fetch, index)), queries, chunks, k, weight)


def hybrid_once(queries: DataFrame, chunks: DataFrame, k: int = 5, weight: float = 0.7, index: KeywordIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, asker) of the queries, and hybrid()'s rows of the askers: queries of one vault and vector with the same of the words that the index has find the same."""
    index = index or keyword_index.build(chunks, queries=queries)
    words = keyword_index.known(queries, index).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("words"))
    keyed = queries.select("query_id", "vault_id", "query_text", "query_vec").join(words, "query_id", "left")
    keyed = written(keyed.withColumn("_same", F.struct("vault_id", "query_vec", "words")), "questions")
    askers = written(keyed.groupBy("_same").agg(F.min(F.struct("query_id", "query_text")).alias("first")).select("_same", F.col("first.query_id").alias("asker"), F.col("first.query_text").alias("query_text")), "askers")
    asks = askers.select(F.col("asker").alias("query_id"), "_same.vault_id", "query_text", "_same.query_vec")
    other = askers.select(F.col("_same").alias("_of"), "asker")
    return keyed.join(other, keyed["_same"].eqNullSafe(other["_of"])).select("query_id", "asker"), hybrid(asks, chunks, k, weight, index)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def exact_first(exact: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """All of exact, then other's rows that exact lacks, up to k more than exact has."""
    both = exact.withColumn("source", F.lit(0)).unionByName(other.withColumn("source", F.lit(1)), allowMissingColumns=True)
    once = first_of(both, ["query_id", "chunk_id"], [F.col("source"), F.col("rank")])
    order = Window.partitionBy("query_id").orderBy("source", "rank")
    room = F.count_if(F.col("source") == 0).over(Window.partitionBy("query_id")) + k
    return once.withColumn("_room", room).withColumn("rank", F.row_number().over(order) - 1).where("rank < _room").select("query_id", "chunk_id", "score", "rank")


def point_retrieve(queries: DataFrame, chunks: DataFrame, k: int = 8, index: KeywordIndex | None = None) -> DataFrame:
    """Retrieval for a statement about one entity: its ids lead the query, and chunks that hold an id come first."""
    boosted = queries.withColumn("query_text", T.entity_boost(F.col("query_text")))
    ids = queries.select("query_id", "vault_id", T.bare_ids(T.normalize_numbers(F.col("query_text"))).alias("entity_ids"))
    return exact_first(entity_search(ids, chunks, ids=3), hybrid(boosted, chunks, k, 1.0, index), k)


def multipass(first: DataFrame, second: DataFrame, chunks: DataFrame, k: int = 50, docs: int = 20) -> DataFrame:
    """Two passes, then every chunk of the first `docs` documents that they found, with score 0.5."""
    own = chunks.select("chunk_id", "doc_id", "chunk_index", "vault_id")
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    found = first_of(both, ["query_id", "chunk_id"], [F.col("source"), F.col("rank")])
    documents = first_of(found.join(own, "chunk_id"), ["query_id", "doc_id"], [F.col("source"), F.col("rank")])
    documents = documents.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "rank"))).where(F.col("_n") <= docs)
    more = documents.select("query_id", "doc_id", F.col("_n")).join(live(chunks).select("chunk_id", "doc_id", "chunk_index"), "doc_id")
    more = more.select("query_id", "chunk_id", F.lit(0.5).alias("score"), (F.col("_n") * 100_000 + F.col("chunk_index")).alias("rank"), F.lit(2).alias("source"))
    once = first_of(found.select("query_id", "chunk_id", "score", "rank", "source").unionByName(more), ["query_id", "chunk_id"], [F.col("source"), F.col("rank")])
    order = Window.partitionBy("query_id").orderBy("source", "rank", "chunk_id")
    return once.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "chunk_id", "score", "rank")


def context(results: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, context): the first `most` chunks under numbered headers."""
    # Written, the few results are known to be few and are sent to the texts, which then aren't shuffled.
    rows = written(results.where(F.col("rank") < most), "results").join(chunks.select("chunk_id", "content_with_header"), "chunk_id")
    part = F.concat(F.lit("--- Document Chunk "), (F.col("rank") + 1).cast("string"), F.lit(" (relevance: "), F.format_string("%.3f", F.round("score", 3)), F.lit(") ---\n"), F.col("content_with_header"), F.lit("\n"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n").alias("context"))


def full_document(titles: DataFrame, documents: DataFrame, chunks: DataFrame, most: int = 30_000) -> DataFrame:
    """(title, doc_id, content) of the first document whose name holds the title, its chunks in order."""
    named = documents.select("doc_id", "original_filename")
    hit = containing(named, "original_filename", titles, "title", []).withColumnRenamed("_needle", "title")
    first = first_of(hit, ["title"], [F.col("original_filename"), F.col("doc_id")])
    parts = first.join(chunks.where("not is_deleted").select("doc_id", "chunk_index", "chunk_id", "content"), "doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))), lambda x: x["content"]), "\n\n")
    whole = F.concat(F.lit("Document: "), F.col("original_filename"), F.lit("\n"), F.col("text"))
    return parts.groupBy("title", "doc_id", "original_filename").agg(text.alias("text")).select("title", "doc_id", T.truncate(whole, most, "\n[truncated]").alias("content"))


# The forms in which tool outputs name their sources.
SOURCE_TAG, CHUNK_HEAD = r"\[Source:\s*(.+?)\]", r"--- Document Chunk \d+[^\n]*?---\n"
FULL_DOCUMENT, FILTER_LINE = r"=== FULL DOCUMENT:\s*(.+?)\s*===", r"(?m)^\d+\.[ \t]+(\S[^\n]*)$"
FULL_QUOTE = "Full document retrieved."


def _stripped(text: Column) -> Column:
    """The text without the spaces of all kinds around it."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def citations(outputs: DataFrame) -> DataFrame:
    """(output_id, position, title, quote) of the sources that tool outputs (output_id, tool, text) name, the first mention of each title.

    Searches and lookups have chunk blocks with a source tag, quoted by the first line after it that isn't blank; filters
    have numbered lines, `title — details`, quoted by their details; a full document has its title in a banner. Quotes
    have up to 300 characters. Other tools cite nothing.
    """
    rows = outputs.where(F.col("text").isNotNull())
    blocks = rows.where(F.col("tool").isin("search_documents", "lookup_entity")).withColumn("_blocks", F.split("text", CHUNK_HEAD))
    block = blocks.select("output_id", F.posexplode(F.expr("slice(_blocks, 2, size(_blocks))")).alias("position", "block"))
    tag = F.regexp_extract("block", SOURCE_TAG, 0)
    body = F.expr("substring(block, locate(_tag, block) + length(_tag))")
    line = F.try_element_at(F.filter(F.transform(F.split(body, "\n"), _stripped), lambda x: x != ""), F.lit(1))
    searched = block.withColumn("_tag", tag).where("_tag <> ''").select("output_id", "position", _stripped(F.regexp_extract("block", SOURCE_TAG, 1)).alias("title"), F.coalesce(line, F.lit("")).alias("quote"))
    listed = rows.where("tool = 'filter_documents'").select("output_id", F.posexplode(F.regexp_extract_all("text", F.lit(FILTER_LINE), 1)).alias("position", "line"))
    listed = listed.select("output_id", "position", F.trim(F.substring_index("line", " — ", 1)).alias("title"), F.when(F.contains("line", F.lit(" — ")), F.trim(F.expr("substring(line, locate(' — ', line) + 3)"))).otherwise("").alias("quote"))
    whole = rows.where("tool = 'get_full_document'").select("output_id", F.lit(0).alias("position"), F.regexp_extract("text", FULL_DOCUMENT, 1).alias("title"), F.lit(FULL_QUOTE).alias("quote")).where("title <> ''")
    every = searched.unionByName(listed).unionByName(whole).withColumn("quote", F.substring("quote", 1, 300))
    return first_of(every, ["output_id", "title"], [F.col("position")])
