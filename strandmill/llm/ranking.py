"""Ranked lexical search over a forward index in blocks, with block-max pruning.

``build_index`` writes one row per block: a range of at most ``BLOCK_DOCS`` documents of one task, in
order of length within a run so that their scores have similar bounds. A block holds its documents'
ids and length factors, its terms with the number of documents that hold them and the largest part of a
score that they can give there (the per-term maxima), and term by term the documents and occurrences.

``rank`` takes queries in slices of bounded size; only a slice's terms and weights are broadcast. Per
slice, blocks are sorted by their bound (the sum of weighted maxima); each query's ``probe`` best blocks
are scored, which gives it a threshold: the score of its k-th best document so far. Then every task
goes through its blocks and scores those whose bound still reaches the threshold, which rises with what
the task finds. A block is left out only if its bound is below the threshold, so ties are kept, and
results equal those of scoring everything. A task passes on k rows a query at most.

A task's memory is that of a few blocks, however many it reads: a row of the index holds bytes, not lists
of terms; its row groups and the batches that pass between Spark and Python are of a few MB each; and a
block is scored for as many queries at a time as fit ``MEETINGS``.

Weights are computed in doubles, everything else in 64-bit integers; sums stay below 2^53, where
doubles are exact.

Defined results: null and empty texts, and those without terms, are no documents; null and empty
queries have no rows; repeated rows and repeated items are ranked each; equal scores go by ascending
id, null ids last; texts of any length are read whole, a long one may fill a block alone; an empty table
on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.sources.shared import written
from strandmill.streaming.state import settings

#: Fixed value: bytes that separate terms (ASCII but for digits and letters); A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Limits of a block, of the run of documents ordered by length before it is cut into blocks, and of a slice of queries.
BLOCK_DOCS, BLOCK_POSTINGS, RUN_POSTINGS = 64, 1 << 16, 1 << 18
SLICE_QUERIES, SLICE_ENTRIES = 1024, 1 << 18
PROBE = 16
#: Columns of the index that hold packed numbers.
PACKED = ("dfs", "factors", "maxima", "docs", "tfs")
#: How many pairs of a query's term and a document a block is scored for at once; a single query may have more.
MEETINGS = 1 << 18
#: Row groups of the index; as its rows are long, their size is checked every few of them.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 8}
#: Spark hands a task's rows to Python in batches of this size; by itself it takes 64 MB, and up to twice that while a batch grows, on every core.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text, with repeats."""
    return (text or b"").translate(TERM_BYTES).split()


def part_of_score(tf, m):
    """What one term adds to a score before its weight is applied."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _slices(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), size):
        yield batch.slice(at, size)


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms) for a column of UTF-8 texts."""

    def count(batches):
        for batch in batches:
            sizes = np.array([len(terms_of(x)) for part in _slices(batch) for x in part.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"n": [int((sizes > 0).sum())], "l": [int(sizes.sum())]}, schema=pa.schema([("n", pa.int64()), ("l", pa.int64())]))

    total = texts.mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return total.n or 0, total.l or 0


def block_of(ids: list, factors: np.ndarray, counts: list[Counter]) -> dict:
    """One index row of documents with length factors ``factors`` and term counts ``counts``."""
    terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    of = terms.indices.to_numpy()
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(of))
    order = np.argsort(of, kind="stable")
    doc, tf, df = doc[order], tf[order], np.bincount(of)
    starts = np.cumsum(df) - df
    return {"ids": ids, "factors": factors, "terms": terms.dictionary, "dfs": df, "maxima": np.maximum.reduceat(part_of_score(tf, factors[doc]), starts), "docs": doc, "tfs": tf}


def packed(values: np.ndarray) -> bytes:
    """Numbers of 1, 2, 4 or 8 bytes each, as few as the largest needs; the first byte tells how many."""
    most = int(values.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def build_index(docs: DataFrame, documents: int, all_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: (block, ids, terms, dfs, factors, maxima, docs, tfs); ``terms`` are joined by spaces, which no term holds, and the last five are packed numbers: Spark passes these on as they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType
    fields = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(n, T.BinaryType()) for n in ("terms", *PACKED))])

    def build(batches):
        number, held, postings = TaskContext.get().partitionId() << 36, [], 0

        def blocks():
            nonlocal number, held, postings
            held.sort(key=lambda d: d[1])
            at = 0
            while at < len(held):
                end, size = at, 0
                while end < len(held) and end - at < BLOCK_DOCS and (end == at or size + len(held[end][2]) <= BLOCK_POSTINGS):
                    size, end = size + len(held[end][2]), end + 1
                run = held[at:end]
                own = block_of([d[0] for d in run], np.array([100 - 50 + 50 * d[1] * documents // all_terms for d in run], dtype=np.int64), [d[2] for d in run])
                cells = [b" ".join(own["terms"].to_pylist()), *(packed(own[n]) for n in PACKED)]
                columns = [pa.array([number], pa.int64()), pa.array([own["ids"]], pa.list_(id_kind)), *(pa.array([x], pa.binary()) for x in cells)]
                yield pa.RecordBatch.from_arrays(columns, names=fields.names)
                number, at = number + 1, end
            held, postings = [], 0

        for batch in batches:
            id_kind = batch.column(0).type
            for part in _slices(batch):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if found := terms_of(text):
                        held.append((i, len(found), Counter(found)))
                        postings += len(held[-1][2])
                    if postings >= RUN_POSTINGS:
                        yield from blocks()
        if held:
            yield from blocks()

    return written(rows.mapInArrow(build, fields), "block-index", **ROW_GROUPS)


class Slice:
    """Queries of one slice: for every term the queries that hold it and its weight there."""

    def __init__(self, queries: list[tuple[object, set[bytes]]], documents: int, dfs: dict[bytes, int]):
        self.items = [item for item, _ in queries]
        entries: dict[bytes, list[int]] = {}
        for q, (_, terms) in enumerate(queries):
            for term in terms & dfs.keys():
                entries.setdefault(term, []).append(q)
        self.queries = {t: np.array(q, dtype=np.int64) for t, q in entries.items()}
        known = list(entries)
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * np.array([dfs[t] for t in known], dtype=np.int64) + 1)))
        self.weights = dict(zip(known, weights.tolist()))

    def matches(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``terms``, query, weight) of all queries' terms that are among ``terms``."""
        places = [i for i, t in enumerate(terms) if t in self.queries]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        queries = [self.queries[terms[i]] for i in places]
        sizes = [len(q) for q in queries]
        return np.repeat(places, sizes), np.concatenate(queries), np.repeat([self.weights[terms[i]] for i in places], sizes)

    def bounds(self, match, maxima: np.ndarray) -> np.ndarray:
        """Per query, what no document of a block with ``maxima`` exceeds."""
        place, query, weight = match
        return np.bincount(query, weight * maxima[place], len(self.items)).astype(float)


class Best:
    """The k best (score, id) of each query that one task has met, and each query's threshold."""

    def __init__(self, k: int, thresholds: np.ndarray):
        self.k, self.thresholds, self.rows = k, thresholds.copy(), {}

    def take(self, query: int, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero((scores > 0) & (scores >= self.thresholds[query]))
        if not len(at):
            return
        rows = self.rows.get(query, []) + [(-int(scores[i]), ids[i] is None, ids[i] if ids[i] is not None else 0) for i in at]
        rows.sort()
        del rows[self.k :]
        self.rows[query] = rows
        if len(rows) == self.k:
            self.thresholds[query] = max(self.thresholds[query], -rows[-1][0])


def score_block(own: Slice, match, reached: np.ndarray, row: dict, best: Best) -> None:
    """Score all documents of an index row for the queries ``reached``, as many at a time as have ``MEETINGS`` of their terms with a document."""
    place, query, weight = match
    dfs, docs = row["dfs"].astype(np.int64), row["docs"]
    parts = part_of_score(row["tfs"], row["factors"][docs])
    firsts, n = np.cumsum(dfs) - dfs, len(row["factors"])
    wanted = np.flatnonzero(reached)
    ends = np.cumsum(np.bincount(query, dfs[place], len(reached))[wanted].astype(np.int64))
    low = 0
    while low < len(wanted):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEETINGS, "right")))
        rank = np.full(len(reached), -1)
        rank[wanted[low:high]] = np.arange(high - low)
        take = rank[query] >= 0
        own_place, own_rank, own_weight = place[take], rank[query[take]], weight[take]
        starts, sizes = firsts[own_place], dfs[own_place]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        scores = np.bincount(np.repeat(own_rank, sizes) * n + docs[at], np.repeat(own_weight, sizes) * parts[at], (high - low) * n).reshape(high - low, n)
        for q, found in zip(wanted[low:high].tolist(), scores):
            best.take(q, found, row["ids"])
        low = high


def _index_rows(batches):
    for batch in batches:
        names = batch.schema.names
        for i in range(len(batch)):
            cells = {n: batch.column(j)[i] for j, n in enumerate(names)}
            yield {n: unpacked(c.as_py()) if n in PACKED else c.as_py().split(b" ") if n == "terms" else c.as_py() for n, c in cells.items()}


def _best_batch(best: Best, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(q, None if null else i, -score) for q, found in best.rows.items() for score, null, i in found]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scored(index: DataFrame, shared, k: int, thresholds: np.ndarray, id_field: T.StructField) -> DataFrame:
    """(query, id, score) with each task's k best rows a query; ``index`` may have a column ``queries`` that says which queries a block is scored for, else bounds and thresholds decide."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", id_field.dataType), T.StructField("score", T.LongType())])
    schema = to_arrow_schema(fields)

    def score(batches):
        own, best = shared.value, Best(k, thresholds)
        for row in _index_rows(batches):
            match = own.matches(row["terms"])
            if "queries" in row:
                reached = np.zeros(len(own.items), bool)
                reached[row["queries"]] = True
            else:
                bounds = own.bounds(match, row["maxima"])
                reached = (bounds > 0) & (bounds >= best.thresholds)
            if reached.any():
                score_block(own, match, reached, row, best)
        yield _best_batch(best, schema)

    return index.mapInArrow(score, fields)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query_slices(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, set[bytes]]]]:
    """Lists of (item, terms), each with at most ``SLICE_QUERIES`` items and, but for a single longer one, ``SLICE_ENTRIES`` terms; items without terms are left out."""
    held, entries = [], 0
    for row in items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        if not (terms := set(terms_of(bytes(row.text) if row.text is not None else None))):
            continue
        if held and (len(held) == SLICE_QUERIES or entries + len(terms) > SLICE_ENTRIES):
            yield held
            held, entries = [], 0
        held.append((row.item, terms))
        entries += len(terms)
    if held:
        yield held


def document_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents of the index each of ``terms`` occurs; those without one are left out."""
    asked = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        own, found = asked.value, Counter()
        for row in _index_rows(batches):
            for term, n in zip(row["terms"], row["dfs"].tolist()):
                if term in own:
                    found[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return {bytes(r.term): r.df for r in index.select("terms", "dfs").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def rank_slice(index: DataFrame, queries: list[tuple[object, set[bytes]]], documents: int, k: int, probe: int, id_field: T.StructField) -> tuple[DataFrame, Slice]:
    """(query, id, score, rank) of one slice."""
    spark = index.sparkSession
    own = Slice(queries, documents, document_counts(index, {t for _, own in queries for t in own}))
    shared = spark.sparkContext.broadcast(own)

    def bound(batches):
        mine = shared.value
        for row in _index_rows(batches):
            bounds = mine.bounds(mine.matches(row["terms"]), row["maxima"])
            q = np.flatnonzero(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([row["block"]] * len(q), pa.int64()), pa.array(bounds[q], pa.float64())], names=["query", "block", "bound"])

    bounds = index.select("block", "terms", "maxima").mapInArrow(bound, "query int, block long, bound double")
    first = Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")
    probed = bounds.withColumn("place", F.row_number().over(first)).where(F.col("place") <= probe).groupBy("block").agg(F.collect_list("query").alias("queries"))
    # at most ``probe`` blocks a query of a slice
    found = _top(_scored(index.join(F.broadcast(probed), "block"), shared, k, np.zeros(len(queries)), id_field), k)
    thresholds = np.zeros(len(queries))
    for r in found.where(F.col("rank") == k).select("query", "score").collect():
        thresholds[r["query"]] = r["score"]
    return _top(_scored(index, shared, k, thresholds, id_field), k), own


def rank(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", probe: int = PROBE) -> DataFrame:
    """(item, rank, id, score): the k best documents of every item with a score above 0."""
    with settings(docs.sparkSession, BATCHES):
        return _rank(docs, items, k, item_col, id_col, text_col, item_text_col, probe)


def _rank(docs: DataFrame, items: DataFrame, k: int, item_col: str, id_col: str, text_col: str, item_text_col: str, probe: int) -> DataFrame:
    documents, all_terms = corpus_size(docs.select(F.col(text_col).cast("binary")))
    id_field, item_field = docs.select(F.col(id_col).alias("id")).schema["id"], items.select(F.col(item_col).alias("item")).schema["item"]
    fields = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", item_field.dataType)])
    spark, parts = docs.sparkSession, None
    if documents:
        index = build_index(docs, documents, all_terms, id_col, text_col)
        for queries in query_slices(items, item_col, item_text_col):
            found, own = rank_slice(index, queries, documents, k, probe, id_field)
            names = spark.createDataFrame(list(enumerate(own.items)), fields)
            part = written(found.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"), "ranked")
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], T.StructType([T.StructField(item_col, item_field.dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_field.dataType), T.StructField("score", T.LongType())]))
    return parts
