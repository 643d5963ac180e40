"""Logistic regression on TF-IDF vectors whose weights, one a term, are gathered nowhere.

With an L2 penalty the best weights are a sum of the training rows' vectors, X'a, so a fit needs one
number a row and class instead of one a term, and of the vectors only the product v -> X X'v. The terms are
dealt to blocks of columns; a task multiplies by its blocks, and the products are added by Spark. The driver
holds a few numbers for every row, and no task holds more of the vocabulary than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.sources.shared import written

#: Entries that are put into one block, numbers that a product's pieces hold, and bytes of columns that are multiplied at once.
BLOCK, PIECE, AT_ONCE = 1 << 21, 1 << 17, 1 << 26
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Ranges of hashes that terms are dealt by, entries of the longest run, and bytes that are added at a time.
BUCKETS, LONG, NEAR = 1 << 12, 256, 1 << 19


def placed_texts(rows: DataFrame, text: str) -> tuple[DataFrame, int]:
    """((digest, text, row), how many): the distinct texts, numbered from 0 without gaps; null counts as empty."""
    own = rows.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    stored = written(own.groupBy("digest").agg(F.first("text").alias("text")).withColumn("id", F.monotonically_increasing_id()), "texts")
    part = F.shiftright("id", 33)
    # One row a task that wrote.
    counts = sorted(tuple(r) for r in stored.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "part long, before long")
    placed = stored.join(F.broadcast(starts), part == F.col("part"))
    return placed.select("digest", "text", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).cast("int").alias("row")), before[-1]


class Products:
    """X X'v by columns, for unit TF-IDF vectors X of ``size`` texts under the document frequencies of several groups.

    ``counts`` has (row, term, n): how often a text has a term. ``trained`` has for each group how many
    training rows hold each text. Terms in fewer than ``least_docs`` of these are left out.
    Terms meet by hashes of 128 bits. A block has its terms' entries cut into runs of one term and one count, so
    that only sums are needed along a run, and the same entries once more by text.
    """

    def __init__(self, counts: DataFrame, trained: np.ndarray, least_docs: int):
        self.size = trained.shape[1]
        spark = counts.sparkSession
        given, total = spark.sparkContext.broadcast(trained), trained.sum(1)
        # As many tasks multiply as there are cores, since each passes on a number a row and column.
        self.tasks = spark.sparkContext.defaultParallelism
        # Blocks are the better the more entries of a text they hold.
        parts = max(self.tasks, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        entries = counts.select(F.col("row").cast("int"), F.xxhash64("term").alias("a"), F.xxhash64(F.lit(1), "term").alias("b"), F.col("n").cast("int"))
        dealt = entries.mapInArrow(_dealt, "bucket int, row binary, a binary, b binary, n binary").repartition(parts, "bucket").sortWithinPartitions("bucket")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, a, b, n in _whole_terms(batches):
                if block := _block(row, a, b, n, given.value, total, least_docs):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], FIELDS)

        self.blocks = written(dealt.mapInArrow(blocks, ", ".join(f"{x} binary" for x in FIELDS)), "term-blocks")
        given.destroy()
        self.groups = len(trained)
        self.norms = np.sqrt(self._summed(lambda b: [np.append(b.tf**2 * idf[b.term], 0.0) for idf in (b.idf**2).T], self.groups))
        self.norms[self.norms == 0] = 1.0

    def _summed(self, work: Callable, columns: int) -> np.ndarray:
        """(columns, size): the values that ``work`` makes of each block's runs, added by text over the entries; the last of them is a zero, which gaps point to."""
        size, groups = self.size, self.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    block = _Block(*(batch.column(f)[k].as_buffer() for f in FIELDS), groups)
                    total = np.zeros((columns, size)) if total is None else total
                    # One column at a time stays in the cache.
                    for j, values in enumerate(work(block)):
                        total[j][block.texts] += _sums(values, block.by_text, block.text_shapes)
            if total is not None:
                flat = total.ravel()
                for at in range(0, len(flat), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], ["at", "piece"])

        def added(pieces: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in pieces["piece"])
            return pa.table({"at": pa.array([pieces["at"][0].as_py()], pa.int64()), "piece": pa.array([total.tobytes()], pa.binary())})

        out, conf = np.zeros(columns * size), self.blocks.sparkSession.conf
        before = conf.get(BATCH, None)
        # A block at a time is handed to Python.
        conf.set(BATCH, str(1 << 20))
        try:
            pieces = self.blocks.coalesce(self.tasks).mapInArrow(run, "at long, piece binary")
            # What is small is added by the driver, which saves a stage.
            pieces = (pieces if 8 * len(out) * self.tasks <= AT_ONCE else pieces.groupBy("at").applyInArrow(added, "at long, piece binary")).collect()
        finally:
            conf.unset(BATCH) if before is None else conf.set(BATCH, before)
        for at, piece in pieces:
            found = np.frombuffer(piece, "<f8")
            out[at : at + len(found)] += found
        return out.reshape(columns, size)

    def __call__(self, given: np.ndarray, groups: list[int]) -> np.ndarray:
        """X X'v of every row v of ``given`` (columns, size), each under its group's frequencies."""
        scale = self.norms[groups]
        # The last number, a zero, is what gaps in the runs point to.
        sent = self.blocks.sparkSession.sparkContext.broadcast(np.concatenate([given / scale, np.zeros((len(groups), 1))], axis=1))

        def work(block: _Block) -> Iterator[np.ndarray]:
            squares = block.idf**2
            for g, v in zip(groups, sent.value):
                # Runs lie by length; those of a term are brought together to be added.
                terms = np.add.reduceat((_sums(v, block.by_run, block.run_shapes) * block.tf)[block.order], block.starts) * squares[:, g]
                yield np.append(terms[block.term] * block.tf, 0.0)

        found = self._summed(work, len(groups)) / scale
        sent.destroy()
        return found


FIELDS = ["by_run", "run_shapes", "tf", "order", "starts", "idf", "by_text", "text_shapes", "texts"]


class _Block:
    """A block's entries by run, as ``_laid`` has them, and by text; ``term`` is the term of each run."""

    def __init__(self, by_run, run_shapes, tf, order, starts, idf, by_text, text_shapes, texts, groups: int):
        self.by_run, self.order, self.starts, self.by_text, self.texts = (np.frombuffer(x, "<i4") for x in (by_run, order, starts, by_text, texts))
        self.run_shapes, self.text_shapes = (np.frombuffer(x, "<i8").reshape(-1, 2).tolist() for x in (run_shapes, text_shapes))
        self.tf, self.idf = np.frombuffer(tf, "<f8"), np.frombuffer(idf, "<f8").reshape(-1, groups)
        self.term = np.empty(len(self.tf), "int64")
        self.term[self.order] = np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=len(self.tf)))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's entries by ``BUCKETS`` ranges of the first hash, some hundred thousand entries at a time."""

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, a, b, n = (np.concatenate(x) for x in zip(*held))
        bucket = (a >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype("uint16")
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=BUCKETS))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        cuts = np.concatenate([[0], ends[some]])
        columns = [pa.array(some.astype("int32"))]
        for x in (row, a, b, n):
            columns.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((cuts * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x[order].tobytes())]))
        return pa.RecordBatch.from_arrays(columns, ["bucket", "row", "a", "b", "n"])

    held, many = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy().astype(kind) for c, kind in zip(("row", "a", "b", "n"), ("<i4", "<u8", "<u8", "<i4"))])
        many += batch.num_rows
        if many >= BLOCK:
            yield packed(held)
            held, many = [], 0
    if many:
        yield packed(held)


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (row, a, b, n) of whole buckets, ``BLOCK`` of them or more but for the last."""
    held, many, last = [], 0, None
    for batch in batches:
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != last and many >= BLOCK:
                yield tuple(np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), ("<i4", "<u8", "<u8", "<i4")))
                held, many = [], 0
            held.append([batch.column(c)[k].as_py() for c in ("row", "a", "b", "n")])
            many, last = many + len(held[-1][0]) // 4, bucket
    if many:
        yield tuple(np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), ("<i4", "<u8", "<u8", "<i4")))


def _block(row, a, b, n, trained: np.ndarray, total: np.ndarray, least_docs: int) -> list[np.ndarray] | None:
    """The ``FIELDS`` of a block of entries, or None where no term is in enough training rows."""
    order = np.lexsort((n, b, a))
    row, a, b, n = row[order], a[order], b[order], n[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    starts = np.flatnonzero(new)
    df = np.stack([np.add.reduceat(w[row], starts) for w in trained])
    idf = np.where(df >= least_docs, np.log((1 + total[:, None]) / (1 + df)) + 1, 0.0)
    kept = idf.any(0)
    if not kept.any():
        return None
    own = np.repeat(kept, np.diff(starts, append=len(row)))
    row, n, new, idf = row[own], n[own], new[own], idf[:, kept]
    # A run is of one term and one count, and of LONG entries at most.
    run = new | np.concatenate([[True], n[1:] != n[:-1]])
    begins = np.flatnonzero(run)
    run[begins.repeat(sizes := -(-np.diff(begins, append=len(run)) // LONG)) + LONG * (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))] = True
    begins = np.flatnonzero(run)
    by_run, run_shapes, runs = _laid(row, begins, len(trained[0]))
    place = np.empty(len(runs), "<i4")
    place[runs] = np.arange(len(runs))
    entry = np.repeat(place, np.diff(begins, append=len(row)))
    order = np.argsort(row, kind="stable")
    row, entry = row[order], entry[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    by_text, text_shapes, texts = _laid(entry, first, len(runs))
    tf = 1 + np.log(n[begins[runs]])
    return [by_run, run_shapes, tf.astype("<f8"), place, np.searchsorted(begins, np.flatnonzero(new)).astype("<i4"), np.ascontiguousarray(idf.T).astype("<f8"), by_text, text_shapes, row[first[texts]].astype("<i4")]


def _laid(values: np.ndarray, begins: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, shapes, order): runs of ``values`` by length, padded with ``gap`` to the next of few lengths.

    Of every shape (length, runs) the first values of all runs come first, then the second ones, and so on.
    """
    sizes = np.diff(begins, append=len(values))
    # Lengths of three significant bits.
    unit = 1 << np.maximum(np.frexp(sizes)[1] - 3, 0)
    sizes, padded = sizes.astype("int64"), (-(-sizes // unit) * unit).astype("int64")
    order = np.argsort(padded, kind="stable")
    lengths, first = np.unique(padded[order], return_index=True)
    flat, shapes = [], []
    for length, own in zip(lengths.tolist(), np.split(order, first[1:])):
        # A few million values at a time.
        step = max(1, BLOCK // length)
        for own in np.split(own, range(step, len(own), step)):
            at = np.arange(length)[:, None]
            found = values[np.minimum(begins[own] + at, len(values) - 1)]
            flat.append(np.where(at < sizes[own], found, gap).astype("<i4").ravel())
            shapes.append((length, len(own)))
    return np.concatenate(flat), np.array(shapes, "<i8"), order


def _sums(given: np.ndarray, flat: np.ndarray, shapes: list[list[int]]) -> np.ndarray:
    """For each run the sum of the numbers of ``given`` that it names."""
    at, done, out = 0, 0, np.empty(sum(runs for _, runs in shapes))
    for length, runs in shapes:
        named = flat[at : at + length * runs].reshape(length, runs)
        step = max(1, NEAR // (8 * length))
        for k in range(0, runs, step):
            some = named[:, k : k + step]
            out[done + k : done + k + some.shape[1]] = given.take(some, mode="clip").sum(axis=0)
        at, done = at + length * runs, done + runs
    return out


def descent(labels: np.ndarray, classes: int, weights: np.ndarray, memory: int = 30, most: int = 200, tol: float = 1e-9) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Coroutine of L-BFGS: yields (outputs, rows), is sent the product of X X' with it, and returns (a, intercepts).

    The mean loss of ``labels``, each of which counts as often as ``weights`` say, plus half the squared coefficients over
    the number of rows. A vector of coefficients X'a is kept as a with its margins X X'a, so inner products and steps along
    a line need no further product. Past steps are kept in single precision.
    Two classes have one output, more have one each.
    """
    n, outputs = float(weights.sum()), 1 if classes <= 2 else classes
    if not n:
        raise ValueError("no labelled training rows")
    hot = np.stack([labels == k for k in (range(outputs) if outputs > 1 else [1])]).astype(float)
    share = np.clip(hot @ weights / n, 1e-12, 1 - 1e-12)
    zero = np.zeros((outputs, len(labels)))
    at = [zero, zero, (np.log(share) if outputs > 1 else np.log(share / (1 - share)))]
    dot = lambda x, y: float(np.vdot(x[0], y[1]) + x[2] @ y[2])
    plus = lambda x, t, y: [p + t * q for p, q in zip(x, y)]

    def seen(x) -> tuple[float, np.ndarray]:
        z = x[1] + x[2][:, None]
        top = np.maximum(z.max(0), 0) if outputs == 1 else z.max(0)
        e = np.exp(z - top)
        total = e.sum(0) + (np.exp(-top) if outputs == 1 else 0)
        return float(weights @ (np.log(total) + top - (hot * z).sum(0)) + np.vdot(x[0], x[1]) / 2) / n, (e / total - hot) * weights

    def slope(x, d) -> float:
        return float((seen(x)[1] * (d[1] + d[2][:, None])).sum() + np.vdot(x[0], d[1])) / n

    value, residual = seen(at)
    pairs, old = [], None
    for _ in range(most):
        a = (residual + at[0]) / n
        g = [a, (yield a), residual.sum(1) / n]
        if old is not None:
            y = [q.astype("float32") for q in plus(g, -1.0, old)]
            if (bend := dot(pairs[-1][0], y)) > 1e-300:
                pairs[-1] = (pairs[-1][0], y, bend)
            else:
                pairs.pop()
            del pairs[:-memory]
        d, taken = [-x for x in g], []
        for s, y, bend in reversed(pairs):
            taken.append(dot(s, d) / bend)
            d = plus(d, -taken[-1], y)
        if pairs:
            d = [x * (pairs[-1][2] / dot(pairs[-1][1], pairs[-1][1])) for x in d]
        for (s, y, bend), t in zip(pairs, reversed(taken)):
            d = plus(d, t - dot(y, d) / bend, s)
        first = dot(g, d)
        if first >= -1e-18:
            break
        # The loss is convex along the line: double the step until the slope turns, then close in on its root.
        low, high, f_low = 0.0, 1.0, first
        while (f_high := slope(plus(at, high, d), d)) < 0 and high < 1e6:
            low, f_low, high = high, f_high, high * 2
        step, f = high, f_high
        for _ in range(30):
            if abs(f) <= 0.02 * abs(first) or f_high < 0:
                break
            step = low + (high - low) * min(0.9, max(0.1, -f_low / (f_high - f_low)))
            if (f := slope(plus(at, step, d), d)) > 0:
                high, f_high = step, f
            else:
                low, f_low = step, f
        pairs.append(([(step * x).astype("float32") for x in d], None, 0.0))
        at, old = plus(at, step, d), g
        before, (value, residual) = value, seen(at)
        if before - value <= tol * max(abs(value), 1e-12):
            break
    return at[0], at[2]


def fitted(problems: list[tuple[int, np.ndarray, np.ndarray, int]], products: Callable[[np.ndarray, list[int]], np.ndarray], size: int) -> list[np.ndarray]:
    """Margins (outputs, size) of each problem (group, row of each training example, its label, classes) on all texts.

    Problems go on in step: what all of them ask for is one product, as far as ``AT_ONCE`` allows.
    """
    out: list[np.ndarray] = [None] * len(problems)
    widths = [8 * size * (1 if p[3] <= 2 else p[3]) for p in problems]
    at_once = max(1, AT_ONCE // max(widths, default=1))
    spread = lambda rows, a: np.stack([np.bincount(rows, weights=x, minlength=size) for x in a])
    # The outputs of several classes add up to zero, so that the last one follows from the others.
    asked_for = lambda a: a[: max(1, len(a) - 1)]
    for begin in range(0, len(problems), at_once):
        own = range(begin, min(begin + at_once, len(problems)))
        memory = int(min(30, max(3, 4 * AT_ONCE // (2 * sum(widths[i] for i in own) or 1))))
        rows, runs = {}, {}
        for i in own:
            _, row, labels, classes = problems[i]
            kinds, weights = np.unique(row.astype("int64") * classes + labels, return_counts=True)
            rows[i], runs[i] = kinds // classes, descent(kinds % classes, classes, weights.astype(float), memory)
        with ThreadPoolExecutor(len(own)) as threads:
            asked, done = dict(zip(runs, threads.map(next, runs.values()))), {}
            while asked or done:
                wanted = [*asked.items(), *((i, a) for i, (a, _) in done.items())]
                found = products(np.concatenate([spread(rows[i], asked_for(a)) for i, a in wanted]), [problems[i][0] for i, a in wanted for _ in asked_for(a)])
                parts, at, finished, sent = {}, 0, done, {}
                for i, a in wanted:
                    part, at = found[at : at + len(asked_for(a))], at + len(asked_for(a))
                    parts[i] = part if len(a) == 1 else np.concatenate([part, -part.sum(0, keepdims=True)])
                    if i in finished:
                        out[i] = parts[i] + finished[i][1][:, None]
                    else:
                        sent[i] = threads.submit(_next, runs[i], parts[i][:, rows[i]])
                asked, done = {}, {}
                for i, later in sent.items():
                    ended, value = later.result()
                    (done if ended else asked)[i] = value
    return out


def _next(run: Generator, value: np.ndarray) -> tuple[bool, object]:
    """(False, what ``run`` asks for next) or (True, what it returns)."""
    try:
        return False, run.send(value)
    except StopIteration as end:
        return True, end.value
