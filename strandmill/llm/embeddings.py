"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Equal vectors collapse first. Unit vectors are projected on seeded Gaussian directions. Two vectors
at cosine ``least`` are ``r = sqrt(2 - 2 * least)`` apart, so a projection moves them apart by a
normal deviate of scale r, and a window of ``WINDOW`` such scales to both sides of a query's
projection holds its partner with known probability.

* Vectors of one label are sorted by a projection and cut at the median into two runs that overlap by
  one window, so that a pair whose windows collide at the cut stays together; each run is sorted by
  the next projection, and so on, until runs are short or all lie within one window. The upper cuts
  are made before vectors are dealt to tasks, at medians of a bounded sample of ``SAMPLE`` vectors,
  and only where a label has more than ``RUN`` vectors; the others are made inside the tasks. A vector
  is therefore stored once, plus once for every upper cut it lies close to, about a fifth each.
* Within a run, the first of ``COUNTED`` more projections is sorted, and the rows in each query's
  window are counted over the windows of all of them. Pairs that share a count calibrated from the
  binomial law (it loses at most ``1 - RECALL`` of the pairs at exactly the limit) are verified with
  their cosine in double precision.

A pair may meet in several runs. It counts in the leftmost: each row notes at which cuts it went both
ways, and a pair that went both ways together is left to the left run. So links are counted per vector
without shipping pairs. Runs longer than ``RUN`` (crowded places, which no cut divides) are split into
blocks, and every two blocks are a task of bounded size. No run, block or candidate is capped.

A pair is lost where a cut falls between it and it lies more than a window apart in that projection:
at most one in a hundred pairs at exactly the limit per cut, far fewer of the closer ones.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing; so do vectors of different lengths. Repeated rows link
with each other. A null id is ignored when the smallest id of a component is chosen, and a row of a
component without ids has none. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.graph import components, join_unique
from strandmill.sources.shared import written

#: Half a window, in units of r.
WINDOW = 2.5
COUNTED = 16
RECALL = 0.995
#: Most vectors of a run or block that a task gets, about, and length from which tasks cut runs on.
RUN = 1 << 13
SHORT = 512
SAMPLE = 1 << 16
#: Directions to sort by: at most this many cuts above the tasks, and in them.
UPPER, LOWER = 12, 16


def least_collisions(recall: float = RECALL) -> int:
    """Windows a pair at the limit shares with at least chance ``recall``."""
    p, total = math.erf(WINDOW / math.sqrt(2)), 0.0
    for n in range(COUNTED, 0, -1):
        total += math.comb(COUNTED, n) * p**n * (1 - p) ** (COUNTED - n)
        if total >= recall:
            return n
    return 1


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(label: str = "label", vector: str = "vector"):
    """Whether a row can link."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(sound & (F.coalesce(norm, F.lit(0.0)) > 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Stored (label, h1, h2, node, vector, copies, least_id) of the vectors of ``rows`` (id, label, vector, h1, h2): one row per label and 128-bit hash."""
    merged = rows.groupBy("label", "h1", "h2").agg(F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least_id"))
    return written(merged.withColumn("node", F.monotonically_increasing_id()), "vectors")


def upper_cuts(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """Cut values of a heap-ordered tree (index 1 is the root), from a bounded sample; of size 1 where no label exceeds ``RUN``."""
    depth = min(UPPER, max(0, math.ceil(math.log2(max(1, most) / RUN))))
    if not depth:
        return np.zeros(1)
    total = vectors.count()
    share = min(1.0, SAMPLE / total)
    sample = vectors.where(F.pmod(F.xxhash64("node", F.lit(19)), F.lit(1_000_003)) < int(1_000_003 * share)).select("vector").toArrow().column("vector").combine_chunks()
    lengths = np.diff(sample.offsets.to_numpy())
    places = np.concatenate([_unit(_matrix(sample.filter(pa.array(lengths == d)), int(d))) @ directions(int(d), UPPER, seed) for d in np.unique(lengths)]) if len(lengths) else np.zeros((1, UPPER))
    cuts, at = np.zeros(1 << depth), np.ones(len(places), np.int64)
    for level in range(depth):
        for node in range(1 << level, 2 << level):
            own = at == node
            cuts[node] = np.median(places[own, level]) if own.any() else 0.0
        at = 2 * at + (places[:, level] > cuts[at])
    return cuts


def split(place: np.ndarray, cut: np.ndarray | float, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(goes left, goes right): two runs that share what lies within half a window of the cut, so that pairs up to a window apart stay together."""
    return place <= cut + half / 2, place >= cut - half / 2


def placed_vectors(vectors: DataFrame, cuts: np.ndarray, half: float, seed: int) -> DataFrame:
    """(label, dim, leaf, both, node, copies, vector): a row per upper run that a vector lies in; ``both`` has a bit per cut at which it also went left."""
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)
    depth = len(cuts).bit_length() - 1

    def run(batches):
        cuts = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                lengths = np.diff(part.column(3).offsets.to_numpy())
                for dim in np.unique(lengths):
                    own = part.filter(pa.array(lengths == dim))
                    row, node, both = np.arange(len(own)), np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
                    if depth:
                        places = _unit(_matrix(own.column(3), int(dim))) @ directions(int(dim), UPPER, seed)
                        for level in range(depth):
                            left, right = split(places[row, level], cuts[node], half)
                            node, both, row = np.r_[2 * node[left], 2 * node[right] + 1], np.r_[2 * both[left], 2 * both[right] + left[right]], np.r_[row[left], row[right]]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([own.column(0).take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(node), pa.array(both), *(own.column(i).take(take) for i in (1, 2, 3))], names=["label", "dim", "leaf", "both", "node", "copies", "vector"])

    labelled = vectors.select(F.xxhash64("label").alias("label"), "node", "copies", "vector")
    schema = T.StructType([T.StructField("label", T.LongType()), T.StructField("dim", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("leaf", "both", "node", "copies")), T.StructField("vector", vectors.schema["vector"].dataType)])
    return labelled.mapInArrow(run, schema)


def blocks_of(placed: DataFrame) -> DataFrame:
    """Rows with the key of their task: label, dim, leaf, low, high; lone vectors are left out, long runs are cut into pairs of blocks."""
    sizes = placed.groupBy("label", "dim", "leaf").agg(F.count("*").alias("size")).where("size > 1")
    counted = placed.join(sizes, ["label", "dim", "leaf"]).withColumn("pieces", F.ceil(F.col("size") / F.lit(RUN)).cast("int"))
    counted = counted.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("pieces")).cast("int"))
    spread = counted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return spread.select("label", "dim", "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "both", "node", "copies", "vector")


class Run:
    """The vectors of a task's key: their projections, and what is known of their links so far."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, both: np.ndarray, block: np.ndarray, least: float, half: float, seed: int):
        self.x, self.copies, self.both, self.block, self.least, self.half = x, copies, both, block, least, half
        self.norms = np.linalg.norm(x, axis=1)
        walk = (x / self.norms[:, None]) @ directions(x.shape[1], LOWER + COUNTED, seed + 1)
        self.sorters, self.walk = walk[:, :LOWER], walk[:, LOWER:].astype(np.float32)
        self.needed, self.two_blocks = least_collisions(), len(np.unique(block)) > 1
        self.links, self.root = np.zeros(len(x), np.int64), np.arange(len(x))

    def solve(self) -> None:
        """Cut the run on until pieces are short, and compare each of them."""
        todo = [(np.arange(len(self.x)), np.zeros(len(self.x), np.int64), 0)]
        while todo:
            rows, both, level = todo.pop()
            if len(rows) > SHORT and level < LOWER:
                place = self.sorters[rows, level]
                order = np.argsort(place, kind="stable")
                rows, both, place = rows[order], both[order], place[order]
                left, right = split(place, place[len(place) // 2], self.half)
                if max(left.sum(), right.sum()) <= 0.8 * len(rows):
                    todo += [(rows[left], 2 * both[left], level + 1), (rows[right], 2 * both[right] + left[right], level + 1)]
                    continue
            self.compare(rows, both)

    def compare(self, rows: np.ndarray, both: np.ndarray, tall: int = 64, wide: int = 2048) -> None:
        """Count window collisions of the sorted rows, and verify the pairs that pass."""
        order = np.argsort(self.walk[rows, 0], kind="stable")
        rows, both = rows[order], both[order]
        w = np.ascontiguousarray(self.walk[rows].T)
        half = np.float32(self.half)
        end = np.searchsorted(w[0], w[0] + half, "right")
        for a in range(0, len(rows), tall):
            b = min(a + tall, len(rows))
            for c in range(a, int(end[b - 1]), wide):
                d = min(c + wide, int(end[b - 1]))
                met = np.zeros((b - a, d - c), np.uint8)
                for line in w:
                    met += np.abs(line[a:b, None] - line[None, c:d]) <= half
                i, j = np.nonzero(met >= self.needed)
                i, j = i + a, j + c
                keep = (j > i) & (both[i] & both[j] == 0)
                i, j = rows[i[keep]], rows[j[keep]]
                keep = self.both[i] & self.both[j] == 0
                if self.two_blocks:
                    keep &= self.block[i] != self.block[j]
                i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 15):
                    self.verify(i[at : at + (1 << 15)], j[at : at + (1 << 15)])

    def verify(self, i: np.ndarray, j: np.ndarray) -> None:
        close = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.least * self.norms[i] * self.norms[j]
        i, j = i[close], j[close]
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        while True:  # hang the larger root below the smaller one, then shorten, until both ends agree
            p, q = self.root[i], self.root[j]
            apart = p != q
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while not np.array_equal(self.root, short := self.root[self.root]):
                self.root = short


def linked_in_blocks(blocks: DataFrame, least: float, half: float, seed: int) -> DataFrame:
    """Stored (node, links, root): partial link counts, and a node that it is connected with."""
    key = ["label", "dim", "leaf", "low", "high"]
    ordered = blocks.repartition(*key).sortWithinPartitions(*key, "node")

    def solve(table: pa.Table):
        """One batch of results from whole groups."""
        keys = [table.column(c).to_numpy() for c in key]
        first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        out = []
        for a, b in zip(first, np.r_[first[1:], len(table)]):
            if b - a < 2:
                continue
            part = table.slice(a, b - a).combine_chunks()
            both, node, copies, block = (part.column(c).to_numpy() for c in ("both", "node", "copies", "block"))
            if keys[3][a] != keys[4][a] and len(np.unique(block)) < 2:
                continue
            run = Run(_matrix(part.column("vector").combine_chunks(), int(keys[1][a])), copies, both, block, least, half, seed)
            run.solve()
            if len(at := np.flatnonzero(run.links)):
                out.append((node[at], run.links[at], node[run.root[at]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "root"])

    def run(batches):
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            same = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in key], axis=0)
            if cut := int(np.argmax(same)):
                yield from solve(table.slice(0, cut))
            tail = table.slice(cut)
        if tail is not None:
            yield from solve(tail)

    return written(ordered.mapInArrow(run, "node long, links long, root long"), "vector-links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, seed: int = 41) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept; links join equal labels at cosine >= ``least``."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    hashed = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    vectors = distinct_vectors(hashed.where(usable()))
    total, most = vectors.groupBy("label").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).agg(F.sum("rows"), F.max("n")).first()
    half = WINDOW * math.sqrt(2 - 2 * least)
    placed = placed_vectors(vectors, upper_cuts(vectors, most or 0, seed), half, seed)
    found = linked_in_blocks(blocks_of(placed), least, half, seed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    # All that follows is settled per distinct vector; rows only look their vector up.
    known = vectors.drop("vector").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links"), "vector-known")
    groups = known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size"))
    settled = join_unique(known, written(groups, "vector-groups"), ["root"], "size", total or 0)
    settled = written(settled.select("label", "h1", "h2", "n_links", "component_id", "copies"), "vector-settled")
    met = join_unique(hashed.where(usable()).select("id", "label", "h1", "h2"), settled, ["label", "h1", "h2"], "copies", total or 0)
    alone = rows.where(~usable()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = met.select("id", F.col("n_links").cast("long"), F.coalesce("component_id", "id").alias("component_id")).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
