"""Reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows get numbers 0..N-1 without a global sort: ids are hashed into buckets, numbered inside their
bucket, and shifted by the bucket's offset (a running sum over the bucket counts, one row per
bucket); rows that are equal in bulk are numbered last, in parts. The number then passes an alternating Feistel network on Z_a x Z_b with
``a = ceil(sqrt(N))`` and ``b = ceil(N / a)``. The domain exceeds N by less than a, and values that
fall outside are walked along their cycle until they come back. ``shard = p mod shards`` and
``slot = p div shards`` follow from the permuted number p alone, so shard sizes differ by one row
at most and slots have no gaps; ``shuffled_number`` and ``number_at`` compute either direction.

Defined results: a null text has no bytes; texts of any length are only measured; null and repeated
ids are numbered like any others (ties in the order of the stored rows); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.sources.shared import written

ROUNDS = 6
#: Most buckets that rows are numbered in; their counts are broadcast.
MOST_BUCKETS = 65_536


def _halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mask(value: Column, seed: int, turn: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), F.lit(turn)), F.lit(modulus))


def _forward(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = ((x - x % F.lit(b)) / F.lit(b)).cast("long"), x % F.lit(b)
    for turn in range(ROUNDS):
        if turn % 2 == 0:
            left = (left + _mask(right, seed, turn, a)) % F.lit(a)
        else:
            right = (right + _mask(left, seed, turn, b)) % F.lit(b)
    return left * F.lit(b) + right


def _backward(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = ((x - x % F.lit(b)) / F.lit(b)).cast("long"), x % F.lit(b)
    for turn in reversed(range(ROUNDS)):
        if turn % 2 == 0:
            left = F.pmod(left - _mask(right, seed, turn, a), F.lit(a))
        else:
            right = F.pmod(right - _mask(left, seed, turn, b), F.lit(b))
    return left * F.lit(b) + right


def _walk(x: Column, n: int, step) -> Column:
    """Apply ``step`` until the value is below n.

    ``a * b - n`` values lie outside, fewer than a, and a cycle visits each of them once at most, so
    that many extra steps always do. The first 64 are tried one by one; the others, which hardly a
    row needs, are made in a nested loop that is not entered otherwise.
    """
    a, b = _halves(n)
    outside = a * b - n
    if not outside:
        return step(x)
    on = lambda p: F.when(p < F.lit(n), p).otherwise(step(p))
    steps = lambda p, count: F.aggregate(F.sequence(F.lit(1), F.lit(count)), p, lambda q, _: on(q))
    near = steps(step(x), min(outside, 64))
    if outside <= 64:
        return near
    side = math.isqrt(outside - 1) + 1
    far = F.aggregate(F.sequence(F.lit(1), F.lit(side)), near, lambda p, _: F.when(p < F.lit(n), p).otherwise(steps(p, side)))
    return F.when(near < F.lit(n), near).otherwise(far)


def shuffled_number(row_number: Column, n: int, seed: int = 17) -> Column:
    """The place of row ``row_number`` (0..n-1, long) in the shuffled order."""
    a, b = _halves(n)
    return _walk(row_number, n, lambda x: _forward(x, a, b, seed))


def number_at(place: Column, n: int, seed: int = 17) -> Column:
    """Inverse of ``shuffled_number``: which row number stands at a place; place = slot * shards + shard."""
    a, b = _halves(n)
    return _walk(place, n, lambda x: _backward(x, a, b, seed))


def with_row_numbers(rows: DataFrame, keys: list[str], number_col: str, rows_per_bucket: int = 50_000) -> tuple[DataFrame, int]:
    """Add gapless numbers 0..N-1 that depend on ``keys`` alone (ties: any order); also returns N.

    ``rows`` must be stored (it is read several times). Bucket counts are one row per bucket. Rows that
    are equal in their keys lie in one bucket; where they alone would fill it, they are numbered after
    all others, dealt to as many parts as it takes.
    """
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(64, total // rows_per_bucket))
    full = max(rows_per_bucket, total // buckets)
    hashed = rows.withColumn("_h", F.xxhash64(*keys)).withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    crowded = counts.where(F.col("_n") > 2 * full).select("_bucket")
    inside = [F.col(k) for k in keys]
    if crowded.isEmpty():
        return _placed(hashed, counts, ["_bucket"], inside, number_col, 0), total
    # Fewer keys than buckets can have so many rows.
    heavy = written(hashed.join(F.broadcast(crowded), "_bucket").groupBy("_h").agg(F.count("*").alias("_copies")).where(F.col("_copies") > full), "many-equal")
    rest = hashed.join(F.broadcast(heavy), "_h", "left_anti")
    equal = written(hashed.join(F.broadcast(heavy), "_h").withColumn("_rid", F.monotonically_increasing_id()), "equal-rows")
    equal = equal.withColumn("_bucket", F.pmod(F.xxhash64("_rid"), F.ceil(F.col("_copies") / full)).cast("int"))
    first = total - (heavy.agg(F.sum("_copies")).first()[0] or 0)
    numbered = _placed(rest, rest.groupBy("_bucket").agg(F.count("*").alias("_n")), ["_bucket"], inside, number_col, 0)
    after = _placed(equal, equal.groupBy("_h", "_bucket").agg(F.count("*").alias("_n")), ["_h", "_bucket"], [F.col("_rid")], number_col, first).drop("_copies", "_rid")
    return numbered.unionByName(after), total


def _placed(hashed: DataFrame, counts: DataFrame, part: list[str], order: list[Column], number_col: str, first: int) -> DataFrame:
    """Numbers from ``first`` on, part by part; ``counts`` has ``_n`` of each part, at most twice ``MOST_BUCKETS`` rows."""
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_offset"))
    inside = Window.partitionBy(*part).orderBy(*order)
    numbered = hashed.withColumn("_place", F.row_number().over(inside).cast("long")).join(F.broadcast(offsets), part)
    return numbered.withColumn(number_col, F.lit(first) + F.col("_offset") + F.col("_place") - 1).drop("_h", "_bucket", "_place", "_offset")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts differ by one at most, so copies of a text are spread and
    ``grown_shard`` (defined for the law ``key`` alone) is null.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    numbered, total = with_row_numbers(rows, ["id", "text_crc32", "size"], "number")
    place = shuffled_number(F.col("number"), total, seed) if total else F.col("number")
    return numbered.withColumn("place", place).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
