"""Keyed state, pages, set checks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order`` (nulls first), as one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, limit: int, most: int = 200) -> DataFrame:
    """Rows in descending ``order`` after the cursor; one more than ``limit`` (clamped to 1..most) tells that there is another page."""
    size = max(1, min(limit, most))
    rows = df if after is None else df.where(F.struct(*order) < F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after)]))
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(size + 1)


def orphans(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows whose keys it lacks; of equal new keys the first in column order stays."""
    rest = [c for c in table.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows replaced or added; ``rows`` has one row per key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def violations(*checks: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """(rule, key, detail) of every check's offending rows; empty when all hold."""
    frames = [df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")) for rule, df, key, detail in checks]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
