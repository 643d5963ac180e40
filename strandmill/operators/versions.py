"""Appends to versioned sessions that name the version they are based on.

A command is accepted if its base is its session's current version, which it raises by one; it may close
the session. Otherwise it is a ``conflict``, or ``closed`` where the session is closed already, or
``unknown`` where there is no such session.

What becomes of a command depends on all earlier ones of its session, but a stretch of commands maps the
version it starts from to the version it ends with, and leaves all versions alone that none of its
commands is based on. So commands are dealt to sorted ranges, each range becomes such a map, a walk over
the maps finds where each range starts, and every range is then decided by itself. A session with any
share of all commands is spread over as many ranges as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.sources.shared import written


def decide(version: int, closed: bool, base: int, closes: bool) -> tuple[str, int, bool]:
    """(outcome, version, closed) after one command on a known session."""
    if closed:
        return "closed", version, True
    if base != version:
        return "conflict", version, False
    return "accepted", version + 1, bool(closes)


def stretch_map(bases: list[int], closings: list[bool]) -> dict[int, tuple[int, bool]]:
    """Start version -> (end version, closed) of a stretch of commands, for the versions that it changes."""
    ends: dict[int, tuple[int, bool]] = {}
    for base, closes in zip(reversed(bases), reversed(closings)):
        ends[base] = (base + 1, True) if closes else ends.get(base + 1, (base + 1, False))
    return ends


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, part, start, end, closed) of every stretch: the rows of one key in one part, in order."""
    now, bases, closings = None, [], []

    def rows():
        found = stretch_map(bases, closings)
        return pd.DataFrame({"key": [now[0]] * len(found), "part": [now[1]] * len(found), "start": list(found), "end": [e for e, _ in found.values()], "ended": [c for _, c in found.values()]})

    for batch in batches:
        for key, part, base, closes in batch[["key", "part", "base", "closes"]].itertuples(index=False, name=None):
            if now != (key, part):
                if bases:
                    yield rows()
                now, bases, closings = (key, part), [], []
            if not pd.isna(base):
                bases.append(int(base))
                closings.append(closes is True)
    if bases:
        yield rows()


def _decisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, version, closed = None, 0, False
    for batch in batches:
        found = []
        for key, part, base, closes, at, ended in batch[["key", "part", "base", "closes", "at", "ended"]].itertuples(index=False, name=None):
            if now != (key, part):
                now, version, closed = (key, part), at, ended is True
            if pd.isna(at):
                found.append(("unknown", None))
                continue
            outcome, version, closed = decide(int(version), closed, None if pd.isna(base) else int(base), closes is True)
            found.append((outcome, version))
        yield batch.drop(columns=["part", "base", "closes", "at", "ended"]).assign(outcome=[o for o, _ in found], version=pd.array([v for _, v in found], dtype="Int64"))


def _entries(maps: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, part, at, ended): where each part of ``spans`` (key, part, version, closed) starts.

    A walk goes from a map's end to the next part whose map knows that version; walks of all keys are
    followed at once by doubling, so there are as many rounds as the number of parts has bits.
    """
    after = maps.where("not ended").select("key", "part", F.col("end").alias("v")).distinct()
    places = after.withColumn("known", F.lit(None).cast("int")).unionByName(maps.select("key", "part", F.col("start").alias("v"), F.col("part").alias("known")))
    later = Window.partitionBy("key", "v").orderBy("part").rangeBetween(1, Window.unboundedFollowing)
    follow = places.withColumn("next", F.min("known").over(later)).where("known is null and next is not null").select("key", "part", F.col("v").alias("end"), "next")
    step = maps.where("not ended").join(follow, ["key", "part", "end"]).select("key", "part", "start", F.col("next").alias("to_part"), F.col("end").alias("to_start"))
    jump = written(step, "version-steps")
    first = maps.join(spans.where("not closed").select("key", F.col("version").alias("start")).distinct(), ["key", "start"])
    met = written(first.groupBy("key", "start").agg(F.min("part").alias("part")).select("key", "part", "start"), "version-walk")
    at = ["key", "part", "start"]
    while not jump.isEmpty():
        more = met.join(jump, at).select("key", F.col("to_part").alias("part"), F.col("to_start").alias("start"))
        met = written(met.unionByName(more).distinct(), "version-walk")
        second = jump.select("key", F.col("part").alias("to_part"), F.col("start").alias("to_start"), F.col("to_part").alias("far_part"), F.col("to_start").alias("far_start"))
        jump = written(jump.join(second, ["key", "to_part", "to_start"]).select(*at, F.col("far_part").alias("to_part"), F.col("far_start").alias("to_start")), "version-steps")
    ends = maps.join(met, at).select("key", "part", F.struct("end", "ended").alias("after"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = spans.join(ends, ["key", "part"], "left").withColumn("_before", F.last("after", ignorenulls=True).over(before))
    return told.select("key", "part", F.coalesce("_before.end", "version").alias("at"), F.coalesce("_before.ended", "closed").alias("ended"))


def append_versions(commands: DataFrame, sessions: DataFrame, key: str, order: list[str], base: str, closes: str, ranges: int | None = None) -> DataFrame:
    """The key, the ``order`` columns, and each command's outcome and the session's version after it.

    ``sessions`` has one row (key, version, closed) a session. Commands of a session go by ``order``,
    equal ones in any order; a null base is no version, a null ``closes`` is false, a null key is unknown.
    """
    known = sessions.select(F.col(key).alias("key"), F.col("version").cast("long").alias("version"), F.coalesce("closed", F.lit(False)).alias("closed"))
    rows = commands.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(base).cast("long").alias("base"), F.col(closes).alias("closes"))
    sort = ["key", *[f"o{i}" for i in range(len(order))]]
    ranged = rows.join(known, "key", "left")
    ranged = (ranged.repartitionByRange(ranges, *sort) if ranges else ranged.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    stored = written(ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "version-commands")
    # A key in several parts reaches over a border of ranges, and no border has two such keys.
    held = written(stored.where("version is not null").groupBy("key", "part", "version", "closed").agg(F.count("*").alias("n")), "version-parts")
    wide = held.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    spans = written(held.join(F.broadcast(wide), "key", "left_semi").drop("n"), "version-spans")
    stretch = stored.join(F.broadcast(spans.select("key").distinct()), "key", "left_semi").select("key", "part", "row", "base", "closes")
    shape = T.StructType([stored.schema["key"], *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("ended", T.BooleanType())))])
    maps = written(stretch.repartition("part").sortWithinPartitions("part", "row").mapInPandas(_maps, shape), "version-maps")
    entries = F.broadcast(_entries(maps, spans))
    placed = stored.join(entries, ["key", "part"], "left").select(*sort, "part", "row", "base", "closes", F.coalesce("at", "version").alias("at"), F.coalesce("ended", "closed").alias("ended"))
    out = T.StructType([*(stored.schema[c] for c in sort), T.StructField("row", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("version", T.LongType())])
    decided = placed.repartition("part").sortWithinPartitions("part", "row").mapInPandas(_decisions, out)
    return decided.select(F.col("key").alias(key), *[F.col(f"o{i}").alias(c) for i, c in enumerate(order)], "outcome", "version")
