"""Structured Streaming operators over the event stream.

Every function builds a streaming query, runs it to the end of what is there (``availableNow``) into
a Parquet sink under the shared folder, or a complete-mode table, and returns the sink's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table

MOST_ATTEMPTS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream with a timestamp that can carry a watermark."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet")
    return stream.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input and return the sink's rows; complete and update sinks keep the last value per batch."""
    spark, out, state = stream.sparkSession, fresh_path(stream.sparkSession, "stream-out"), fresh_path(stream.sparkSession, "stream-state")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out)
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        run = stream.writeStream.outputMode(mode).foreachBatch(keep)
    query = run.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", T.IntegerType())
    found = spark.read.schema(schema).parquet(out)
    return found if mode == "append" else found.where(F.col("batch") == (found.agg(F.max("batch")).first()[0] or 0)).drop("batch") if mode == "complete" else found


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens seen per user: repeats of one token (event type and day) within the window count once."""
    token = F.concat_ws("/", "event_type", F.floor(F.unix_timestamp("ts") / 86400).cast("long").cast("string"))
    seen = events(spark, sf_dir).withColumn("token", token).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["user_id", "token"])
    return drained(seen.select("user_id", "token")).groupBy("user_id").agg(F.count("*").alias("tokens"))


def rate_breaches(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Hours in which a user made more than ``limit`` requests; hours behind the watermark leave the state, and an hour's last count stands."""
    hourly = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "1 hour")).count()
    found = drained(hourly.select("user_id", F.col("window.start").alias("start"), "count"), "update")
    last = found.groupBy("user_id", "start").agg(F.max_by("count", "batch").alias("n"))
    return last.where(F.col("n") > limit).select("user_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


def _job_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first purchase and the first errors that the job may still have decide, so no more rows are kept, whatever order they come in."""
    status, attempts = state.get if state.exists else ("pending", 0)
    bought, errors = None, []
    for rows in batches:
        if status == "pending":
            late = rows["ts"].isna()
            rows = rows.assign(late=late, ts=rows["ts"].where(~late, pd.Timestamp(0))).sort_values(["late", "ts", "event_id"])
            first = {kind: list(rows.loc[rows["event_type"] == kind, ["late", "ts", "event_id"]].head(MOST_ATTEMPTS).itertuples(index=False, name=None)) for kind in ("purchase", "error")}
            bought = min([*([bought] if bought else []), *first["purchase"]], default=None)
            errors = sorted([*errors, *first["error"]])[: MOST_ATTEMPTS - attempts]
    if status == "pending":
        attempts += sum(bought is None or e < bought for e in errors)
        status = "failed" if attempts >= MOST_ATTEMPTS else "delivered" if bought else status
    state.update((status, attempts))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "attempts": [attempts]})


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, status, attempts): errors count up to ``MOST_ATTEMPTS`` and then fail the job, a purchase delivers it; final states stay."""
    steps = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    out = steps.applyInPandasWithState(_job_step, "user_id long, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)
    found = drained(out, "update")
    return found.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s")).select("user_id", "s.status", "s.attempts")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per user and run of sorted rows: errors before the first signup, after the last one, the most in a row, and whether there is a signup."""
    now = None
    show = lambda: pd.DataFrame([now], columns=["user_id", "part", "head", "tail", "worst", "reset"])
    for batch in batches:
        for user, part, kind in batch[["user_id", "part", "event_type"]].itertuples(index=False, name=None):
            if now is None or now[0] != user:
                if now is not None:
                    yield show()
                now = [user, part, 0, 0, 0, False]
            if kind == "signup":
                now[3], now[5] = 0, True
            elif kind == "error":
                now[3] += 1
                now[2] += not now[5]
                now[4] = max(now[4], now[3])
    if now is not None:
        yield show()


def lockouts(spark: SparkSession, sf_dir: str, sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The most failures in a row (a signup resets them) per user, kept as state; goes on where the given folders left off.

    Each batch is dealt to sorted ranges of (user, time), so that a user's rows may lie in many
    tasks; each range becomes one row a user, and those are folded in order onto the state of the batch
    before, which lies under its number. A batch that is run again writes its state anew.
    """
    sink, checkpoint = sink or fresh_path(spark, "lockout-state"), checkpoint or fresh_path(spark, "stream-state")
    place = lambda number: f"{sink}/batch={number}"
    schema = "user_id long, part int, head long, tail long, worst long, reset boolean"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(place(-1))

    def fold(batch: DataFrame, number: int) -> None:
        ranged = batch.repartitionByRange("user_id", "ts", "event_id").sortWithinPartitions("user_id", "ts", "event_id").withColumn("part", F.spark_partition_id())
        runs = ranged.mapInPandas(_runs, schema).unionByName(batch.sparkSession.read.schema(schema).parquet(place(number - 1)))
        ordered = F.array_sort(F.collect_list(F.struct("part", "head", "tail", "worst", "reset")))
        grown = lambda s, r: F.struct(F.when(r["reset"], r["tail"]).otherwise(s["tail"] + r["tail"]).alias("tail"), F.greatest(s["worst"], r["worst"], s["tail"] + r["head"]).alias("worst"))
        start = F.struct(F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("worst"))
        state = runs.groupBy("user_id").agg(F.aggregate(ordered, start, grown).alias("s"))
        # The state stands before all ranges of the next batch, and its worst run is past.
        state.select("user_id", F.lit(-1).alias("part"), F.col("s.tail").alias("head"), "s.tail", "s.worst", F.lit(True).alias("reset")).write.mode("overwrite").parquet(place(number))

    query = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type").writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(f"{schema}, batch int").parquet(sink)
    last = [int(f.rpartition("batch=")[2].partition("/")[0]) for f in states.inputFiles()]
    return states.where(F.col("batch") == max(last)).select("user_id", "worst")


def matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with whether their customer is known, by a stream-static join."""
    known = table(spark, sf_dir, "customer").select("c_custkey")
    errors = events(spark, sf_dir).where("event_type = 'error'")
    return drained(errors.join(known, F.col("user_id") * 3 == F.col("c_custkey"), "left").select("event_id", F.col("c_custkey").isNotNull().alias("matched")))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups without a purchase by the same user within a day, once the watermark has passed; the last three days are left open."""
    left = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", "ts").withWatermark("ts", "1 hour")
    right = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought")).withWatermark("bought", "1 hour")
    within = (F.col("user_id") == F.col("buyer")) & (F.col("bought") >= F.col("ts")) & (F.col("bought") <= F.col("ts") + F.expr("INTERVAL 1 DAY"))
    found = drained(left.join(right, within, "leftOuter").select("event_id", "ts", "bought"))
    last = table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 3 DAYS")).alias("until"))
    return found.where("bought is null").join(F.broadcast(last)).where("ts < until").select("event_id")
