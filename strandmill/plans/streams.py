"""Queries of the streaming operators; each runs over a file stream to its end and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.text import hash_int
from strandmill.operators.versions import append_versions
from strandmill.plans.book import query, sql_hash
from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table
from strandmill.streaming import jobs as J
from strandmill.streaming import state as S


@query("SELECT user_id, count(DISTINCT event_type || '/' || floor(epoch(ts) / 86400)::BIGINT) AS tokens FROM events GROUP BY user_id")
def webhook_dedup(spark, d):
    return J.dedup_counts(spark, d)


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, d):
    return J.rate_breaches(spark, d, 1)


def _sink(spark):
    return fresh_path(spark, "state-out"), fresh_path(spark, "state-checkpoint")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM events),
            s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT user_id, count(*) AS n, max(ts) + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS open FROM s GROUP BY user_id, session"""
)
def session_sliding_ttl(spark, d):
    """Sessions that ended, and those that the state store still holds as open."""
    stream = J.events(spark, d).select(F.col("user_id").alias("key"), "ts")
    return S.session_stream(stream, *_sink(spark), "6 hours").select(F.col("key").alias("user_id"), "n", "open")


#: Versions that commands are based on, and which of them close their session.
BASE, CLOSES = f"{sql_hash('event_id::VARCHAR')} % 6", f"event_type = 'signup' AND {sql_hash('event_id::VARCHAR')} % 7 = 0"
VERSIONS = f"""WITH RECURSIVE s AS (SELECT c_custkey AS user_id, c_acctbal < 0 AS closed FROM customer WHERE c_nationkey <> 3),
            c AS (SELECT user_id, event_id, {BASE} AS base, {CLOSES} AS closes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
            f AS (SELECT user_id, 0 AS r, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, 0 AS version, closed FROM s UNION ALL
                  SELECT c.user_id, c.r, c.event_id, CASE WHEN f.closed THEN 'closed' WHEN base <> version THEN 'conflict' ELSE 'accepted' END, CASE WHEN NOT f.closed AND base = version THEN version + 1 ELSE version END, f.closed OR (base = version AND closes) FROM f JOIN c ON c.user_id = f.user_id AND c.r = f.r + 1)
       SELECT user_id, event_id, outcome, version FROM f WHERE r > 0 UNION ALL SELECT user_id, event_id, 'unknown', NULL FROM c WHERE user_id NOT IN (SELECT user_id FROM s)"""


def _commands(events):
    draw = hash_int(F.col("event_id").cast("string"))
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("command"), (draw % 6).alias("base"), ((F.col("event_type") == "signup") & (draw % 7 == 0)).alias("closes"))


def _customer_sessions(spark, d):
    return table(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("version"), (F.col("c_acctbal") < 0).alias("closed"))


@query(VERSIONS)
def optimistic_append(spark, d):
    """Events as commands on customers' sessions, of which some are closed from the start and some are unknown."""
    decided = append_versions(_commands(table(spark, d, "events")), _customer_sessions(spark, d), "key", ["ts", "command"], "base", "closes")
    return decided.select(F.col("key").alias("user_id"), F.col("command").alias("event_id"), "outcome", "version")


@query(VERSIONS)
def versioned_append(spark, d):
    """The same commands as a stream: accepted ones go to one sink, all others to another."""
    outputs = S.version_stream(_commands(J.events(spark, d)), _customer_sessions(spark, d), *_sink(spark))
    return outputs["accepted"].unionByName(outputs["rejected"]).select(F.col("key").alias("user_id"), F.col("command").alias("event_id"), "outcome", "version")


LEASE, BACKOFF = 36_000, 7_200
KINDS = {"signup": "create", "view": "claim", "error": "fail", "purchase": "deliver"}


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN '{t}' THEN '{k}'" for t, k in KINDS.items())} ELSE 'other' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
            f AS (SELECT user_id, 0::BIGINT AS r, NULL::BIGINT AS ms, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, NULL::BIGINT AS shown, false AS alive, 0 AS attempts, NULL::BIGINT AS hidden FROM (SELECT DISTINCT user_id FROM events) UNION ALL
                  SELECT user_id, r, ms, event_id,
                      CASE WHEN NOT a THEN CASE kind WHEN 'create' THEN 'created' ELSE 'unknown' END WHEN kind = 'claim' THEN CASE WHEN h IS NULL THEN 'claimed' ELSE 'hidden' END WHEN kind = 'fail' THEN CASE WHEN t < 3 THEN 'retry' ELSE 'failed' END WHEN kind = 'deliver' THEN 'delivered' ELSE 'ignored' END,
                      shown, CASE WHEN NOT a THEN kind = 'create' WHEN kind = 'fail' THEN t < 3 ELSE kind <> 'deliver' END, CASE WHEN NOT a THEN 0 WHEN kind = 'fail' THEN t + 1 ELSE t END,
                      CASE WHEN NOT a THEN NULL WHEN kind = 'claim' THEN coalesce(h, ms + {LEASE} * 1000) WHEN kind = 'fail' THEN ms + (t + 1) * {BACKOFF} * 1000 ELSE h END
                  FROM (SELECT e.*, f.alive AS a, f.attempts AS t, CASE WHEN f.alive AND f.hidden > e.ms THEN f.hidden END AS h, CASE WHEN f.alive AND f.hidden <= e.ms THEN f.hidden END AS shown FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)),
            l AS (SELECT user_id, alive, hidden FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1)
       SELECT user_id, event_id, ms, outcome FROM f WHERE r > 0 UNION ALL SELECT user_id, NULL, shown, 'visible' FROM f WHERE shown IS NOT NULL
       UNION ALL SELECT user_id, NULL, hidden, 'visible' FROM l WHERE alive AND hidden <= (SELECT max(ms) - 3600000 FROM e)"""
)
def job_leases(spark, d):
    """Users as jobs: claims hide them, failures put them off, timers show them again."""
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in KINDS.items()], F.lit("other"))
    stream = J.events(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("event"), kind.alias("kind"))
    return S.lease_stream(stream, *_sink(spark), LEASE, BACKOFF).select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "ms", "outcome")


@query("SELECT user_id, count(*) AS length, count(*) AS places, sum(event_id)::BIGINT AS ids FROM events GROUP BY user_id")
def event_history(spark, d):
    """Events appended to their user's history, read back from the log of appends."""
    stream = J.events(spark, d).select(F.col("user_id").alias("key"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("entry"))
    log = S.history_stream(stream, *_sink(spark))
    per = log.groupBy(F.col("key").alias("user_id")).agg(F.max("place").alias("length"), F.count_distinct("place").alias("places"), F.sum(F.get_json_object("entry", "$.id").cast("long")).alias("ids"))
    return per.select("user_id", "length", "places", "ids")


@query(
    """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS d FROM events),
            f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN r END) AS delivered, list(r ORDER BY r) FILTER (WHERE event_type = 'error') AS errors FROM o GROUP BY user_id)
       SELECT user_id, CASE WHEN len(errors) >= 4 AND (delivered IS NULL OR errors[4] < delivered) THEN 'failed' WHEN delivered IS NOT NULL THEN 'delivered' ELSE 'pending' END AS status,
              CASE WHEN len(errors) >= 4 AND (delivered IS NULL OR errors[4] < delivered) THEN 4 WHEN delivered IS NOT NULL THEN len(list_filter(coalesce(errors, []), lambda e: e < delivered)) ELSE coalesce(len(errors), 0) END::BIGINT AS attempts FROM f"""
)
def job_state_machine(spark, d):
    return J.job_states(spark, d)


@query(
    """WITH o AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
       SELECT user_id, max(n)::BIGINT AS worst FROM (SELECT user_id, island, count(*) FILTER (WHERE event_type = 'error') AS n FROM o GROUP BY user_id, island) GROUP BY user_id"""
)
def lockout_counter(spark, d):
    return J.lockouts(spark, d)


@query("SELECT event_id, c_custkey IS NOT NULL AS matched FROM events LEFT JOIN customer ON user_id * 3 = c_custkey WHERE event_type = 'error'")
def unmatched_retry(spark, d):
    return J.matched_events(spark, d)


@query("SELECT a.event_id FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY) AND a.ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def orphan_sweep(spark, d):
    return J.orphans(spark, d)
