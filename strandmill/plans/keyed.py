"""Queries of joins, keyed state, pages, set operations and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmill.operators import relational as K
from strandmill.plans.book import query
from strandmill.sources.tables import table

CUT = "TIMESTAMP '1998-01-01'"


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


@query(f"SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > {CUT}")
def join_inner_filter(spark, d):
    recent = table(spark, d, "orders").where(F.col("o_orderdate") > _ts("1998-01-01"))
    return recent.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders o WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '1996-06-01')")
def anti_join_orphans(spark, d):
    old = table(spark, d, "orders").where(F.col("o_orderdate") < _ts("1996-01-01"))
    jobs = table(spark, d, "lineitem").where(F.col("l_shipdate") > _ts("1996-06-01")).select(F.col("l_orderkey").alias("o_orderkey"))
    return K.orphans(old, jobs, ["o_orderkey"]).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).orderBy("day", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_fallback(spark, d):
    failed = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return K.orphans(failed, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT l_returnflag, count(*) AS purged FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_returnflag")
def semi_join_delete(spark, d):
    confirmed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(confirmed, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("purged"))


@query("SELECT o_orderstatus, count(*) AS left_over FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderstatus")
def purge_job(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("left_over"))


@query("SELECT s_suppkey, s_name, n_name, coalesce(r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
def presentation_join(spark, d):
    regions = table(spark, d, "region").where("r_regionkey > 1")
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query(
    """WITH s AS (SELECT user_id, event_type, value FROM events), k AS (SELECT user_id, count(DISTINCT event_type) AS sources, count(DISTINCT round(value)) AS variants FROM s GROUP BY user_id)
       SELECT user_id, variants FROM k WHERE sources = (SELECT count(DISTINCT event_type) FROM s)"""
)
def merge_shared(spark, d):
    rows = table(spark, d, "events")
    all_sources = rows.agg(F.count_distinct("event_type").alias("all"))
    per = rows.groupBy("user_id").agg(F.count_distinct("event_type").alias("sources"), F.count_distinct(F.round("value")).alias("variants"))
    return per.join(F.broadcast(all_sources)).where("sources = all").select("user_id", "variants")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark, d):
    return K.latest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def queue_head(spark, d):
    oldest = F.min(F.struct("o_orderdate", "o_orderkey")).alias("head")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(oldest).select("o_orderstatus", F.col("head.o_orderkey").alias("o_orderkey"))


@query("SELECT event_id, event_type, to_base64(encode('{\"id\":' || event_id || '}')) AS cursor FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15 00:00:00', 1000000) ORDER BY ts DESC, event_id DESC LIMIT 26")
def keyset_page(spark, d):
    after = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-15 00:00:00' AS ts, 1000000L AS event_id").first()
    page = K.keyset_page(table(spark, d, "events"), ["ts", "event_id"], tuple(after), 25)
    return page.select("event_id", "event_type", F.base64(F.to_json(F.struct(F.col("event_id").alias("id"))).cast("binary")).alias("cursor"))


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 20")
def stable_multi_key_sort(spark, d):
    return table(spark, d, "part").orderBy(F.col("p_size").desc(), "p_name", "p_partkey").limit(20).select("p_partkey", "p_size", "p_name")


@query("SELECT p_brand, list(p_partkey ORDER BY p_partkey)[1:3] AS shown, greatest(count(*) - 3, 0) AS more FROM part GROUP BY p_brand")
def detail_cap(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    ranked = table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("r"))
    kept = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("p_partkey"))))
    return ranked.groupBy("p_brand").agg(kept.alias("shown"), F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))


@query("SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, d):
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
    return left.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def disjointness(spark, d):
    half = lambda r: table(spark, d, "orders").where(F.col("o_orderkey") % 2 == r).select("o_custkey")
    return half(0).intersect(half(1)).agg(F.count("*").alias("shared")).withColumn("disjoint", F.col("shared") == 0)


@query("SELECT l_returnflag, count(DISTINCT l_linestatus) = 1 AS agrees, min(l_linestatus) AS first_value FROM lineitem GROUP BY l_returnflag")
def set_agreement(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.count_distinct("l_linestatus") == 1).alias("agrees"), F.min("l_linestatus").alias("first_value"))


@query("SELECT k, count(DISTINCT v) > 1 AS conflict FROM (SELECT c_nationkey AS k, 'a' AS v FROM customer UNION SELECT s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END FROM supplier) GROUP BY k")
def union_dims(spark, d):
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("a").alias("v"))
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("b").alias("v"))
    return left.unionByName(right).groupBy("k").agg((F.count_distinct("v") > 1).alias("conflict"))


#: Old rows are all suppliers; new ones have every even id up to twice as many, so about half of them meet an old one.
MERGED = "WITH o AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), n AS (SELECT s_suppkey * 2 AS id, 'new-' || s_name AS name FROM supplier)"


def _merge_inputs(spark, d):
    rows = table(spark, d, "supplier")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), rows.select((F.col("s_suppkey") * 2).alias("id"), F.concat(F.lit("new-"), "s_name").alias("name"))


@query(f"{MERGED} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_if_absent(spark, d):
    old, new = _merge_inputs(spark, d)
    return K.insert_if_absent(old, new, ["id"])


@query(f"{MERGED} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert(spark, d):
    return K.upsert(*_merge_inputs(spark, d), ["id"])


@query("SELECT c_custkey, c_acctbal + coalesce(n, 0) AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def atomic_increment(spark, d):
    more = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(more, "c_custkey", "left").select("c_custkey", (F.col("c_acctbal") + F.coalesce("n", F.lit(0))).alias("balance"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 1000 + n_nationkey, 3 FROM nation WHERE n_regionkey = 1")
def replace_children(spark, d):
    children = table(spark, d, "nation").where("n_regionkey = 1").select((F.col("n_nationkey") + 1000).alias("s_suppkey"), F.lit(3).alias("s_nationkey"))
    return table(spark, d, "supplier").where("s_nationkey <> 3").select("s_suppkey", "s_nationkey").unionByName(children)


@query("SELECT s_suppkey, n > 1 AS may_go FROM (SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def last_row_guard(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.count("*").over(Window.partitionBy("s_nationkey")) > 1).alias("may_go"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS override_mode, c_acctbal >= 0 AS active FROM customer")
def override_cleared(spark, d):
    active = F.col("c_acctbal") >= 0
    return table(spark, d, "customer").select("c_custkey", F.when(active, F.col("c_mktsegment")).alias("override_mode"), active.alias("active"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' ORDER BY o_orderdate, o_orderkey")
def exceptions_from(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate") >= _ts("1998-12-01")).orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT 'nation_without_supplier' AS rule, n_nationkey::VARCHAR AS key, n_name AS detail FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000) UNION ALL SELECT 'small_region', r_regionkey::VARCHAR, r_name FROM region WHERE r_regionkey > 3")
def violations_frame(spark, d):
    suppliers = table(spark, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("n_nationkey"))
    return K.violations(("nation_without_supplier", K.orphans(table(spark, d, "nation"), suppliers, ["n_nationkey"]), F.col("n_nationkey"), F.col("n_name")), ("small_region", table(spark, d, "region").where("r_regionkey > 3"), F.col("r_regionkey"), F.col("r_name")))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS gone, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS live FROM orders GROUP BY o_orderstatus")
def delete_expired(spark, d):
    """Rows that a deletion of what expired before 1996 takes and leaves, per status."""
    expired = F.col("o_orderdate") < _ts("1996-01-01")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(expired).alias("gone"), F.count_if(~expired).alias("live"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type = 'purchase' AS is_closed FROM events")
def close_flag_on_latest(spark, d):
    """Versions of which the latest is closed by a purchase; earlier ones are never touched."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    latest = K.latest_by(events, ["user_id"], ["ts", "event_id"]).where("event_type = 'purchase'").select("event_id", F.lit(True).alias("closed"))
    return events.join(latest, "event_id", "left").select("event_id", F.coalesce("closed", F.lit(False)).alias("is_closed"))


@query(
    """WITH e AS (SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 1 DAY <= TIMESTAMP '1998-01-01')
       SELECT o_orderpriority, o_orderkey, '1998-01-01 00:10:00' AS lease_until FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM e) WHERE r = 1"""
)
def queue_claim(spark, d):
    """The oldest eligible job of each queue, leased for ten minutes from the claim's time."""
    due = table(spark, d, "orders").where("o_orderstatus = 'O'").where(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY") <= _ts("1998-01-01"))
    head = due.groupBy("o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("head"))
    return head.select("o_orderpriority", F.col("head.o_orderkey").alias("o_orderkey"), F.date_format(_ts("1998-01-01") + F.expr("INTERVAL 10 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("lease_until"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def count_all(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, p_brand FROM nation, (SELECT DISTINCT p_brand FROM part) b WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 25 + 1 = replace(p_brand, 'Brand#', '')::INT)")
def undeclared_pairs(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()
    # Both sides are dimensions: 25 nations, and brands of which there are at most a few dozen.
    grid = table(spark, d, "nation").select("n_nationkey").join(brands)
    declared = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"))
    return grid.join(declared, ["n_nationkey", "p_brand"], "left_anti")
