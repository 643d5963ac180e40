"""Queries of ruleset, presentation and deployment checks, tokens, logins and fallbacks.

Orders stand for questions and jobs, customers for users, parts for conditions.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from strandmill.operators import checks as C
from strandmill.operators import relational as K
from strandmill.operators.rules import RuleError, check_clause
from strandmill.plans.book import query, sql_hmac
from strandmill.sources import files
from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table


@query(
    """WITH q AS (SELECT o_custkey AS ruleset, o_orderkey % 5 <> 0 AS quantity, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS systems, CASE WHEN o_orderstatus = 'P' THEN 'imperial' ELSE 'metric' END AS fallback FROM orders)
       SELECT ruleset, count(*) AS questions FROM q WHERE quantity AND systems > 1 GROUP BY ruleset HAVING count(DISTINCT fallback) > 1"""
)
def shared_toggle_check(spark, d):
    """Customers as rulesets and their orders as questions; systems come in either order."""
    key = F.col("o_orderkey")
    both = F.when(key % 2 == 0, F.array(F.lit("metric"), F.lit("imperial"))).otherwise(F.array(F.lit("imperial"), F.lit("metric")))
    questions = table(spark, d, "orders").select(F.col("o_custkey").alias("ruleset"), key.alias("answer_key"), (key % 5 != 0).alias("quantity"), F.when(key % 7 == 0, F.array(F.lit("metric"))).otherwise(both).alias("allowed_systems"), F.when(F.col("o_orderstatus") == "P", "imperial").otherwise("metric").alias("default_system"))
    return C.shared_toggle_disagrees(questions)


#: Presentation blocks by turns, with the rule that each breaks; %s stands for the part's name.
BLOCKS = [
    ("no_presentation", None), ("no_presentation", "[1]"), ("no_presentation", "{"), ("label", '{"label": "  "}'), ("label", '{"label": 7}'), ("label", '{"label": 7, "search_tags": [], "free_text_prompt": "\\"label\\": \\"x\\""}'),
    ("prompt_not_text", '{"label": "x", "free_text_prompt": 7}'), ("prompt_not_text", '{"label": "x", "free_text_prompt": {"free_text_prompt": "x"}}'), ("tags_not_texts", '{"label": "x", "search_tags": 5}'), ("tags_not_texts", '{"label": "x", "search_tags": [{"label": "a"}]}'),
    ("tags_not_texts", '{"label": "x", "search_tags": ["a", 1]}'), ("tag_blank", '{"label": "x", "search_tags": ["a", " "]}'), ("tag_too_long", '{"label": "x", "search_tags": ["' + "a" * (C.LONGEST_TAG + 1) + '"]}'), ("too_many_tags", '{"label": "x", "search_tags": [' + ", ".join(['"a"'] * (C.MOST_TAGS + 1)) + "]}"),
    ("unexpected_keys", '{"size": 1, "label": "x", "color": 2}'), (None, '{"label": "%s", "free_text_prompt": null, "search_tags": null}'), (None, '{"label": "%s", "free_text_prompt": "{\\"size\\": 1}", "search_tags": ["a", "b "]}'), (None, '{"label": "%s", "search_tags": []}'),
]


@query(
    f"""SELECT rule, p_partkey::VARCHAR AS key, CASE rule WHEN 'unexpected_keys' THEN 'color,size' ELSE '' END AS detail
       FROM (SELECT p_partkey, [{", ".join("NULL" if r is None else f"'{r}'" for r, _ in BLOCKS)}][p_partkey % {len(BLOCKS)} + 1] AS rule FROM part) WHERE rule IS NOT NULL"""
)
def label_check(spark, d):
    """Presentation blocks with each fault: none, a label or prompt of another kind, tags that are none, keys too many; sound ones among them."""
    block = F.element_at(F.array(*[F.lit(b) for _, b in BLOCKS]), (F.col("p_partkey") % len(BLOCKS) + 1).cast("int"))
    return C.presentation_violations(table(spark, d, "part").select(F.col("p_partkey").alias("condition"), F.replace(block, F.lit("%s"), F.col("p_name")).alias("presentation")))


@query(
    """WITH n AS (SELECT o_custkey, list(trim(o_orderpriority)) AS names FROM orders GROUP BY o_custkey)
       SELECT o_custkey, list_filter([CASE WHEN len(names) > 15 THEN 'too_many' END, CASE WHEN len(list_filter(names, lambda x: length(x) > 12)) > 0 THEN 'too_long' END, CASE WHEN len(names) > len(list_distinct(names)) THEN 'duplicate' END], lambda x: x IS NOT NULL) AS errors FROM n"""
)
def name_list_check(spark, d):
    """Priorities of a customer's orders as names, some in capitals and some with white space around them."""
    spelt = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    names = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(spelt).alias("names"))
    return names.select("o_custkey", C.name_list_errors(F.col("names"), 15, 12).alias("errors"))


@query("SELECT * FROM (VALUES ('several_practices', '3', '25'), ('no_email', '3', ''), ('practice_missing', '77', ''), ('several_practices', '77', '25'), ('no_users', '77', '')) t(rule, key, detail)")
def startup_checks(spark, d):
    """Nations as practices and customers as their users: one that lacks an address, and one that is not there."""
    practices = table(spark, d, "nation").select(F.col("n_nationkey").alias("practice_id"), F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("email"))
    users = table(spark, d, "customer").select(F.col("c_nationkey").alias("practice_id"))
    return C.deployment_violations(practices, users, 3).unionByName(C.deployment_violations(practices, users, 77))


@query(f"""WITH t AS (SELECT event_id, user_id || ':' || event_id || ':1:' AS head, strftime(ts, '%Y%m%d%H%M') AS time FROM events) SELECT event_id, head || time || ':' || {sql_hmac("shared key", "head || 'password:' || time")} AS token FROM t""")
def hmac_token(spark, d):
    """Tokens mailbox:nonce:count:time:signature of all events."""
    time = F.date_format("ts", "yyyyMMddHHmm")
    parts = lambda *more: F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("1"), *more)
    return table(spark, d, "events").select("event_id", parts(time, C.hmac_sha256("shared key", parts(F.lit("password"), time))).alias("token"))


@query(
    """WITH a AS (SELECT c_custkey, c_custkey % 4 AS failures, CASE WHEN c_custkey % 13 = 0 THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'cooldown' WHEN c_custkey % 7 = 0 THEN 'locked' WHEN c_mktsegment = 'BUILDING' THEN 'no_password' WHEN c_acctbal < 0 THEN 'wrong_password' ELSE 'success' END AS reason FROM customer)
       SELECT c_custkey, reason, CASE reason WHEN 'wrong_password' THEN failures + 1 WHEN 'success' THEN 0 ELSE failures END AS failures, reason = 'wrong_password' AND failures + 1 >= 3 AS lock FROM a"""
)
def lockout_decision(spark, d):
    """One login of every customer against its gates in order."""
    k = F.col("c_custkey")
    decision = C.login_decision(k % 13 != 0, k % 11 == 0, k % 7 == 0, F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") >= 0, k % 4, 3)
    return table(spark, d, "customer").select("c_custkey", decision.alias("x")).select("c_custkey", "x.*")


@query(
    """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failed, min(event_id) FILTER (WHERE event_type = 'purchase') AS queued FROM events GROUP BY user_id)
       SELECT user_id, CASE WHEN failed >= 3 THEN 'fallback_triggered' ELSE 'pending' END AS status, CASE WHEN failed >= 3 THEN coalesce(queued, -user_id) ELSE queued END AS delivery FROM s"""
)
def fallback_transition(spark, d):
    """Jobs whose attempts are used up change state and get a fallback delivery, unless one is queued already: the first write stays."""
    events = table(spark, d, "events")
    jobs = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    changed = jobs.select("user_id", F.when(F.col("failed") >= 3, "fallback_triggered").otherwise("pending").alias("status"))
    queued = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("delivery"))
    wanted = changed.where("status = 'fallback_triggered'").select("user_id", (-F.col("user_id")).alias("delivery"))
    return changed.join(K.insert_if_absent(queued, wanted, ["user_id"]), "user_id", "left").select("user_id", "status", "delivery")


@query("SELECT event_id, user_id, event_type AS action, value FROM events UNION ALL SELECT -o_orderkey, o_custkey, 'order', o_totalprice FROM orders")
def audit_insert(spark, d):
    """Orders appended to the audit log with their details as JSON, which are read back."""
    path = fresh_path(spark, "audit")
    detail = lambda c: F.to_json(F.struct(F.col(c).alias("value")))
    old = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), detail("value").alias("detail"))
    new = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("event_id"), F.col("o_custkey").alias("user_id"), F.lit("order").alias("action"), detail("o_totalprice").alias("detail"))
    old.write.parquet(path)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).select("event_id", "user_id", "action", F.get_json_object("detail", "$.value").cast("double").alias("value"))


@query("SELECT rule, CASE rule % 5 WHEN 0 THEN 'kind' WHEN 1 THEN 'key' WHEN 2 THEN 'empty' WHEN 3 THEN 'depth' END AS rejected FROM range(1, 21) t(rule)")
def rule_validate(spark, d):
    """Twenty rules, of which all but every fifth are rejected; rules are metadata that the driver checks."""
    deep = {"is_true": "a"}
    for _ in range(3):
        deep = {"any": [deep]}
    kinds = [("kind", {"is_maybe": "a"}), ("key", {"is_true": "zz"}), ("empty", {"all": []}), ("depth", deep), (None, {"all": [{"is_true": "a"}, {"any": [{"is_false": "b"}]}]})]
    rows = []
    for key in range(1, 21):
        name, clause = kinds[key % 5]
        try:
            check_clause(clause, {"a", "b"})
            rows.append((key, None))
        except RuleError:
            rows.append((key, name))
    return spark.createDataFrame(rows, "rule long, rejected string")


@query("SELECT r_regionkey, sha256('{\"name\": \"' || r_name || '\", \"questions\": [' || r_regionkey || ']}') AS digest FROM region")
def ruleset_hash(spark, d):
    """Digests of rulesets read from a tree of JSON files, whatever order their keys come in."""
    path = fresh_path(spark, "rulesets")
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("part"), F.array("r_regionkey").alias("questions"), F.col("r_name").alias("name"))
    rows.write.partitionBy("part").json(f"{path}/rules")
    found = files.json_tree(spark, path, "name", "questions array<long>, name string")
    # Rulesets are metadata of bounded size: the driver holds them.
    digest = lambda r: hashlib.sha256(json.dumps({"questions": r.questions, "name": r.name}, sort_keys=True).encode()).hexdigest()
    return spark.createDataFrame([(r.questions[0], digest(r)) for r in found.collect()], "r_regionkey long, digest string")
