"""Queries of rules, answers, validation and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.text import hash_int
from strandmill.operators import checks as C
from strandmill.operators import rules as R
from strandmill.operators.search import search
from strandmill.plans.book import query, sql_hash, sql_hmac
from strandmill.sources.tables import table

RULES = {
    "costly_open": {"any": [{"all": [{"is_true": "costly"}, {"is_false": "finished"}]}], "message": "costly and open"},
    "urgent": {"any": [{"is_true": "urgent"}, {"all": [{"is_true": "costly"}, {"any": [{"is_true": "recent"}, {"is_true": "urgent"}]}]}], "message": "look at it"},
}
BOOLEANS = {"costly", "finished", "urgent", "recent"}
ANSWERS = """a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice > 150000 END AS costly, o_orderstatus = 'F' AS finished,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority = '1-URGENT' END AS urgent, o_orderdate >= TIMESTAMP '1997-01-01' AS recent FROM orders)"""


def answers(spark, d):
    """One row of three-valued answers per order."""
    orders = table(spark, d, "orders")
    hide = lambda n, c: F.when(F.col("o_orderkey") % n != 0, c)
    return orders.select(
        "o_orderkey",
        hide(7, F.col("o_totalprice") > 150000).alias("costly"),
        (F.col("o_orderstatus") == "F").alias("finished"),
        hide(5, F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recent"),
    )


@query(
    f"""WITH {ANSWERS} SELECT o_orderkey, list_filter([CASE WHEN costly AND NOT finished THEN 'costly_open' END, CASE WHEN urgent OR (costly AND (recent OR urgent)) THEN 'urgent' END], lambda x: x IS NOT NULL) AS fired FROM a"""
)
def rule_eval(spark, d):
    for rule in RULES.values():
        for clause in rule["any"]:
            R.check_clause(clause, BOOLEANS)
    return answers(spark, d).select("o_orderkey", R.fired_rules(RULES, F.col)["rule_id"].alias("fired"))


@query(
    f"""WITH {ANSWERS} SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN costly END AS costly, CASE WHEN urgent IS NULL THEN 'unanswered' ELSE 'encoder_correct' END AS urgent_source FROM a"""
)
def proj_explicit(spark, d):
    source = F.when(F.col("o_orderkey") % 3 == 0, "encoder").otherwise("patient")
    promoted = R.promote(F.when(F.col("urgent").isNull(), "unanswered").otherwise("encoder"))
    return answers(spark, d).select("o_orderkey", R.explicit_value(source, F.col("costly")).alias("costly"), promoted.alias("urgent_source"))


@query(f"""WITH {ANSWERS} SELECT o_orderkey, to_json({{'costly': costly, 'urgent': urgent}}) AS clinical, len(list_filter([costly, urgent], lambda x: x IS NOT NULL)) AS answered FROM a""")
def proj_clinical_and_audit(spark, d):
    rows = answers(spark, d)
    return rows.select("o_orderkey", F.to_json(F.struct("costly", "urgent"), {"ignoreNullFields": "false"}).alias("clinical"), F.size(F.array_compact(F.array("costly", "urgent"))).alias("answered"))


QUESTIONS = [("costly", "Is it costly?", True, "Boolean"), ("urgent", "Is it urgent?", True, "Boolean"), ("note", "Anything else?", False, "text"), ("pounds", "How heavy?", True, "Number")]


@query("""SELECT * FROM (VALUES ('costly', 'Is it costly?', true), ('urgent', 'Is it urgent?', true), ('pounds', 'How heavy?', false)) t(answer_key, prompt, is_signal)""")
def proj_encoder_defs(spark, d):
    questions = spark.createDataFrame(QUESTIONS, "answer_key string, prompt string, send boolean, answer_type string")
    return questions.where("send").select("answer_key", "prompt", (F.col("answer_type") == "Boolean").alias("is_signal"))


@query(
    f"""WITH {ANSWERS}, q AS (SELECT * FROM (VALUES ('costly'), ('urgent')) t(answer_key)) SELECT o_orderkey, answer_key, CASE answer_key WHEN 'costly' THEN costly ELSE urgent END AS current_value, CASE answer_key WHEN 'costly' THEN costly ELSE urgent END IS NOT NULL AS suggested FROM a, q"""
)
def proj_client_view(spark, d):
    entry = lambda k: F.struct(F.lit(k).alias("answer_key"), F.col(k).alias("current_value"), F.when(F.col(k).isNotNull(), "encoder").otherwise("unanswered").alias("source"))
    shown = answers(spark, d).select("o_orderkey", F.inline(F.array(entry("costly"), entry("urgent"))))
    return shown.select("o_orderkey", "answer_key", "current_value", (F.col("source") == "encoder").alias("suggested"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'no') THEN false WHEN contains(lower(text), 'the') THEN true END AS signal FROM documents""")
def encoder_stub(spark, d):
    return table(spark, d, "documents").select("doc_id", R.keyword_signal(F.col("text"), "the").alias("signal"))


STATE = """s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true END AS value, CASE WHEN doc_id % 3 = 0 THEN 'patient' ELSE 'unanswered' END AS source, CASE WHEN contains(lower(text), 'no') THEN false WHEN contains(lower(text), 'the') THEN true END AS inferred FROM documents)"""


def _state(spark, d):
    third = F.col("doc_id") % 3 == 0
    return table(spark, d, "documents").select("doc_id", F.when(third, True).alias("value"), F.lit(None).cast("boolean").alias("encoder_value"), F.when(third, "patient").otherwise("unanswered").alias("source"), R.keyword_signal(F.col("text"), "the").alias("inferred"), F.lit(0).alias("change_count"))


@query(f"""WITH {STATE} SELECT doc_id, CASE WHEN source = 'unanswered' THEN coalesce(inferred, value) ELSE value END AS value, CASE WHEN source = 'unanswered' AND inferred IS NOT NULL THEN 'encoder' ELSE source END AS source FROM s""")
def encoder_apply(spark, d):
    return R.apply_encoder(_state(spark, d), "inferred").select("doc_id", "value", "source")


@query(
    f"""WITH {STATE}, e AS (SELECT doc_id, CASE WHEN source = 'unanswered' THEN coalesce(inferred, value) ELSE value END AS value, CASE WHEN source = 'unanswered' THEN inferred END AS enc, doc_id % 2 = 0 AS given FROM s)
       SELECT doc_id, given AS value, CASE WHEN enc IS NULL THEN 'patient' WHEN enc = given THEN 'encoder_correct' ELSE 'encoder_incorrect' END AS source, CASE WHEN enc IS NOT NULL AND value IS DISTINCT FROM given THEN 1 ELSE 0 END AS change_count FROM e"""
)
def provenance_update(spark, d):
    filled = R.apply_encoder(_state(spark, d), "inferred").withColumn("given", F.col("doc_id") % 2 == 0)
    return R.apply_answer(filled, "given").select("doc_id", "value", "source", "change_count")


@query(
    """WITH f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS flip FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, sum(flip) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS change_count FROM f"""
)
def answer_history(spark, d):
    return R.flips(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "change_count")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 11 = 1 THEN 'not_a_number' WHEN o_orderkey % 11 IN (2, 3, 5) THEN 'precision' WHEN o_orderkey % 11 = 6 THEN 'not_finite' END AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'blank' END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' END AS flag FROM orders"""
)
def required_check(spark, d):
    m = F.col("o_orderkey") % 11
    number = F.when(m == 0, F.lit(None)).when(m == 1, "twelve").when(m == 2, "12.345").when(m == 3, "1e-7").when(m == 4, "1.25e1").when(m == 5, "12.50").when(m == 6, "-Infinity").otherwise("12.5")
    words = F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise("text")
    flag = F.when(F.col("o_orderkey") % 5 != 0, True)
    return table(spark, d, "orders").select("o_orderkey", R.missing_answer("Number", number, 1).alias("number"), R.missing_answer("text", words).alias("text"), R.missing_answer("Boolean", flag).alias("flag"))


@query(
    """WITH k AS (SELECT c_custkey, c_custkey % 12 AS k FROM customer)
       SELECT c_custkey, CASE k WHEN 0 THEN ['unexpected_keys'] WHEN 1 THEN ['missing_keys'] WHEN 2 THEN ['patient_for'] WHEN 3 THEN ['first_name'] WHEN 4 THEN ['last_name'] WHEN 5 THEN ['birth_digits'] WHEN 6 THEN ['birth_date'] WHEN 7 THEN ['birth_future'] WHEN 8 THEN ['postcode'] WHEN 9 THEN ['gender'] WHEN 10 THEN ['nhs_number'] ELSE ['submitter_name', 'submitter_relationship'] END AS errors FROM k
       WHERE c_custkey % 24 < 12 UNION ALL SELECT c_custkey, [] FROM k WHERE c_custkey % 24 >= 12"""
)
def payload_checks(spark, d):
    """Details of every customer, half of them with one fault of each kind by turns."""
    k, faulty = F.col("c_custkey") % 12, F.col("c_custkey") % 24 < 12
    but = lambda i, wrong, right: F.when(faulty & (k == i), F.lit(wrong)).otherwise(F.lit(right) if isinstance(right, str) else right)
    born = F.when(faulty & (k == 5), "1990-May-2").when(faulty & (k == 6), "1990-2-30").when(faulty & (k == 7), "2190-1-1").otherwise("1990-2-3")
    # Every other person in order submits for someone else, and says who submits.
    person = F.when(faulty & (k == 2), "them").when(faulty & (k == 11), "someone_else").when(~faulty & (k == 11), "someone_else").otherwise("me")
    submitter = F.when(~faulty, "Sam")
    details = F.create_map(
        F.lit("patient_for"), person, F.lit("first_name"), but(3, " ", F.col("c_name")), F.lit("last_name"), but(4, "n" * 256, "Doe"), F.lit("date_of_birth"), born, F.lit("postcode"), but(8, "12345", "sw1a 1AA"),
        F.lit("gender"), but(9, "x", "other"), F.lit("preferred_name"), F.lit(None).cast("string"), F.lit("nhs_number"), but(10, "943 476 5919", "9434765919"), F.lit("submitter_name"), submitter, F.lit("submitter_relationship"), submitter,
    )
    details = F.when(faulty & (k == 0), F.map_concat(details, F.create_map(F.lit("extra"), F.lit("1")))).when(faulty & (k == 1), F.map_filter(details, lambda n, v: n != "preferred_name")).otherwise(details)
    return table(spark, d, "customer").select("c_custkey", R.person_errors(details, F.to_date(F.lit("2024-01-01"))).alias("errors"))


OPEN_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri"]


@query(
    """WITH l AS (SELECT event_id, user_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS t FROM events)
       SELECT event_id, CASE WHEN user_id % 10 = 0 THEN true WHEN user_id % 10 = 3 AND event_id % 3 = 0 THEN event_id % 2 = 0 WHEN day(t) = 25 THEN false WHEN day(t) = 24 THEN hour(t) * 60 + minute(t) >= 600 AND hour(t) * 60 + minute(t) < 720
         ELSE strftime(t, '%a') IN ('Mon', 'Tue', 'Wed', 'Thu', 'Fri') AND hour(t) * 60 + minute(t) >= 510 AND hour(t) * 60 + minute(t) < 1080 END AS open FROM l"""
)
def availability_eval(spark, d):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/London")
    rows = table(spark, d, "events").select("event_id", "user_id", local.alias("t"))
    special = F.when(F.dayofmonth("t") == 25, "closed").when(F.dayofmonth("t") == 24, "custom")
    row = {
        "active": F.col("user_id") % 10 != 0, "override_open": F.when(F.col("user_id") % 10 == 3, F.col("event_id") % 2 == 0), "override_until": F.when(F.col("event_id") % 3 == 0, F.col("t") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("t")), "now": F.col("t"),
        "exception_type": special, "exception_open": F.lit(600), "exception_close": F.lit(720), "weekday": F.date_format("t", "E"),
        "open_days": F.array(*map(F.lit, OPEN_DAYS)), "minute": F.hour("t") * 60 + F.minute("t"), "open_minute": F.lit(510), "close_minute": F.lit(1080),
    }
    return rows.select("event_id", R.is_open(row).alias("open"))


@query(
    """WITH e AS (SELECT *, event_id % 24 * 60 AS o, user_id % 24 * 60 AS c, repeat('m', (event_id % 600)::INT) AS text, CASE WHEN event_id % 29 > 0 THEN event_id % 30 - 2 END AS hours, ['open', 'closed', 'ajar'][event_id % 3 + 1] AS status, ['closed', 'custom_hours', 'half'][user_id % 3 + 1] AS kind FROM events),
            x AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN o END AS xo, CASE WHEN event_id % 4 > 1 THEN c END AS xc FROM e), n AS (SELECT event_id,
            [CASE WHEN event_type <> 'click' THEN 'unknown_day' END, CASE WHEN o >= c THEN 'hours' END, CASE WHEN length(text) > 500 THEN 'message_length' END] AS weekly,
            [CASE WHEN status = 'ajar' THEN 'status' END, CASE WHEN hours IS NULL THEN 'no_expiry' END, CASE WHEN hours <= 0 THEN 'expiry_past' END, CASE WHEN hours > 24 THEN 'expiry_far' END, CASE WHEN length(text) > 500 THEN 'message_length' END] AS override,
            [CASE WHEN kind = 'half' THEN 'kind' END, CASE WHEN kind = 'custom_hours' AND (xo IS NULL OR xc IS NULL) THEN 'hours_missing' END, CASE WHEN kind = 'custom_hours' AND xo >= xc THEN 'hours' END, CASE WHEN kind = 'closed' AND (xo IS NOT NULL OR xc IS NOT NULL) THEN 'hours_given' END, CASE WHEN length(text) > 500 THEN 'note_length' END] AS exception FROM x)
       SELECT event_id, list_filter(weekly, lambda v: v IS NOT NULL) AS weekly, list_filter(override, lambda v: v IS NOT NULL) AS override, list_filter(exception, lambda v: v IS NOT NULL) AS exception FROM n"""
)
def availability_validate(spark, d):
    """Weekly hours, an override and an exception made from each event, with every fault in some of them."""
    e, u, now = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    opens, closes, text = e % 24 * 60, u % 24 * 60, F.repeat(F.lit("m"), (e % 600).cast("int"))
    pick = lambda i, *names: F.element_at(F.array(*map(F.lit, names)), (i % 3 + 1).cast("int"))
    expires = F.when(e % 29 > 0, now + F.make_dt_interval(F.lit(0), (e % 30 - 2).cast("int")))
    days = F.array(F.lit("Mon"), F.when(F.col("event_type") == "click", "Sun").otherwise(F.col("event_type")))
    return table(spark, d, "events").select(
        "event_id", R.opening_errors(days, opens, closes, text).alias("weekly"), R.override_errors(pick(e, "open", "closed", "ajar"), expires, now, text).alias("override"),
        R.exception_errors(pick(u, "closed", "custom_hours", "half"), F.when(e % 4 > 0, opens), F.when(e % 4 > 1, closes), text).alias("exception"),
    )


#: A key of more than a hash's block.
SIGNING_KEY = "signing key " * 8
_draw = sql_hash("event_id::VARCHAR")


@query(
    f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS received, 't' || (event_id // 2) AS token, CASE {_draw} % 6 WHEN 0 THEN NULL WHEN 1 THEN '12x' WHEN 2 THEN (received - 901)::VARCHAR WHEN 3 THEN (received + 900)::VARCHAR ELSE (received - 30)::VARCHAR END AS stamp FROM events),
            g AS (SELECT *, CASE WHEN {_draw} % 7 = 0 THEN 'forged' ELSE {sql_hmac(SIGNING_KEY, "stamp || token")} END AS signature FROM e),
            o AS (SELECT *, CASE WHEN stamp IS NULL OR stamp = '12x' THEN 'malformed' WHEN abs(received - stamp::BIGINT) > 900 THEN 'stale' WHEN signature <> {sql_hmac(SIGNING_KEY, "stamp || token")} THEN 'bad_signature' END AS gate FROM g)
       SELECT event_id, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY token, gate ORDER BY received, event_id) = 1 THEN 'accepted' ELSE 'replayed' END) AS outcome FROM o"""
)
def webhook_filter(spark, d):
    """Events as signed signals; two share a token, some stamps are malformed or old and some signatures forged."""
    draw, received = hash_int(F.col("event_id").cast("string")), F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(received / 1_000_000).alias("received"), F.concat(F.lit("t"), F.floor(F.col("event_id") / 2).cast("string")).alias("token"), draw.alias("draw"))
    late = lambda by: (F.col("received") + by).cast("string")
    kind = F.col("draw") % 6
    stamped = rows.withColumn("stamp", F.when(kind == 1, "12x").when(kind == 2, late(-901)).when(kind == 3, late(900)).when(kind > 3, late(-30)))
    signed = stamped.withColumn("signature", F.when(F.col("draw") % 7 == 0, "forged").otherwise(C.hmac_sha256(SIGNING_KEY, F.concat("stamp", "token"))))
    return C.webhook_outcomes(signed, SIGNING_KEY).select(F.col("id").alias("event_id"), "outcome")


@query("""SELECT event_id, user_id FROM events WHERE user_id = 7 AND starts_with(event_type, 'c') AND ts >= date_trunc('day', (SELECT min(ts) FROM events)) AND ts < date_trunc('day', (SELECT min(ts) FROM events)) + INTERVAL 10 DAY""")
def audit_filters(spark, d):
    events = table(spark, d, "events")
    # One row is broadcast: the first UTC day.
    first = events.agg(F.date_trunc("day", F.min("ts").cast("timestamp")).alias("first"))
    days = (F.col("ts").cast("timestamp") >= F.col("first")) & (F.col("ts").cast("timestamp") < F.col("first") + F.expr("INTERVAL 10 DAYS"))
    return events.where((F.col("user_id") == 7) & F.startswith("event_type", F.lit("c"))).join(F.broadcast(first), days).select("event_id", "user_id")


MOST_TRIES = 3


@query(
    f"""WITH i AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS code FROM events), t AS (SELECT i.*, min(ts) OVER (PARTITION BY user_id, code) AS issued FROM i),
            x AS (SELECT *, code > 0 AND ts > issued + INTERVAL 5 DAY AS expired, event_type = 'purchase' AS match FROM t),
            f AS (SELECT *, coalesce(count(*) FILTER (WHERE event_type <> 'signup' AND NOT match AND NOT expired) OVER (PARTITION BY user_id, code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM x),
            s AS (SELECT *, coalesce(count(*) FILTER (WHERE match AND NOT expired AND failed < {MOST_TRIES}) OVER (PARTITION BY user_id, code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
       SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'no_user' WHEN code = 0 OR used > 0 THEN 'no_code' WHEN failed >= {MOST_TRIES} THEN 'attempts' WHEN expired THEN 'expired' WHEN NOT match THEN 'mismatch' ELSE 'success' END AS reason FROM s WHERE event_type <> 'signup'"""
)
def otp_state_machine(spark, d):
    """A signup issues a code for five days, every other event tries it, and a purchase matches it; wrong tries count, and success uses the code up."""
    kind = F.col("event_type")
    return R.code_outcomes(table(spark, d, "events"), F.col("user_id") % 13 != 0, kind == "signup", kind == "purchase", MOST_TRIES)


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widgett') OR len(list_filter(string_split(lower(p_name), ' '), lambda t: levenshtein(t, 'widgett') <= 2)) > 0""")
def levenshtein_search(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), F.split("p_name", " ").alias("tags"))
    return search(rows, "Widgett ").select("p_partkey")


@query("""SELECT p_partkey FROM part""")
def search_without_hits(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), F.split("p_name", " ").alias("tags"))
    return search(rows, "qqqqqqqqqq").select("p_partkey")
