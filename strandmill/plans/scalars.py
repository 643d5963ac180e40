"""Queries of scalar functions: text, numbers, dates, arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import numbers as N
from strandmill.functions import text as X
from strandmill.operators import dataset as D
from strandmill.operators import rules as R
from strandmill.plans.book import query, sql_hash
from strandmill.sources.tables import table

NORM = r"regexp_replace(trim(regexp_replace(lower(translate(text, '‘’“”–—', '''''\"\"--')), '\s+', ' ', 'g')), '[.!?\s]+$', '')".replace('\\"', '"')


@query(f"SELECT doc_id, sha256({NORM}) AS norm_sha FROM documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normalise_text(F.col("text")), 256).alias("norm_sha"))


@query()
def normalise_text_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normalise_unicode(F.col("text")), 256).alias("norm_sha"))


@query(f"SELECT doc_id, source || ':' || substr(sha1({NORM}), 1, 8) AS fragment_id, CASE WHEN lang = 'en' THEN sha256({NORM}) ELSE lang END AS cluster FROM documents")
def fragment_id(spark, d):
    norm = X.normalise_text(F.col("text"))
    tag = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.fragment_id(F.col("source"), norm).alias("fragment_id"), X.cluster_key(tag, F.sha2(norm, 256)).alias("cluster"))


@query(
    f"""SELECT doc_id, {sql_hash("'s1:' || doc_id")} % 100 AS bucket,
        CASE WHEN {sql_hash("'s1:' || doc_id")} % 100 < 70 THEN 'train' WHEN {sql_hash("'s1:' || doc_id")} % 100 < 85 THEN 'val' ELSE 'test' END AS split,
        CASE {sql_hash("doc_id::VARCHAR")} % 5 WHEN 2 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS fold2 FROM documents"""
)
def stable_hash_split(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", X.stable_bucket(k, 100, "s1").alias("bucket"), X.assign_split(k, "s1").alias("split"), X.assign_fold(k, 5, 2).alias("fold2"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS tokens,
        len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS chunks FROM documents"""
)
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"), X.whitespace_count(F.col("text")).alias("chunks"))


@query(
    r"""WITH w AS (SELECT DISTINCT unnest(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS word FROM part)
        SELECT word, regexp_extract(word, '^(\W*)(.*?)(\W*)$', 1) AS prefix, regexp_extract(word, '^(\W*)(.*?)(\W*)$', 2) AS core, lower(word) AS folded FROM w"""
)
def word_tokens(spark, d):
    words = table(spark, d, "part").select(F.explode(F.filter(F.split("p_name", " "), lambda x: x != "")).alias("word")).distinct()
    part = F.element_at(X.word_parts(F.col("word")), 1)
    return words.select("word", part["prefix"].alias("prefix"), part["word"].alias("core"), X.fold_token(F.col("word")).alias("folded"))


@query(
    """SELECT turn, lower(role) AS role, sha256(string_agg(conv_id || chr(31) || text || chr(31), '' ORDER BY conv_id, text)) AS digest FROM conversations GROUP BY turn, lower(role)"""
)
def content_digest(spark, d):
    return D.content_digests(table(spark, d, "conversations").withColumn("role", F.lower("role")), ["turn", "role"], "conv_id", "text")


#: SQL of a Unicode word boundary, for an engine whose own is limited to ASCII.
EDGE = (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")
LEXICON = ["the", "of", "and", "was", "that"]
ANCHORS, MODIFIERS = ["the", "der", "que"], ["with", "und", "los"]


@query(
    f"""SELECT doc_id, list_filter({sorted(LEXICON)!r}, lambda t: regexp_matches(lower(text), '{EDGE[0]}' || t || '{EDGE[1]}')) AS found FROM documents"""
)
def lexicon_match(spark, d):
    return table(spark, d, "documents").select("doc_id", X.lexicon_hits(F.lower("text"), LEXICON).alias("found"))


@query(
    f"""WITH h AS (SELECT doc_id, list_filter({sorted(ANCHORS)!r}, lambda t: regexp_matches(lower(text), '{EDGE[0]}' || t || '{EDGE[1]}')) AS a,
                   list_filter({sorted(MODIFIERS)!r}, lambda t: regexp_matches(lower(text), '{EDGE[0]}' || t || '{EDGE[1]}')) AS m FROM documents)
        SELECT doc_id, CASE WHEN len(a) > 0 AND len(m) > 0 THEN array_to_string(a, '/') || '+' || array_to_string(m, '/') END AS pair FROM h"""
)
def lexicon_cooccurrence(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cooccurrence(F.lower("text"), ANCHORS, MODIFIERS).alias("pair"))


@query(
    """SELECT conv_id, string_agg(CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN trim(text) ELSE trim(text) || '.' END, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"""
)
def assemble_text(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", X.assemble(F.col("t.text")).alias("text"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, nullif(trim(regexp_replace(p_brand, '[0-9#]', '', 'g')), 'Brand') AS rest FROM part""")
def slug_and_blank(spark, d):
    rest = X.blank_to_null(F.regexp_replace("p_brand", "[0-9#]", ""))
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), F.nullif(rest, F.lit("Brand")).alias("rest"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS visible, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) = '' AS blank FROM pages""")
def html_strip_blank(spark, d):
    seen = X.visible_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(seen, 256).alias("visible"), (seen == "").alias("blank"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_escaped(expr: str) -> str:
    kept = f"regexp_replace({expr}, {_sql_text(X.ENTITY)}, chr(1) || '\\1', 'g')"
    return f"replace(replace(replace(replace({kept}, '&', '&amp;'), chr(1), '&'), '<', '&lt;'), '>', '&gt;')"


def _sql_attribute(name: str) -> str:
    own = f"list_filter(regexp_extract_all(regexp_replace(regexp_replace(t, '^</?[a-zA-Z]+', ''), '>$', ''), {_sql_text(X.ATTRIBUTE)}), lambda a: regexp_matches(a, '^(?i){name}\\s*='))[1]"
    return f"regexp_replace(regexp_replace({own}, '^[^=]*=\\s*', ''), '^[\"'']|[\"'']$', '', 'g')"


_bare = "replace(html, chr(1), '')"
for _pattern in X.DROPPED:
    _bare = f"regexp_replace({_bare}, {_sql_text(_pattern)}, '', 'g')"
_name, _href, _target = "lower(regexp_extract(t, '^</?([a-zA-Z]+)(?:[\\s/>])', 1))", _sql_attribute("href"), _sql_attribute("target")
_link = f"""'<a' || coalesce(' href="' || replace(CASE WHEN regexp_matches(trim({_href}), {_sql_text(X.KEPT_ADDRESS)}) THEN {_sql_escaped(f"trim({_href})")} END, '"', '&quot;') || '"', '') || coalesce(' target="' || replace({_sql_escaped(_target)}, '"', '&quot;') || '"', '') || ' rel="{X.LINK_REL}">'"""
_piece = f"""CASE WHEN regexp_matches(t, '^<[a-zA-Z/]') THEN CASE WHEN {_name} NOT IN {X.KEPT_TAGS} THEN '' WHEN starts_with(t, '</') THEN '</' || {_name} || '>' WHEN {_name} = 'a' THEN {_link} ELSE '<' || {_name} || '>' END ELSE {_sql_escaped("t")} END"""


@query(f"""WITH c AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all({_bare}, {_sql_text(X.PIECE)}), lambda t: {_piece}), '') AS clean FROM pages) SELECT page_id, sha256(clean) AS clean, length(clean) AS chars, trim(regexp_replace(clean, '<[^>]*>', '', 'g')) = '' AS blank FROM c""")
def html_clean(spark, d):
    """Pages cut down to the allowed tags."""
    rows = table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean"))
    return rows.select("page_id", F.sha2("clean", 256).alias("clean"), F.length("clean").alias("chars"), (X.visible_text(F.col("clean")) == "").alias("blank"))


@query()
def similarity_ratio(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", "text")
    pair = bench.alias("a").join(bench.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return pair.select(F.col("a.item_id").alias("item_id"), F.round(X.similarity_ratio(F.col("a.text"), F.col("b.text")), 6).alias("ratio"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST((CAST(l_quantity AS DECIMAL(12,0)) * 14 + l_linenumber) * CAST('0.45359237' AS DECIMAL(9,8)) AS DOUBLE) AS kg,
        CAST(round((CAST(l_quantity AS DECIMAL(12,0)) * 14 + l_linenumber) * CAST('0.45359237' AS DECIMAL(9,8)), 1) AS DOUBLE) AS rounded FROM lineitem"""
)
def imperial_to_kg(spark, d):
    kg = N.imperial_to_kg(F.col("l_quantity"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kg.cast("double").alias("kg"), N.canonical_quantity(F.lit("imperial"), F.lit(None), kg, 1).cast("double").alias("rounded"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)::VARCHAR || ' st ' || l_linenumber || ' lb' AS shown, CASE WHEN l_linenumber % 2 = 0 THEN greatest(0, len(split_part(l_discount::VARCHAR, '.', 2)) + l_linenumber - 3) ELSE len(split_part(l_discount::VARCHAR, '.', 2)) END AS places, CAST(l_quantity AS BIGINT)::VARCHAR AS plain FROM lineitem""")
def format_quantity(spark, d):
    plain = N.plain_number(F.col("l_quantity").cast("decimal(20,4)"))
    # Every other number is written with an exponent, which moves its point.
    number = F.concat(F.col("l_discount").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("e"), (3 - F.col("l_linenumber")).cast("string"))).otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%s st %d lb", plain, "l_linenumber").alias("shown"), N.decimal_places(number).alias("places"), plain.alias("plain"))


@query(
    """SELECT event_id, event_id % 6 + 1 AS attempt, [1, 10, 60][event_id % 6 + 1] AS email, [1, 5, 15][event_id % 6 + 1] AS message, [5, 10][event_id % 6 + 1] AS document FROM events"""
)
def backoff_minutes(spark, d):
    attempt = F.col("event_id") % 6 + 1
    return table(spark, d, "events").select("event_id", attempt.alias("attempt"), *[N.backoff_minutes(attempt, k).alias(k) for k in ("email", "message", "document")])


@query(
    """WITH c AS (SELECT s_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') % 40 AS k, 40 AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey),
            f AS (SELECT s_suppkey, k, n, least(k, n - k) AS tail FROM c)
       SELECT s_suppkey, k, round(least(1.0, 2 * list_sum(list_transform(range(0, tail + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0)))) / pow(2, n)), 6) AS p FROM f"""
)
def binomial_two_sided(spark, d):
    k = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") % 40).alias("k"))
    return k.select("s_suppkey", "k", F.round(N.binomial_two_sided(F.col("k"), F.lit(40)), 6).alias("p"))


@query(
    """SELECT vec_id, round(exp(embedding[1]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 6) AS p0,
        CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS top FROM embeddings"""
)
def softmax_argmax(spark, d):
    three = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(N.softmax(three), 1), 6).alias("p0"), N.argmax(three).alias("top"))


@query("""SELECT label, round(1.959963984540054 * sqrt(0.25 / count(*)), 6) AS half_width, round(100.0 * (avg(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) - 0.25), 4) AS points FROM embeddings GROUP BY label""")
def worst_case_half_width(spark, d):
    share = F.avg(F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(N.worst_half_width(F.count("*")), 6).alias("half_width"), F.round(N.percent_points(share, F.lit(0.25)), 4).alias("points"))


@query("""SELECT event_id, round(CASE WHEN event_id % 100 < 10 THEN (event_id % 100) / 10.0 ELSE greatest(0, 100 - event_id % 100) / 90.0 END, 6) AS rate FROM events""")
def warmup_decay(spark, d):
    return table(spark, d, "events").select("event_id", F.round(N.warmup_decay(F.col("event_id") % 100, 10, 100), 6).alias("rate"))


@query(
    """SELECT o_orderkey, year(TIMESTAMP '2000-02-28') - year(o_orderdate) - CASE WHEN '0228' < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END AS age, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders"""
)
def age_and_long_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.age_in_years(F.col("o_orderdate"), F.lit("2000-02-28").cast("timestamp_ntz")).alias("age"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("shown"))


@query("""SELECT event_id, date_trunc('day', ts)::VARCHAR AS day_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::VARCHAR AS next_day, (ts + INTERVAL 10 MINUTE)::VARCHAR AS lease_until FROM events""")
def utc_day_bounds(spark, d):
    shown = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("day_start"), F.date_format(day + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss").alias("next_day"), shown(F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 MINUTES")).alias("lease_until"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || user_id AS tag FROM events""")
def json_path_read(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat_ws(":", "event_type", "user_id").alias("tag"))


@query("""SELECT user_id, list(event_type ORDER BY ts, event_id) AS history FROM events GROUP BY user_id""")
def json_array_append(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(ordered.alias("h")).select("user_id", F.col("h.event_type").alias("history"))


@query("""SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda t: NOT list_contains(['click', 'view', 'purchase'], t))) = 0 AS contained FROM events GROUP BY user_id""")
def array_containment(spark, d):
    allowed = F.array(*map(F.lit, ("click", "view", "purchase")))
    return table(spark, d, "events").groupBy("user_id").agg((F.size(F.array_except(F.collect_set("event_type"), allowed)) == 0).alias("contained"))


@query("""WITH t AS (SELECT p_partkey, p_size / 100.0 AS w FROM part) SELECT p_partkey, round(w, 4)::DOUBLE AS a, CASE WHEN p_partkey % 4 > 0 THEN round(1 - w, 4)::DOUBLE END AS b, CASE WHEN p_partkey % 4 = 0 THEN 'sum' WHEN p_partkey % 4 = 1 THEN 'repeats' END AS fault FROM t""")
def weighted_terms(spark, d):
    """Terms like ``a=0.6,b=0.4`` of every part; weights that do not sum to 1 and terms that repeat are faults."""
    weight, k = F.col("p_size") / 100, F.col("p_partkey") % 4
    said = lambda name, w: F.concat(F.lit(f"{name}="), F.format_string("%.2f", w))
    text = F.concat(said("a", weight), F.when(k > 0, F.concat(F.lit(", "), said("b", 1 - weight))).otherwise(""), F.when(k == 1, ",c=0.00,c=0.00").otherwise(""))
    pairs = F.transform(F.split(text, ","), lambda t: F.split(F.trim(t), "="))
    names = F.transform(pairs, lambda t: t[0])
    of = lambda name: F.element_at(F.filter(pairs, lambda t: t[0] == name), 1)[1].cast("double")
    total = F.aggregate(pairs, F.lit(0.0), lambda s, t: s + t[1].cast("double"))
    fault = F.when(F.size(names) > F.size(F.array_distinct(names)), "repeats").when(F.abs(total - 1) > 1e-9, "sum")
    return table(spark, d, "part").select("p_partkey", of("a").alias("a"), F.when(k > 0, of("b")).alias("b"), fault.alias("fault"))


@query(
    """WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'c' || c_custkey WHEN 1 THEN '@' || lower(c_mktsegment) WHEN 2 THEN 'c@' || c_custkey || '@' || lower(c_mktsegment) ELSE 'c' || c_custkey || '@' || lower(c_mktsegment) END AS address FROM customer)
       SELECT c_custkey, address, len(string_split(address, '@')) = 2 AND split_part(address, '@', 1) <> '' AND split_part(address, '@', 2) <> '' AS valid, CASE WHEN contains(address, '@') THEN list_last(string_split(address, '@')) ELSE address END IN ('building', 'machinery') AS allowed FROM a"""
)
def email_format(spark, d):
    segment, kind = F.lower("c_mktsegment"), F.col("c_custkey") % 4
    whole = F.concat(F.lit("c"), "c_custkey", F.lit("@"), segment)
    address = F.when(kind == 0, F.concat(F.lit("c"), "c_custkey")).when(kind == 1, F.concat(F.lit("@"), segment)).when(kind == 2, F.concat(F.lit("c@"), "c_custkey", F.lit("@"), segment)).otherwise(whole)
    rows = table(spark, d, "customer").select("c_custkey", address.alias("address"))
    return rows.select("*", R.is_email(F.col("address")).alias("valid"), F.substring_index("address", "@", -1).isin("building", "machinery").alias("allowed"))


# Forwarded entries and whether they are routable everywhere.
FORWARDED = {"8.8.4.4": True, "2606:4700::1111": True, "10.1.1.1": False, "100.64.3.2": False, "203.0.113.9": False, "192.168.0.1": False, "fd00::7": False, "2001:db8::1": False, "::1": False, "not-an-address": False, "8.8.8": False, "": False}
_entry = "CASE {} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(FORWARDED)) + " END"
_public = ", ".join(f"'{a}'" for a, public in FORWARDED.items() if public)


@query(
    f"""WITH c AS (SELECT s_suppkey, {_entry.format("s_suppkey % 12")} AS a, {_entry.format("s_suppkey // 12 % 12")} AS b, {_entry.format("s_suppkey // 5 % 12")} AS real_ip FROM supplier)
        SELECT s_suppkey, CASE WHEN b IN ({_public}) THEN b WHEN a IN ({_public}) THEN a WHEN real_ip IN ({_public}) THEN real_ip ELSE 'host-' || s_suppkey END AS picked FROM c"""
)
def ip_pick(spark, d):
    known = F.array(*map(F.lit, FORWARDED))
    entry = lambda n: F.element_at(known, (F.pmod(n, F.lit(len(FORWARDED))) + 1).cast("int"))
    k = F.col("s_suppkey")
    chain = F.concat(entry(k), F.lit(" , "), entry(F.floor(k / 12)))
    return table(spark, d, "supplier").select("s_suppkey", R.client_address(chain, entry(F.floor(k / 5)), F.concat(F.lit("host-"), k)).alias("picked"))


@query("""SELECT n_nationkey, [upper(n_name), 'Zone'] AS tags, len([upper(n_name), 'Zone']) < 3 AS repeated FROM nation""")
def tag_normalise(spark, d):
    given = F.array(F.concat(F.lit(" "), F.upper("n_name")), F.lower("n_name"), F.lit("Zone"), F.lit(""), F.lit("zone "))
    tags = R.first_spelling(given)
    return table(spark, d, "nation").select("n_nationkey", tags.alias("tags"), (F.size(tags) < 3).alias("repeated"))


@query("""SELECT c_custkey, regexp_matches(replace('0' || (7000000000 + c_custkey)::VARCHAR, ' ', ''), '^(07[0-9]{9}|0[12][0-9]{8,9})$') AS phone, list_sort(['mon', 'tue']) = list_sort([CASE WHEN c_custkey % 2 = 0 THEN 'tue' ELSE 'wed' END, 'mon']) AS same_days FROM customer""")
def phone_and_lists(spark, d):
    phone = F.concat(F.lit("0"), (F.lit(7000000000) + F.col("c_custkey")).cast("string"))
    days = F.array(F.when(F.col("c_custkey") % 2 == 0, "tue").otherwise("wed"), F.lit("mon"))
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(phone, " ", "").rlike(r"^(07[0-9]{9}|0[12][0-9]{8,9})$").alias("phone"), (F.array_sort(days) == F.array(F.lit("mon"), F.lit("tue"))).alias("same_days"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN ['region'] ELSE [] END::VARCHAR[] AS changed FROM nation""")
def json_diff(spark, d):
    before = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    after = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.when(F.col("n_regionkey") % 2 == 0, "x").otherwise(F.col("n_regionkey").cast("string")))
    moved = F.map_filter(F.map_zip_with(before, after, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v)
    return table(spark, d, "nation").select("n_nationkey", F.map_keys(moved).alias("changed"))
