"""Queries of example construction: companions, fragments, folds, lexicons of noise and what a merge holds.

Parts are fragments and brands their libraries: of every five brands two are fillers, two companions of
one of three signals, and one decisive, its parts by turns positive, negative and ambiguous. Orders are examples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.text import hash_int
from strandmill.operators import dataset as D
from strandmill.operators import recombination as M
from strandmill.operators import reports as R
from strandmill.plans.book import query, sql_hash
from strandmill.sources.tables import table

SIGNALS = ["s0", "s1", "s2"]
WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in M.STRUCTURAL_WORDS)
FILLERS = [f"Brand#{b}" for b in range(1, 26) if b % 5 < 2]


def _pools(spark, d):
    """The decisive, companion and filler pools over all parts."""
    brand = F.element_at(F.split("p_brand", "#"), 2).cast("int")
    rows = table(spark, d, "part").select(F.lit("all").alias("scope"), brand.alias("b"), F.col("p_brand").alias("library"), F.col("p_partkey").alias("fragment_id"))
    take = lambda kept, group: rows.where(kept).select("scope", group.alias("group"), "library", "fragment_id")
    role = F.element_at(F.array(*map(F.lit, ("positive", "negative", "ambiguous"))), (F.col("fragment_id") % 3 + 1).cast("int"))
    return take(F.col("b") % 5 == 4, role), take((F.col("b") % 5).isin(2, 3), F.concat(F.lit("s"), F.col("b") % 3)), take(F.col("b") % 5 < 2, F.col("library"))


def _examples(spark, d):
    key = F.col("o_orderkey").cast("string")
    mode = D.label_mode(D.uniform(key, F.lit("m")), D.uniform(key, F.lit("n")))
    return table(spark, d, "orders").select(F.lit("all").alias("scope"), F.col("o_orderkey").alias("example_id"), mode.alias("mode"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("fragments"))


U = lambda key: f"{sql_hash(key)} / 4294967296.0::DOUBLE"
POOL = """b AS (SELECT p_partkey AS fragment_id, p_brand AS library, replace(p_brand, 'Brand#', '')::INT AS b FROM part),
    pool AS (SELECT CASE WHEN b % 5 = 4 THEN 'd' WHEN b % 5 < 2 THEN 'f' ELSE 'c' END AS kind, CASE WHEN b % 5 = 4 THEN ['positive', 'negative', 'ambiguous'][fragment_id % 3 + 1] WHEN b % 5 < 2 THEN library ELSE 's' || b % 3 END AS grp, library, fragment_id FROM b),
    pl AS (SELECT *, row_number() OVER (PARTITION BY kind, grp, library ORDER BY fragment_id) AS place FROM pool),
    li AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY library) AS k, count(*) OVER (PARTITION BY kind, grp) AS n FROM (SELECT kind, grp, library, count(*) AS many FROM pool GROUP BY ALL))"""
SPEC = f"""e AS (SELECT o_orderkey AS example_id, CASE WHEN {U("o_orderkey || '|m'")} < 0.35 THEN 'true' WHEN {U("o_orderkey || '|m'")} < 0.7 THEN 'false' WHEN {U("o_orderkey || '|n'")} < 0.5 THEN 'null_ambiguous' ELSE 'null_structural' END AS mode, o_orderkey % 3 + 2 AS fragments FROM orders),
    sp AS (SELECT *, len(list_filter(range(1, fragments), lambda i: i <= 3 AND {U("example_id || '|rn|' || i")} < 0.5)) AS companions FROM e),
    g AS (SELECT example_id, 'd' AS kind, CASE mode WHEN 'true' THEN 'positive' WHEN 'false' THEN 'negative' ELSE 'ambiguous' END AS grp FROM sp WHERE mode <> 'null_structural'
          UNION ALL SELECT example_id, 'c', grp FROM (SELECT example_id, companions, grp, row_number() OVER (PARTITION BY example_id ORDER BY {sql_hash("example_id || '|rc|group|' || grp")}, grp) AS r FROM sp, (SELECT unnest({SIGNALS!r}) AS grp)) WHERE r <= companions
          UNION ALL SELECT example_id, 'f', grp FROM (SELECT example_id, fragments - companions - CASE WHEN mode = 'null_structural' THEN 0 ELSE 1 END AS rest, grp, row_number() OVER (PARTITION BY example_id ORDER BY {sql_hash("example_id || '|rf|group|' || grp")}, grp) AS r FROM sp, (SELECT unnest({FILLERS!r}) AS grp)) WHERE r <= rest),
    dr AS (SELECT g.example_id, g.kind, g.grp, li.library, {sql_hash("g.example_id || '|r' || g.kind || '|fragment|' || g.grp")} % li.many + 1 AS place FROM g JOIN li ON g.kind = li.kind AND g.grp = li.grp AND li.k = {sql_hash("g.example_id || '|r' || g.kind || '|library|' || g.grp")} % li.n + 1),
    ch AS (SELECT example_id, dr.kind, dr.grp, dr.library, fragment_id FROM dr JOIN pl USING (kind, grp, library, place))"""


@query(f"WITH {POOL}, {SPEC} SELECT example_id, grp AS signal, library, fragment_id FROM ch WHERE kind = 'c'")
def draw_companion(spark, d):
    """Companions of every example: signal first, no signal twice."""
    low, high = D.companion_bounds(F.col("fragments"), len(SIGNALS), len(FILLERS))
    wanted = _examples(spark, d).withColumn("companions", D.companion_count(low, high.cast("int"), 0.5, F.col("example_id").cast("string"), F.lit("rn")))
    return M.draw_companions(wanted, _pools(spark, d)[1], SIGNALS, "r").select("example_id", F.col("group").alias("signal"), "library", "fragment_id")


@query(f"WITH {POOL}, {SPEC} SELECT example_id, any_value(mode) AS mode, any_value(companions)::INT AS companions, list(fragment_id ORDER BY {sql_hash("example_id || '|r|order|' || fragment_id")}, fragment_id) AS fragment_ids FROM sp JOIN ch USING (example_id) GROUP BY example_id")
def select_fragments(spark, d):
    return M.select_fragments(_examples(spark, d), *_pools(spark, d), SIGNALS, FILLERS, "r").drop("scope")


SEEDED = f"""r AS (SELECT fold, split, i, fold || '/' || split AS scope, (7 + 100 * fold + CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) || '-' || i AS example_id FROM range(3) a(fold), (VALUES ('train'), ('val'), ('test')) s(split), range(200) c(i)),
    w AS (SELECT *, ['positive', 'negative', 'ambiguous'][i % 3 + 1] AS grp FROM r)"""


@query(
    f"""WITH b AS (SELECT p_partkey AS fragment_id, p_brand AS library, {sql_hash('p_partkey::VARCHAR')} % 3 AS bucket FROM part),
            pool AS (SELECT fold || '/' || CASE WHEN bucket = fold THEN 'test' WHEN bucket = (fold + 1) % 3 THEN 'val' ELSE 'train' END AS scope, ['positive', 'negative', 'ambiguous'][fragment_id % 3 + 1] AS grp, library, fragment_id FROM b, range(3) a(fold)),
            pl AS (SELECT *, row_number() OVER (PARTITION BY scope, grp, library ORDER BY fragment_id) AS place FROM pool),
            li AS (SELECT *, row_number() OVER (PARTITION BY scope, grp ORDER BY library) AS k, count(*) OVER (PARTITION BY scope, grp) AS n FROM (SELECT scope, grp, library, count(*) AS many FROM pool GROUP BY ALL)),
            {SEEDED}, dr AS (SELECT w.scope, w.example_id, w.grp, li.library, {sql_hash("w.example_id || '|k|fragment|' || w.grp")} % li.many + 1 AS place FROM w JOIN li ON w.scope = li.scope AND w.grp = li.grp AND li.k = {sql_hash("w.example_id || '|k|library|' || w.grp")} % li.n + 1)
       SELECT scope, example_id, fragment_id FROM dr JOIN pl USING (scope, grp, library, place)"""
)
def generate_folds(spark, d):
    """Three folds of three splits in one job; every run has its own seed, and draws from its own split's pools."""
    fold, names = F.col("fold"), ("train", "val", "test")
    bucket = hash_int(F.col("p_partkey")) % 3
    parts = table(spark, d, "part").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    split = F.when(bucket == fold, "test").when(bucket == (fold + 1) % 3, "val").otherwise("train")
    role = F.element_at(F.array(*map(F.lit, ("positive", "negative", "ambiguous"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    pool = parts.select(F.concat_ws("/", "fold", split).alias("scope"), role.alias("group"), F.col("p_brand").alias("library"), F.col("p_partkey").alias("fragment_id"))
    runs = [(f"{f}/{s}", str(7 + 100 * f + i)) for f in range(3) for i, s in enumerate(names)]
    run = F.explode(F.array(*[F.struct(F.lit(a).alias("scope"), F.lit(b).alias("seed")) for a, b in runs]))
    drawn = F.element_at(F.array(*map(F.lit, ("positive", "negative", "ambiguous"))), (F.col("id") % 3 + 1).cast("int"))
    wanted = spark.range(200).select("id", run.alias("run")).select(F.col("run.scope").alias("scope"), F.concat_ws("-", "run.seed", "id").alias("example_id"), F.array(drawn).alias("groups"))
    return M.draw_fragments(wanted, pool, "k").select("scope", "example_id", "fragment_id")


@query("SELECT CASE WHEN toxic = 1 THEN 'null' WHEN quality = 1 THEN 'true' ELSE 'false' END AS mode, signal, value, count(*) AS n FROM labels, LATERAL (SELECT unnest(['quality', 'toxic']) AS signal, unnest([quality, toxic]) AS value) GROUP BY ALL")
def merge_realised(spark, d):
    """What a merged set holds: label modes by signal and value."""
    rows = table(spark, d, "labels")
    mode = F.when(F.col("toxic") == 1, "null").when(F.col("quality") == 1, "true").otherwise("false")
    long = rows.select(mode.alias("mode"), "quality", "toxic").unpivot(["mode"], ["quality", "toxic"], "signal", "value")
    return long.groupBy("mode", "signal", "value").agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT DISTINCT p_brand AS signal, lower(unnest(string_split(p_name, ' '))) AS word FROM part UNION SELECT DISTINCT p_brand, unnest([{WORDS}]) FROM part)
       SELECT signal, word, CASE WHEN word IN ({WORDS}) OR length(word) <= 5 THEN 'frozen' ELSE 'damageable' END AS state FROM w"""
)
def noise_lexicon(spark, d):
    """Names of parts as terms of their brand."""
    return M.noise_lexicon(table(spark, d, "part").select(F.col("p_brand").alias("signal"), F.col("p_name").alias("term")))


def _reports(spark, d):
    """A report for every customer, of three shapes: without a held-out block, with a null one, and with figures from the balance; some lack classes or comparisons."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = lambda c: F.col(c).cast("string")
    rate = lambda n: F.concat(F.lit("0."), F.lpad((F.col("c_custkey") % n).cast("string"), 3, "0"))
    recall = F.when(k % 4 == 0, '{"true": {"mean": null}}').otherwise(F.concat(F.lit('{"true": {"mean": '), rate(97), F.lit('}, "null": {"mean": '), rate(31), F.lit("}}")))
    row = F.concat(F.lit('{"signal": "other"}, {"signal": "'), name, F.lit('", "null_to_true": {"mean_rate": '), rate(89), F.lit('}, "decisive": {"accuracy": {"mean": '), text("c_acctbal"), F.lit('}}, "per_class_recall": '), recall, F.lit(', "distribution": {"true": '), text("c_nationkey"), F.lit("}}"))
    block = F.when(k % 3 == 0, "").when(k % 3 == 1, ', "holdout": null').otherwise(F.concat(F.lit(', "holdout": {"overall": {"accuracy": {"mean": '), rate(83), F.lit('}}, "by_signal": ['), row, F.lit("]}")))
    arm = lambda label: F.concat(F.lit('{"name": "m@x@'), F.lit(label), F.lit('"'), block if label == "arm_p" else F.lit(""), F.lit(', "pooled": {"ruled": {"null_to_true": {"rate": '), rate(79), F.lit("}}}}"))
    sides = F.when(k % 5 == 0, '"left": "m@arm_p", "right": "m@arm_0"').when(k % 5 == 1, '"left": "m@arm_c", "right": "m@arm_0"').otherwise('"left": "m@arm_0", "right": "arm_p"')
    pairs = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(', "holdout_comparisons": [{"left": "a", "right": "b"}, {'), sides, F.lit(', "p": '), rate(73), F.lit("}]")))
    report = F.concat(F.lit('{"header": {"signal": "'), name, F.lit('"}, "models": ['), arm("arm_0"), F.lit(", "), arm("arm_p"), F.lit("]"), pairs, F.lit("}"))
    return table(spark, d, "customer").select(text("c_custkey").alias("path"), report.alias("report"))


def _rate(n: int) -> str:
    return f"(c_custkey % {n}) / 1000.0::DOUBLE"


@query(
    f"""SELECT c_custkey::VARCHAR AS path, k % 7 <> 0 AND k % 5 <> 1 AS found, CASE WHEN k % 7 = 0 OR k % 5 = 1 THEN NULL WHEN k % 5 = 0 THEN 'm@arm_p' ELSE 'm@arm_0' END AS "left", CASE WHEN k % 7 = 0 OR k % 5 = 1 THEN NULL WHEN k % 5 = 0 THEN 'm@arm_0' ELSE 'arm_p' END AS "right",
       CASE WHEN k % 7 <> 0 AND k % 5 <> 1 THEN round({_rate(73)}, 6) END AS p FROM (SELECT *, c_custkey AS k FROM customer)"""
)
def paired_row_lookup(spark, d):
    """The comparison of two arms in every report, whichever comes first."""
    return R.paired_rows(_reports(spark, d), "arm_0", "arm_p").withColumn("p", F.round("p", 6))


@query(
    f"""WITH c AS (SELECT *, c_custkey % 3 = 2 AND arm = 'arm_p' AS scored FROM customer, (SELECT unnest(['arm_0', 'arm_p']) AS arm))
       SELECT c_custkey::VARCHAR AS path, c_name AS signal, arm, scored, CASE WHEN scored THEN round({_rate(89)}, 6) END AS null_to_true, CASE WHEN scored THEN round(c_acctbal::DOUBLE, 6) END AS decisive, CASE WHEN scored AND c_custkey % 4 <> 0 THEN round({_rate(97)}, 6) END AS recall_true, NULL::DOUBLE AS recall_false,
              CASE WHEN scored AND c_custkey % 4 <> 0 THEN round({_rate(31)}, 6) END AS recall_null, CASE WHEN scored THEN round({_rate(83)}, 6) END AS accuracy, round({_rate(79)}, 6) AS synthetic_null_to_true, CASE WHEN scored THEN c_nationkey::BIGINT END AS n_true FROM c"""
)
def read_signal_scores(spark, d):
    """Nested reports as one row an arm; what a report lacks is null."""
    rows = R.signal_scores(_reports(spark, d), ["arm_0", "arm_p"])
    numbers = [c for c, t in rows.dtypes if t == "double"]
    return rows.select(*[c for c in rows.columns if c not in numbers], *[F.round(c, 6).alias(c) for c in numbers])
