"""Queries of decision rules chosen on validation data, baselines over folds, resampled clusters, and lint hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import dataset as D
from strandmill.operators import lint, stats
from strandmill.plans.book import query, sql_hash
from strandmill.plans.evaluation import CELLS, MARGINS, RATE, SUMMARY, A, B, predictions, preds_sql
from strandmill.plans.scalars import EDGE
from strandmill.sources.tables import table

#: Words that stand for signals, among those the documents hold.
SPOKEN = {"nation": ["and", "the"], "time": ["als", "was"], "trade": ["from", "with"]}
CHOSEN = CELLS.replace("predicted", "chosen")


def rules_sql(model: str) -> str:
    """SQL of the margins that model ``model`` selects per head on its validation rows."""
    return f"""w AS (SELECT m.*, example_id % 2 AS head, margin, CASE WHEN predicted = 1 AND s1 - greatest(s0, s2) < margin THEN CASE WHEN s0 >= s2 THEN 0 ELSE 2 END ELSE predicted END AS chosen FROM {model} m, (SELECT unnest({MARGINS}) AS margin) WHERE example_id % 3 = 0),
        wc AS (SELECT head, margin, {CHOSEN} FROM w GROUP BY head, margin), wr AS (SELECT head, margin, {SUMMARY} FROM wc),
        ok AS (SELECT r.* FROM wr r JOIN wr z ON r.head = z.head AND z.margin = 0 WHERE z.null_to_true_rate IS NULL OR r.null_to_true_rate IS NULL OR r.null_to_true_rate <= z.null_to_true_rate + 1e-12),
        rules AS (SELECT head, margin FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY coalesce(macro_f1, -1) DESC, coalesce(null_to_true_rate, 0), margin) AS k FROM ok) WHERE k = 1),
        sc AS (SELECT a.*, CASE example_id % 3 WHEN 1 THEN 'test' ELSE 'holdout' END AS stage, margin, CASE WHEN predicted = 1 AND s1 - greatest(s0, s2) < margin THEN CASE WHEN s0 >= s2 THEN 0 ELSE 2 END ELSE predicted END AS chosen FROM (SELECT *, example_id % 2 AS head FROM a) a JOIN rules USING (head) WHERE example_id % 3 > 0),
        st AS (SELECT head, stage, margin, {CHOSEN}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM sc GROUP BY head, stage, margin) SELECT head, stage, margin, n, effective_n, {SUMMARY} FROM st"""


def _selected(spark, d, model):
    """Margins chosen on ``model``'s validation rows, applied to model a's test and held-out rows."""
    # Odd and even ids stand for two heads.
    at = lambda m, k: predictions(spark, d, m).where(F.col("example_id") % 3 == k).withColumn("head", F.col("example_id") % 2)
    return stats.select_then_score(at(model, 0), {"test": at("a", 1), "holdout": at("a", 2)}, MARGINS, "head")


@query(f"WITH {A}, {rules_sql('a')}")
def select_then_score(spark, d):
    return _selected(spark, d, "a")


@query(f"WITH {A}, {B}, {rules_sql('b')}")
def remargin(spark, d):
    """The same scores decided under margins that another set's validation rows select."""
    return _selected(spark, d, "b")


@query(
    f"""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id), p AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS place FROM u), m AS (SELECT count(*) AS many FROM u),
            dr AS (SELECT r.range AS resample, {sql_hash("'v|' || r.range || '|' || t.range")} % (SELECT many FROM m) AS place FROM range(100) r, range((SELECT many FROM m)) t),
            v AS (SELECT round(sum(errors) / sum(n)::DOUBLE, 6) AS value FROM dr JOIN p USING (place) GROUP BY resample), o AS (SELECT list(value ORDER BY value) AS v FROM v)
       SELECT v[floor(len(v) * 0.025)::BIGINT + 1] AS low, v[ceil(len(v) * 0.975)::BIGINT] AS high, 100 AS resamples, 100 - len(v) AS undefined FROM o"""
)
def cluster_bootstrap(spark, d):
    """Interval of the share of errors over resampled users, of any statistic whose parts add up."""
    units = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    sums = stats.resampled(units, "user_id", ["n", "errors"], 100, "v")
    return stats.interval(sums.select("resample", F.round(F.try_divide("errors", "n"), 6).alias("value")))


C = preds_sql("c", "c")
ARMS = "u AS (SELECT 'a' AS arm, * FROM a UNION ALL SELECT 'b', * FROM b UNION ALL SELECT 'c', * FROM c)"


def _arms(spark, d):
    named = [predictions(spark, d, m).withColumn("arm", F.lit(m)) for m in "abc"]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    f"""WITH {A}, {B}, {C}, {ARMS}, k AS (SELECT arm, subclass, {CELLS} FROM u GROUP BY arm, subclass), r AS (SELECT subclass, max(CASE WHEN arm = 'a' THEN r END) AS a, max(CASE WHEN arm = 'b' THEN r END) AS b, max(CASE WHEN arm = 'c' THEN r END) AS c FROM (SELECT arm, subclass, {RATE} AS r FROM k) GROUP BY subclass)
       SELECT subclass, round(100 * (a - b), 4) AS primary_points, round(100 * (a - c), 4) AS other_points, CASE WHEN a - b > 0 THEN round((a - c) / (a - b), 4) END AS capture, round(abs(100 * (a - b)), 4) AS movement FROM r"""
)
def score_deltas(spark, d):
    """Points by which two arms' null-to-true rates lie below the first arm's, and the share of the primary gain that the other captures: null without a gain."""
    rate = stats.null_to_true_rate()
    rates = _arms(spark, d).groupBy("arm", "subclass").agg(*stats.cells()).select("arm", "subclass", rate.alias("r"))
    wide = rates.groupBy("subclass").pivot("arm", ["a", "b", "c"]).agg(F.max("r"))
    gain, other = F.col("a") - F.col("b"), F.col("a") - F.col("c")
    points = lambda x: F.round(100 * x, 4)
    return wide.select("subclass", points(gain).alias("primary_points"), points(other).alias("other_points"), F.when(gain > 0, F.round(other / gain, 4)).alias("capture"), F.abs(points(gain)).alias("movement"))


@query("SELECT n_name AS arm, CASE WHEN count(s_name) = 1 THEN max(s_name) END AS model, CASE WHEN count(s_name) = 0 THEN 'none' WHEN count(s_name) > 1 THEN 'several' END AS fault FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def arm_lookup(spark, d):
    """The one model whose name ends in ``@arm``, for every nation as an arm; none and several are faults."""
    nations = table(spark, d, "nation")
    models = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("@", "s_name", "n_name").alias("name"))
    per = models.groupBy(F.element_at(F.split("name", "@"), -1).alias("arm")).agg(F.count("*").alias("n"), F.max("name").alias("name"))
    found = nations.select(F.col("n_name").alias("arm")).join(per, "arm", "left")
    return found.select("arm", F.when(F.col("n") == 1, F.element_at(F.split("name", "@"), 1)).alias("model"), F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several").alias("fault"))


@query(
    f"""WITH {A}, {B}, {C}, {ARMS}, h AS (SELECT arm, subclass, example_id, truth = predicted AS ok FROM u WHERE NOT (arm = 'c' AND subclass = 'en' AND example_id % 10 = 0)), n AS (SELECT arm, subclass, count(*) AS n FROM h GROUP BY ALL),
            j AS (SELECT l.arm AS "left", r.arm AS "right", l.subclass, count(*) AS n_common, count(*) FILTER (WHERE l.ok AND NOT r.ok) AS left_only, count(*) FILTER (WHERE r.ok AND NOT l.ok) AS right_only FROM h l JOIN h r ON l.example_id = r.example_id AND l.arm < r.arm GROUP BY ALL)
       SELECT "left", "right", j.subclass, n_common, x.n <> n_common OR y.n <> n_common AS skipped, CASE WHEN x.n = n_common AND y.n = n_common THEN left_only END AS left_only, CASE WHEN x.n = n_common AND y.n = n_common THEN right_only END AS right_only FROM j JOIN n x ON x.arm = "left" AND x.subclass = j.subclass JOIN n y ON y.arm = "right" AND y.subclass = j.subclass"""
)
def cross_pairs_models(spark, d):
    """Every unordered pair of models per slice; pairs over different examples are reported as skipped."""
    rows = _arms(spark, d).where("not (arm = 'c' and subclass = 'en' and example_id % 10 = 0)")
    return stats.cross_pairs(rows, "arm", ["a", "b", "c"], "subclass")


TRUTHS = "l AS (SELECT d.doc_id AS example_id, d.lang, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS truth FROM documents d JOIN labels USING (doc_id)), f AS (SELECT l.*, fold, CASE WHEN example_id % 5 = fold THEN 'test' ELSE 'train' END AS split FROM l, range(3) t(fold)), tr AS (SELECT * FROM f WHERE split = 'train')"


@query(
    f"""WITH {TRUTHS}, a AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY example_id) AS p FROM tr), b AS (SELECT fold, truth AS moved, row_number() OVER (PARTITION BY fold ORDER BY {sql_hash("'q|' || example_id || '-' || fold")}, example_id || '-' || fold) AS p FROM tr),
            t AS (SELECT fold, lang, truth AS class, 'baseline' AS kind FROM tr UNION ALL SELECT fold, lang, moved, 'shuffled' FROM a JOIN b USING (fold, p)),
            c AS (SELECT kind, fold, lang, count(*) FILTER (WHERE class = 0) AS s0, count(*) FILTER (WHERE class = 1) AS s1, count(*) FILTER (WHERE class = 2) AS s2 FROM t GROUP BY ALL),
            h AS (SELECT kind, fold, truth = CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS hit FROM f JOIN c USING (fold, lang) WHERE split = 'test')
       SELECT kind, fold, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS accuracy FROM h GROUP BY kind, fold"""
)
def baseline_folds(spark, d):
    """A language's most frequent class as the baseline of three folds, and its control that learns from permuted labels; all folds in one job."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("example_id"), "lang").join(table(spark, d, "labels").withColumnRenamed("doc_id", "example_id"), "example_id")
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    rows = docs.select("example_id", "lang", truth.alias("truth"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    test = F.col("example_id") % 5 == F.col("fold")
    train = rows.where(~test).withColumn("key", F.concat_ws("-", "example_id", "fold"))
    moved = D.permute_labels(train.select("fold", "example_id", "key", "truth"), "fold", "truth", "key", "q")
    shuffled = moved.join(train.select("key", "lang"), "key").select("fold", "lang", F.col("permuted").alias("class"), F.lit("shuffled").alias("kind"))
    learnt = train.select("fold", "lang", F.col("truth").alias("class"), F.lit("baseline").alias("kind")).unionByName(shuffled)
    best = F.max(F.struct("n", (-F.col("class")).alias("c")))
    models = learnt.groupBy("kind", "fold", "lang", "class").agg(F.count("*").alias("n")).groupBy("kind", "fold", "lang").agg((-best["c"]).alias("predicted"))
    scored = rows.where(test).join(models, ["fold", "lang"])
    return scored.groupBy("kind", "fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def _lines(spark, d):
    """Documents as lines: a third of the sources are fillers, others are about trade; some declare that they never mention time."""
    docs = table(spark, d, "documents")
    filler = F.col("source").like("%1")
    return docs.select(F.col("doc_id").alias("line_id"), F.col("source").alias("library"), F.when(filler, "filler").otherwise("positive").alias("kind"), F.when(~filler, "trade").alias("own_signal"), F.when(F.col("source").like("%2"), F.array(F.lit("time"))).otherwise(F.array()).cast("array<string>").alias("absent"), "text")


def _terms(signal):
    return f"list_filter({sorted(SPOKEN[signal])!r}, lambda t: regexp_matches(lower(text), '{EDGE[0]}' || t || '{EDGE[1]}'))"


HITS = "h AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, doc_id AS line_id, source AS library, {_terms(s)} AS terms FROM documents" for s in sorted(SPOKEN)) + "), k AS (SELECT * FROM h WHERE len(terms) > 0)"


@query(f"WITH {HITS} SELECT * FROM k WHERE NOT (signal = 'trade' AND library NOT LIKE '%1')")
def signal_hits(spark, d):
    return lint.signal_hits(_lines(spark, d), SPOKEN)


@query(f"WITH {HITS} SELECT * FROM k WHERE library LIKE '%1'")
def filler_hits(spark, d):
    return lint.signal_hits(_lines(spark, d), SPOKEN, "filler")


@query(f"WITH {HITS} SELECT * FROM k WHERE library LIKE '%2' AND signal = 'time'")
def absent_hits(spark, d):
    return lint.signal_hits(_lines(spark, d), SPOKEN, "absent")


@query(
    f"""WITH {HITS} SELECT 'signal' AS section, library, count(*) AS findings FROM k WHERE NOT (signal = 'trade' AND library NOT LIKE '%1') GROUP BY library UNION ALL SELECT 'filler', library, count(*) FROM k WHERE library LIKE '%1' GROUP BY library
       UNION ALL SELECT 'absent', library, count(*) FROM k WHERE library LIKE '%2' AND signal = 'time' GROUP BY library UNION ALL SELECT 'hedge', source, count(*) FROM documents WHERE source NOT LIKE '%1' AND len(list_filter({sorted(lint.HEDGES)!r}, lambda t: regexp_matches(lower(text), '{EDGE[0]}' || t || '{EDGE[1]}'))) > 0 GROUP BY source"""
)
def lint_report(spark, d):
    lines = _lines(spark, d)
    return lint.lint_report(*[(which if which != "all" else "signal", lint.signal_hits(lines, SPOKEN, which)) for which in ("all", "filler", "absent")], ("hedge", lint.hedge_hits(lines)))
