"""Queries of evaluation statistics and baselines.

Predictions are bound to the tables: a labelled document's truth is null (2) if toxic, else its
quality; three whole-number scores come from hashes; the resampling unit is the source.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.numbers import argmax, binomial_two_sided, percent_points
from strandmill.functions.text import assign_split, hash_int, token_count
from strandmill.operators import ml, stats
from strandmill.operators.dataset import first_wins
from strandmill.plans.book import query, sql_hash
from strandmill.plans.scalars import NORM
from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table

MARGINS = list(range(0, 950, 50))


def score_sql(salt: str, k: int) -> str:
    return f"({sql_hash(f'd.doc_id || {chr(39)}|{salt}|{k}{chr(39)}')} % 1000)"


def preds_sql(name: str, salt: str) -> str:
    s = [score_sql(salt, k) for k in range(3)]
    s[1] = f"({s[1]} + CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 400 ELSE 0 END)"
    return f"""{name}0 AS (SELECT d.doc_id AS example_id, d.source AS unit, d.source AS library, d.lang AS subclass, CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 1 ELSE 0 END AS truth, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        {name} AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS predicted FROM {name}0)"""


def predictions(spark: SparkSession, d: str, salt: str) -> DataFrame:
    """Prediction rows of the model named by ``salt``; texts are not read."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    score = lambda k: (hash_int(F.concat_ws("|", "doc_id", F.lit(salt), F.lit(str(k)))) % 1000).cast("long")
    lift = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 400).otherwise(0)
    scores = F.array(score(0), score(1) + lift, score(2))
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    named = rows.select(F.col("doc_id").alias("example_id"), F.col("source").alias("unit"), F.col("source").alias("library"), F.col("lang").alias("subclass"), truth.alias("truth"), scores.alias("scores"))
    return named.withColumn("predicted", argmax(F.col("scores")))


CELLS = ", ".join(f"count(*) FILTER (WHERE truth = {t} AND predicted = {p}) AS c{t}{p}" for t in range(3) for p in range(3))
_f1 = lambda k: f"CASE WHEN c{k}0 + c{k}1 + c{k}2 + c0{k} + c1{k} + c2{k} > 0 THEN 2.0 * c{k}{k} / (c{k}0 + c{k}1 + c{k}2 + c0{k} + c1{k} + c2{k}) END"
MACRO = f"list_avg(list_filter([{_f1(0)}, {_f1(1)}, {_f1(2)}], lambda x: x IS NOT NULL))"
ACCURACY = "(c00 + c11 + c22) / nullif(c00 + c01 + c02 + c10 + c11 + c12 + c20 + c21 + c22, 0)::DOUBLE"
RATE = "c21 / nullif(c20 + c21 + c22, 0)::DOUBLE"
SUMMARY = f"round({ACCURACY}, 6) AS accuracy, round({MACRO}, 6) AS macro_f1, round({RATE}, 6) AS null_to_true_rate"
A, B = preds_sql("a", "a"), preds_sql("b", "b")


@query(f"WITH {A} SELECT {CELLS} FROM a")
def confusion_matrix(spark, d):
    return predictions(spark, d, "a").agg(*stats.cells())


@query(
    f"WITH {A}, c AS (SELECT {CELLS} FROM a) "
    + " UNION ALL ".join(f"SELECT {k} AS class, c{k}0 + c{k}1 + c{k}2 AS support, c{k}{k} AS hits, round(c{k}{k} / nullif(c0{k} + c1{k} + c2{k}, 0)::DOUBLE, 6) AS precision, round(c{k}{k} / nullif(c{k}0 + c{k}1 + c{k}2, 0)::DOUBLE, 6) AS recall, round({_f1(k)}, 6) AS f1 FROM c" for k in range(3))
)
def per_class_metrics(spark, d):
    row = []
    for k in stats.CLASSES:
        p, r, f = stats.class_metrics(k)
        support = F.col(f"c{k}0") + F.col(f"c{k}1") + F.col(f"c{k}2")
        row.append(F.struct(F.lit(k).alias("class"), support.alias("support"), F.col(f"c{k}{k}").alias("hits"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")))
    return predictions(spark, d, "a").agg(*stats.cells()).select(F.inline(F.array(*row)))


@query(f"WITH {A}, c AS (SELECT {CELLS}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM a) SELECT n, effective_n, {SUMMARY} FROM c")
def summarise(spark, d):
    return stats.summarise(predictions(spark, d, "a"))


@query(f"WITH {A}, c AS (SELECT library, {CELLS}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM a GROUP BY library) SELECT library, n, effective_n, {SUMMARY} FROM c")
def slice_by_library(spark, d):
    return stats.summarise(predictions(spark, d, "a"), ["library"])


@query(f"WITH {A}, c AS (SELECT subclass, truth AS label_mode, grouping(subclass) AS g, {CELLS}, count(*) AS n FROM a GROUP BY GROUPING SETS ((), (subclass), (truth))) SELECT coalesce(subclass, '-') AS subclass, coalesce(label_mode, -1) AS label_mode, n, round({ACCURACY}, 6) AS accuracy FROM c")
def view(spark, d):
    rows = predictions(spark, d, "a").withColumn("label_mode", F.col("truth"))
    sets = rows.groupingSets([[], ["subclass"], ["label_mode"]], "subclass", "label_mode").agg(*stats.cells(), F.count("*").alias("n"))
    return sets.select(F.coalesce("subclass", F.lit("-")).alias("subclass"), F.coalesce("label_mode", F.lit(-1)).alias("label_mode"), "n", F.round(stats.accuracy(), 6).alias("accuracy"))


@query(f"WITH {A} SELECT library, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS n_correct, round(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 6) AS accuracy, [count(*) FILTER (WHERE predicted = 0), count(*) FILTER (WHERE predicted = 1), count(*) FILTER (WHERE predicted = 2)] AS histogram FROM a GROUP BY library")
def fragment_table(spark, d):
    right = F.col("truth") == F.col("predicted")
    histogram = F.array(*[F.count_if(F.col("predicted") == k) for k in stats.CLASSES])
    return predictions(spark, d, "a").groupBy("library").agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), histogram.alias("histogram"))


@query(
    f"""WITH {A}, g AS (SELECT library, subclass, count(*) FILTER (WHERE truth <> predicted) AS e FROM a GROUP BY library, subclass), r AS (SELECT e, sum(e) OVER (ORDER BY e DESC, library, subclass ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY e DESC, library, subclass) AS place, sum(e) OVER () AS total FROM g WHERE e > 0)
       SELECT count(*) AS groups_with_errors, max(total)::BIGINT AS total_errors, min(CASE WHEN cum * 2 >= total THEN place END) AS groups_carrying_half, round(sum(CASE WHEN place <= 10 THEN e END) / max(total)::DOUBLE, 6) AS share_in_worst_ten, (SELECT count(*) FROM g) AS groups, count(*) / 2.0::DOUBLE AS even_spread_would_be FROM r"""
)
def error_concentration(spark, d):
    rows = predictions(spark, d, "a").groupBy(F.concat_ws("/", "library", "subclass").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("n_correct"))
    return stats.error_concentration(rows, "g")


@query(
    f"""WITH {A}, e AS (SELECT library, count(*) FILTER (WHERE truth <> predicted) AS errors FROM a GROUP BY library)
       SELECT library, errors, sum(errors) OVER (ORDER BY errors DESC, library ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM e"""
)
def cum_error_share(spark, d):
    errors = predictions(spark, d, "a").groupBy("library").agg(F.count_if(F.col("truth") != F.col("predicted")).alias("errors"))
    return errors.withColumn("running", F.sum("errors").over(Window.orderBy(F.col("errors").desc(), "library").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"WITH {A}, {B} SELECT library, round(max(v) - min(v), 6) AS movement FROM (SELECT library, 'a' AS m, avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS v FROM a GROUP BY 1 UNION ALL SELECT library, 'b', avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END) FROM b GROUP BY 1) GROUP BY library HAVING count(*) = 2")
def model_movement(spark, d):
    rows = predictions(spark, d, "a").withColumn("model", F.lit("a")).unionByName(predictions(spark, d, "b").withColumn("model", F.lit("b")))
    per = rows.groupBy("library", "model").agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("v"))
    return per.groupBy("library").agg(F.round(F.max("v") - F.min("v"), 6).alias("movement"), F.count("*").alias("m")).where("m = 2").drop("m")


@query(f"WITH {A} SELECT library, count(*) AS total, count(*) FILTER (WHERE starts_with(subclass, 'e')) AS tagged FROM a GROUP BY library")
def cluster_tag_coverage(spark, d):
    return predictions(spark, d, "a").groupBy("library").agg(F.count("*").alias("total"), F.count_if(F.startswith("subclass", F.lit("e"))).alias("tagged"))


@query(f"WITH {A}, f AS (SELECT subclass, example_id % 5 AS fold, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END) AS v FROM a GROUP BY 1, 2) SELECT subclass, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(v) AS folds FROM f GROUP BY subclass")
def fold_spread(spark, d):
    per = predictions(spark, d, "a").groupBy("subclass", (F.col("example_id") % 5).alias("fold")).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("v"))
    return stats.spread(per, ["subclass"], "v")


GRID = f"g AS (SELECT unnest(range(0, 950, 50)) AS margin), w AS (SELECT a.*, margin, CASE WHEN predicted = 1 AND s1 - greatest(s0, s2) < margin THEN CASE WHEN s0 >= s2 THEN 0 ELSE 2 END ELSE predicted END AS chosen FROM a, g), c AS (SELECT margin, {CELLS.replace('predicted', 'chosen')}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM w GROUP BY margin), r AS (SELECT margin, n, effective_n, {SUMMARY} FROM c)"


@query(f"WITH {A}, {GRID} SELECT * FROM r")
def margin_sweep(spark, d):
    return stats.margin_sweep(predictions(spark, d, "a"), MARGINS)


@query(f"WITH {A}, {GRID} SELECT * FROM r WHERE null_to_true_rate <= (SELECT null_to_true_rate FROM r WHERE margin = 0) + 1e-12 ORDER BY macro_f1 DESC, null_to_true_rate, margin LIMIT 1")
def select_margin(spark, d):
    return stats.select_margin(stats.margin_sweep(predictions(spark, d, "a"), MARGINS))


@query(
    f"""WITH {A}, {B} SELECT count(*) AS n, count(*) FILTER (WHERE a.predicted = a.truth AND b.predicted <> b.truth) AS left_only, count(*) FILTER (WHERE a.predicted <> a.truth AND b.predicted = b.truth) AS right_only FROM a JOIN b USING (example_id)"""
)
def mcnemar_counts(spark, d):
    return stats.paired_counts(predictions(spark, d, "a"), predictions(spark, d, "b"))


@query(
    f"""WITH {A}, {B}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a.predicted = a.truth AND b.predicted <> b.truth) AS left_only, count(*) FILTER (WHERE a.predicted <> a.truth AND b.predicted = b.truth) AS right_only FROM a JOIN b USING (example_id)),
            t AS (SELECT *, left_only + right_only AS m, least(left_only, right_only) AS k FROM c)
       SELECT n, left_only, right_only, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) - m * ln(2.0))))), 6) AS p FROM t"""
)
def mcnemar_exact(spark, d):
    counts = stats.paired_counts(predictions(spark, d, "a"), predictions(spark, d, "b"))
    return counts.withColumn("p", F.round(binomial_two_sided(F.least("left_only", "right_only"), F.col("left_only") + F.col("right_only")), 6))


@query(f"WITH {A}, {B} SELECT a.example_id, a.predicted AS left_predicted, b.predicted AS right_predicted, a.truth AS truth FROM a JOIN b USING (example_id)")
def pair_models(spark, d):
    both = stats.paired(predictions(spark, d, "a"), predictions(spark, d, "b"))
    return both.select("example_id", F.col("left").alias("left_predicted"), F.col("right").alias("right_predicted"), "truth")


@query(
    f"""WITH {A}, u AS (SELECT unit, {CELLS} FROM a GROUP BY unit), p AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS place FROM u), m AS (SELECT count(*) AS many FROM u),
        dr AS (SELECT r.range AS resample, {sql_hash("'b|' || r.range || '|' || t.range")} % (SELECT many FROM m) AS place FROM range(200) r, range((SELECT many FROM m)) t),
        s AS (SELECT resample, {', '.join(f'sum(c{t}{q}) AS c{t}{q}' for t in range(3) for q in range(3))} FROM dr JOIN p USING (place) GROUP BY resample), v AS (SELECT round({ACCURACY}, 6) AS value FROM s), o AS (SELECT list(value ORDER BY value) AS v FROM v)
       SELECT v[floor(len(v) * 0.025)::BIGINT + 1] AS low, v[ceil(len(v) * 0.975)::BIGINT] AS high, 200 AS resamples, 200 - len(v) AS undefined FROM o"""
)
def confusion_bootstrap(spark, d):
    return stats.interval(stats.bootstrap(predictions(spark, d, "a"), 200, F.round(stats.accuracy(), 6)))


@query(
    f"""WITH {A}, {B}, v AS (SELECT subclass, avg(CASE WHEN a.truth = a.predicted THEN 1.0 ELSE 0 END) AS x, avg(CASE WHEN b.truth = b.predicted THEN 1.0 ELSE 0 END) AS y FROM a JOIN b USING (example_id, subclass) GROUP BY subclass)
       SELECT count(*) FILTER (WHERE 100 * (y - x) >= 1.0) >= 1 AS primary_held, round(100 * avg(y - x), 4) AS guard_points, round(max(abs(100 * (y - x))), 4) AS worst_movement FROM v"""
)
def score_criteria(spark, d):
    left, right = predictions(spark, d, "a"), predictions(spark, d, "b")
    both = left.select("example_id", "subclass", (F.col("truth") == F.col("predicted")).cast("int").alias("x")).join(right.select("example_id", (F.col("truth") == F.col("predicted")).cast("int").alias("y")), "example_id")
    per = both.groupBy("subclass").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("points", percent_points(F.col("y"), F.col("x")))
    return per.agg((F.count_if(F.col("points") >= 1.0) >= 1).alias("primary_held"), F.round(F.avg("points"), 4).alias("guard_points"), F.round(F.max(F.abs("points")), 4).alias("worst_movement"))


@query("WITH l AS (SELECT source, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS truth FROM documents JOIN labels USING (doc_id)) SELECT truth, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS prior FROM l GROUP BY truth")
def majority_model(spark, d):
    return ml.class_prior(predictions(spark, d, "a"), "truth")


@query("SELECT doc_id, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9'']+'))::DOUBLE AS n FROM documents)")
def standardise(spark, d):
    rows = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).cast("double").alias("z"))
    return ml.standardised(rows, "z").select("doc_id", F.round("z", 6).alias("z"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN [0.7, 0.0, 0.3] ELSE [0.0, 0.7, 0.3] END::DOUBLE[] AS scores FROM labels")
def expand_scores(spark, d):
    """Scores of a model that never saw one of the classes, with 0 for that class."""
    return table(spark, d, "labels").select("doc_id", ml.expanded(F.array(F.lit(0.7), F.lit(0.3)), F.array(F.col("quality"), F.lit(2)), 3).alias("scores"))


@query(f"WITH {A}, f AS (SELECT CASE WHEN truth = 2 THEN example_id % 4 ELSE example_id % 5 END AS fold, count(*) FILTER (WHERE truth = 2) AS support, count(*) FILTER (WHERE truth = 2 AND predicted = 1) AS hits FROM a GROUP BY 1) SELECT fold, support, round(hits / nullif(support, 0)::DOUBLE, 6) AS rate FROM f")
def holdout_rates(spark, d):
    """Null-to-true rate per fold; null for a fold without support."""
    rows = predictions(spark, d, "a").withColumn("fold", F.col("example_id") % F.when(F.col("truth") == 2, 4).otherwise(5))
    cells = rows.groupBy("fold").agg(*stats.cells()).withColumn("support", F.col("c20") + F.col("c21") + F.col("c22"))
    return cells.select("fold", "support", F.round(stats.null_to_true_rate(), 6).alias("rate"))


@query(f"WITH {A}, {B}, r AS (SELECT a.library, count(*) FILTER (WHERE a.predicted <> a.truth AND b.predicted = b.truth) + count(*) FILTER (WHERE a.predicted = a.truth AND b.predicted <> b.truth) AS discordant FROM a JOIN b USING (example_id) GROUP BY a.library) SELECT library, discordant, rank() OVER (ORDER BY discordant DESC) AS worst FROM r")
def discordance_sort(spark, d):
    """Libraries by how often two models differ in being right, worst first; the ranks run over one row a library."""
    left = predictions(spark, d, "a")
    both = stats.paired(left, predictions(spark, d, "b")).join(left.select("example_id", "library"), "example_id")
    differs = (F.col("truth") == F.col("left")) != (F.col("truth") == F.col("right"))
    per = both.groupBy("library").agg(F.count_if(differs).alias("discordant"))
    return per.withColumn("worst", F.rank().over(Window.orderBy(F.col("discordant").desc())))


@query(f"WITH {A}, {B}, u AS (SELECT 'a' AS arm, subclass, truth, predicted FROM a UNION ALL SELECT 'b', subclass, truth, predicted FROM b), c AS (SELECT arm, subclass, {CELLS} FROM u GROUP BY arm, subclass) SELECT arm, subclass, round({ACCURACY}, 6) AS accuracy, round(c00 / nullif(c00 + c01 + c02, 0)::DOUBLE, 6) AS recall_false, round(c11 / nullif(c10 + c11 + c12, 0)::DOUBLE, 6) AS recall_true, round(c22 / nullif(c20 + c21 + c22, 0)::DOUBLE, 6) AS recall_null, c10 + c11 + c12 AS n_true FROM c")
def collapse_table(spark, d):
    """Accuracy, recall by class and label counts per arm and slice."""
    rows = predictions(spark, d, "a").withColumn("arm", F.lit("a")).unionByName(predictions(spark, d, "b").withColumn("arm", F.lit("b")))
    recall = [F.round(stats.class_metrics(k)[1], 6).alias(f"recall_{name}") for k, name in ((0, "false"), (1, "true"), (2, "null"))]
    return rows.groupBy("arm", "subclass").agg(*stats.cells()).select("arm", "subclass", F.round(stats.accuracy(), 6).alias("accuracy"), *recall, (F.col("c10") + F.col("c11") + F.col("c12")).alias("n_true"))


@query()
def length_model(spark, d):
    return ml.length_scores(*_split(spark, d))


@query()
def tfidf_model(spark, d):
    return ml.tfidf_scores(*_split(spark, d))


@query()
def baseline_runs(spark, d):
    """Three baselines and their controls over three folds of the labelled documents; classes are those of the predictions."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    rows = docs.select("doc_id", "text", truth.alias("label"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    return ml.baseline_runs(rows.withColumn("split", F.when(F.col("doc_id") % 5 == F.col("fold"), "test").otherwise("train")), [0, 1, 2])


def _split(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select("doc_id", "text", F.col("quality").cast("double").alias("label"), assign_split(F.col("doc_id"), "ml").alias("split"))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


DIMS = 64
_means = ", ".join(f"round(coalesce(sum(CASE WHEN label % 2 = 0 THEN embedding[{i}]::DOUBLE END), 0) / greatest(count(*) FILTER (WHERE label % 2 = 0), 1), 5) AS m{i}" for i in range(1, DIMS + 1))


@query(f"SELECT vec_id // 16 AS chunk, {_means} FROM embeddings GROUP BY 1")
def mean_pool(spark, d):
    """Vectors as tokens of chunks of 16; those with odd labels are padding."""
    tokens = table(spark, d, "embeddings").withColumn("chunk", F.floor(F.col("vec_id") / 16))
    pooled = ml.mean_pooled(tokens, "chunk", "embedding", F.when(F.col("label") % 2 == 0, 1).otherwise(0), DIMS)
    return pooled.select("chunk", *[F.round(F.element_at("mean", i), 5).alias(f"m{i}") for i in range(1, DIMS + 1)])


@query("SELECT vec_id // 16 AS chunk, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY 1")
def cls_pool(spark, d):
    tokens = table(spark, d, "embeddings").withColumn("chunk", F.floor(F.col("vec_id") / 16))
    return ml.first_pooled(tokens, "chunk", "embedding", "vec_id")


_heads = ", ".join(f"round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: embedding[i]::DOUBLE * (((i + {k}) % 3) - 1))) + {k} / 2, 5) AS s{k}" for k in range(3))


@query(f"WITH h AS (SELECT vec_id, {_heads} FROM embeddings) SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS predicted FROM h")
def linear_head(spark, d):
    """A head of three outputs and its decision."""
    weights = [[(i + k) % 3 - 1.0 for i in range(1, DIMS + 1)] for k in range(3)]
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(ml.linear_heads(F.col("embedding"), weights, [0.0, 0.5, 1.0]), lambda s: F.round(s, 5)).alias("scores"))
    return rows.select("vec_id", *[F.element_at("scores", k + 1).alias(f"s{k}") for k in range(3)], argmax(F.col("scores")).alias("predicted"))


_outputs = ", ".join(f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: embedding[i]::DOUBLE * (((i + {k} + h) % 3) - 1))) + ({k} + h) / 4" for k in range(3))


@query(
    f"""WITH f AS (SELECT vec_id, 'h' || h AS head, (label + h) % 3 AS truth, [{_outputs}] AS s FROM embeddings, (SELECT unnest(range(3)) AS h) WHERE (vec_id + h) % 3 <> 0 AND label IS NOT NULL)
       SELECT vec_id, head, truth, round(s[1], 5) AS s0, round(s[2], 5) AS s1, round(s[3], 5) AS s2, CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN 0 WHEN s[2] >= s[3] THEN 1 ELSE 2 END AS predicted FROM f"""
)
def multi_head_predict(spark, d):
    """Three heads over the vectors in one pass; every vector is labelled for two of them."""
    heads = {f"h{h}": ([[(i + k + h) % 3 - 1.0 for i in range(1, DIMS + 1)] for k in range(3)], [(k + h) / 4 for k in range(3)]) for h in range(3)}
    told = F.map_from_entries(F.array(*[F.struct(F.lit(f"h{h}"), F.when((F.col("vec_id") + h) % 3 != 0, (F.col("label") + h) % 3)) for h in range(3)]))
    rows = ml.multi_head(table(spark, d, "embeddings").withColumn("labels", told), "embedding", heads, "labels", ["vec_id"])
    return rows.select("vec_id", "head", "truth", *[F.round(F.element_at("scores", k + 1), 5).alias(f"s{k}") for k in range(3)], "predicted")


@query(
    """WITH c AS (SELECT doc_id, 0 AS s, quality AS t FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 1, toxic FROM documents LEFT JOIN labels USING (doc_id)),
       l AS (SELECT t, (doc_id * 3 + s) % 11 / 5.0 AS a, (doc_id * 4 + s) % 11 / 5.0 AS b, (doc_id * 5 + s) % 11 / 5.0 AS e FROM c)
       SELECT round(avg(ln(exp(a) + exp(b) + exp(e)) - CASE t WHEN 0 THEN a WHEN 1 THEN b END), 6) AS loss, count(t) AS labelled, count(*) - count(t) AS masked FROM l"""
)
def masked_xent(spark, d):
    """Loss of two heads over documents of which few are labelled."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    cells = rows.select("doc_id", F.posexplode(F.array("quality", "toxic")).alias("signal", "target"))
    scores = F.array(*[(F.col("doc_id") * k + F.col("signal")) % 11 / 5 for k in (3, 4, 5)])
    return ml.masked_cross_entropy(cells, scores, F.col("target")).withColumn("loss", F.round("loss", 6))


@query()
def train_probe(spark, d):
    """Labels of the held-out vectors by a probe of the others, with the passes that suit the validation split."""
    rows = table(spark, d, "embeddings").withColumn("split", assign_split(F.col("vec_id"), "probe"))
    model, passes, _ = ml.train_probe(rows.where("split = 'train'"), rows.where("split = 'val'"), "embedding", "label")
    held = rows.where("split = 'test' and embedding is not null").withColumn("features", array_to_vector("embedding"))
    return model.transform(held).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"), F.lit(passes).alias("passes"))


@query("SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS tokens FROM documents")
def embed_cache(spark, d):
    """Vectors of documents from a cache that holds those of the benchmark already."""
    folder = fresh_path(spark, "vectors-of-lengths")
    lengths = lambda t: F.array(F.length(t).cast("double"), token_count(t).cast("double"))
    ml.embedded(table(spark, d, "benchmark"), "text", lengths, folder)
    rows = ml.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", lengths, folder)
    return rows.select("doc_id", F.element_at("vector", 1).cast("long").alias("chars"), F.element_at("vector", 2).cast("long").alias("tokens"))


@query(f"WITH {A}, e AS (SELECT example_id % 10 + 1 AS epoch, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END), 6) AS score FROM a GROUP BY 1) SELECT epoch AS best_epoch, score FROM e ORDER BY score DESC, epoch LIMIT 1")
def epoch_select(spark, d):
    per = predictions(spark, d, "a").groupBy((F.col("example_id") % 10 + 1).alias("epoch")).agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), 6).alias("score"))
    return per.agg(F.max(F.struct("score", (-F.col("epoch")).alias("e"))).alias("m")).select((-F.col("m.e")).alias("best_epoch"), F.col("m.score").alias("score"))


@query(
    f"""WITH {A}, h AS (SELECT example_id, 'quality' AS signal, CASE truth WHEN 1 THEN 'true' WHEN 0 THEN 'false' ELSE 'null' END AS state FROM a UNION ALL SELECT example_id, 'even', CASE WHEN example_id % 2 = 0 THEN 'true' ELSE 'omitted' END FROM a)
       SELECT signal, count(*) FILTER (WHERE state = 'true') AS "true", count(*) FILTER (WHERE state = 'false') AS "false", count(*) FILTER (WHERE state = 'null') AS "null", count(*) FILTER (WHERE state = 'omitted') AS omitted FROM h GROUP BY signal"""
)
def holdout_distribution(spark, d):
    quality = F.when(F.col("truth") == 1, "true").when(F.col("truth") == 0, "false").otherwise("null")
    wide = predictions(spark, d, "a").select("example_id", quality.alias("quality"), F.when(F.col("example_id") % 2 == 0, "true").otherwise("omitted").alias("even"))
    return wide.unpivot(["example_id"], ["quality", "even"], "signal", "state").groupBy("signal").pivot("state", ["true", "false", "null", "omitted"]).count().fillna(0)


FLAG_A = preds_sql("p", "a")


@query(
    f"""WITH n AS (SELECT doc_id, source, lang, {sql_hash("'f:' || doc_id")} % 100 AS b, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS r FROM documents), {FLAG_A},
        j AS (SELECT p.*, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM p JOIN n ON p.example_id = n.doc_id WHERE n.r = 1),
        c AS (SELECT split, subclass, {CELLS}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM j GROUP BY split, subclass) SELECT split, subclass, n, effective_n, {SUMMARY} FROM c"""
)
def flagship(spark, d):
    """Split deduplicated labelled documents by stable hash, decide by score, and report metrics per split and language."""
    first = first_wins(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select(F.col("doc_id").alias("example_id"), assign_split(F.col("doc_id"), "f").alias("split"))
    return stats.summarise(predictions(spark, d, "a").join(first, "example_id"), ["split", "subclass"])
