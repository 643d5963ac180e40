"""Queries of fold loading, library declarations and held-out scoring.

Parts are bound as fragments (clusters are brands; every 97th part is placed by itself and so breaks
the partition), documents as submissions that judges labelled for two signals, of which some cells are blank.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import functions as F

from strandmill.functions.text import hash_int
from strandmill.operators import folds as L
from strandmill.operators import holdout as H
from strandmill.operators import stats
from strandmill.plans.book import query, sql_hash
from strandmill.plans.evaluation import ACCURACY, CELLS, MACRO, SUMMARY
from strandmill.sources.shared import fresh_path
from strandmill.sources.tables import table, tasks_for
from strandmill.sources.tree import load_tree, read_sidecars, tree_violations, write_tree

FOLDS = 5
MODELS = [0, 1, 2]
HELD_MARGINS = {"quality": 50, "toxic": 200}


CONFIGURATION = {"generator_version": "2", "signal": "urgent", "split_salt": "s"}


def _placed(bucket):
    """(fold, split) of every fold for a cluster's bucket."""
    split = lambda k: F.when(bucket == k, "test").when(bucket == (k + 1) % FOLDS, "val").otherwise("train")
    return F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), split(k).alias("split")) for k in range(FOLDS)]))


def _tree(spark, d):
    """A written tree: orders as examples, their customers as fragments; the path."""
    placed = lambda rows: rows.select("*", _placed(hash_int(F.col("o_custkey").cast("string")) % FOLDS).alias("at")).select("*", "at.*")
    given = table(spark, d, "orders")
    orders = placed(given)
    labels = F.create_map(F.lit("urgent"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority") < "3"), F.lit("open"), F.col("o_orderstatus") == "O")
    labels = F.when(F.col("o_orderstatus") == "P", F.map_filter(labels, lambda k, v: k == "urgent")).otherwise(labels)
    text = lambda c: F.col(c).cast("string")
    examples = orders.select("fold", "split", text("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("text"), labels.alias("labels"), F.array(text("o_custkey")).alias("fragment_ids"))
    fragments = placed(given.select("o_custkey").distinct()).select("fold", "split", text("o_custkey").alias("fragment_id"), text("o_custkey").alias("cluster_key"))
    root = fresh_path(spark, "fold-tree")
    write_tree(examples, fragments, root, CONFIGURATION, ["urgent", "open"], FOLDS)
    return root


@query(
    f"""WITH o AS (SELECT *, {sql_hash("o_custkey::VARCHAR")} % {FOLDS} AS bucket FROM orders), x AS (SELECT o.*, fold, CASE WHEN bucket = fold THEN 'test' WHEN bucket = (fold + 1) % {FOLDS} THEN 'val' ELSE 'train' END AS split FROM o, (SELECT unnest(range({FOLDS})) AS fold))
       SELECT fold::INT AS fold, split, count(*) AS n, count(*) AS recorded, count(*) FILTER (WHERE o_orderpriority < '3') AS urgent, count(*) FILTER (WHERE o_orderpriority < '3') AS recorded_urgent, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS recorded_null, count(*) FILTER (WHERE o_orderstatus = 'O') AS recorded_open FROM x GROUP BY fold, split"""
)
def scan_fold_tree(spark, d):
    """A tree written, checked and read back: counts of its examples beside those in its sidecars."""
    root = _tree(spark, d)
    read = load_tree(spark, root, FOLDS).groupBy("fold", "split").agg(F.count("*").alias("n"), F.count_if(F.element_at("labels", "urgent")).alias("urgent"))
    at = lambda p: F.get_json_object("stats", f"$.{p}").cast("long")
    told = read_sidecars(spark, root).select("fold", "split", at("count").alias("recorded"), at("labels.urgent.true").alias("recorded_urgent"), at("labels.urgent.null").alias("recorded_null"), at("labels.open.true").alias("recorded_open"))
    return read.join(told, ["fold", "split"])


@query(
    f"""WITH o AS (SELECT *, {sql_hash("o_custkey::VARCHAR")} % {FOLDS} AS bucket FROM orders), bad AS (SELECT o_orderkey % 2 AS kind FROM o WHERE bucket = 0)
       SELECT * FROM (VALUES ('sidecar_key_missing', '3/val/split_salt'), ('sidecar_not_json', '4/val'), ('file_missing', '4/val'), ('split_differs_from_path', '1/val'), ('fold_differs_from_path', '2/test'), ('number_of_folds', '0/val'), ('configuration_differs_within_fold', '0'), ('configuration_differs_within_fold', '3'), ('salt_differs_between_folds', 'all'), ('count_differs', '0/test')) t("check", key)
       UNION ALL SELECT 'line', 'fold=0/split=test: ' || CASE kind WHEN 0 THEN 'not valid JSON' ELSE 'not a JSON object' END FROM bad"""
)
def scan_sidecar(spark, d):
    """The tree with one fault of each kind in its sidecars, and with a broken line for every order of one split."""
    root = _tree(spark, d)
    store, path = fs.FileSystem.from_uri(root)

    def rewrite(place: str, change) -> None:
        with store.open_input_stream(f"{path}/stats/{place}/stats.json") as given:
            stats = json.loads(given.read())
        with store.open_output_stream(f"{path}/stats/{place}/stats.json") as out:
            out.write(change(stats).encode())

    rewrite("fold=3/split=val", lambda x: json.dumps({k: v for k, v in x.items() if k != "split_salt"}))
    rewrite("fold=4/split=val", lambda x: "[1]")
    rewrite("fold=1/split=val", lambda x: json.dumps(x | {"split": "train"}))
    rewrite("fold=2/split=test", lambda x: json.dumps(x | {"fold_index": 1}))
    rewrite("fold=0/split=val", lambda x: json.dumps(x | {"folds": FOLDS - 1}))
    broken = table(spark, d, "orders").where(hash_int(F.col("o_custkey").cast("string")) % FOLDS == 0).select(F.when(F.col("o_orderkey") % 2 == 0, '{"example_id": ').otherwise("[1]").alias("value"))
    broken.write.mode("append").text(f"{root}/examples/fold=0/split=test")
    return tree_violations(spark, root, FOLDS)


def _fragments(spark, d):
    """(fold, split, fragment_id, cluster_key) of five folds over all parts."""
    placed = F.when(F.col("p_partkey") % 97 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("fragment_id"), F.col("p_brand").alias("cluster_key"), (hash_int(placed) % FOLDS).alias("bucket"))
    split = F.when(F.col("bucket") == F.col("fold"), "test").when(F.col("bucket") == (F.col("fold") + 1) % FOLDS, "val").otherwise("train")
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).select("fold", split.alias("split"), "fragment_id", "cluster_key")


PLACED = f"b AS (SELECT p_partkey AS fragment_id, p_brand AS cluster_key, {sql_hash('CASE WHEN p_partkey % 97 = 0 THEN p_partkey::VARCHAR ELSE p_brand END')} % {FOLDS} AS bucket FROM part), f AS (SELECT fold, fragment_id, cluster_key, CASE WHEN bucket = fold THEN 'test' WHEN bucket = (fold + 1) % {FOLDS} THEN 'val' ELSE 'train' END AS split FROM b, (SELECT unnest(range({FOLDS})) AS fold))"


@query(
    f"""WITH {PLACED} SELECT 'fragment_in_two_splits' AS "check", fold || '/' || fragment_id AS key FROM f GROUP BY fold, fragment_id HAVING count(DISTINCT split) > 1
       UNION ALL SELECT 'cluster_in_two_splits', fold || '/' || cluster_key FROM f GROUP BY fold, cluster_key HAVING count(DISTINCT split) > 1
       UNION ALL SELECT 'cluster_tested_twice', cluster_key FROM f WHERE split = 'test' GROUP BY cluster_key HAVING count(DISTINCT fold) > 1"""
)
def scan_folds(spark, d):
    return L.partition_violations(_fragments(spark, d))


@query(
    f"""WITH {PLACED}, u AS (SELECT l_orderkey AS example_id, l_partkey AS fragment_id FROM lineitem)
       SELECT DISTINCT 'fragment_unknown' AS "check", 'train/' || example_id || '/' || fragment_id AS key FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fold = 0 AND f.split = 'train' AND f.fragment_id = u.fragment_id)
       UNION ALL SELECT 'example_without_fragments', 'train/' || o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def scan_split(spark, d):
    """Orders as examples of fold 0's training split: those with parts that its sidecar does not know are named."""
    lines = table(spark, d, "lineitem")
    tasks = tasks_for(lines)
    parts = lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("fragment_ids"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    examples = orders.repartition(tasks, "l_orderkey").join(parts, "l_orderkey", "left").select(F.lit("train").alias("split"), F.col("l_orderkey").alias("example_id"), "fragment_ids")
    return L.example_violations(examples, _fragments(spark, d).where("fold = 0"), tasks)


@query(
    f"""WITH {PLACED}, o AS (SELECT DISTINCT fragment_id FROM f WHERE fold = 1 AND split = 'test'), t AS (SELECT DISTINCT p_partkey AS fragment_id FROM part WHERE {sql_hash('p_brand')} % {FOLDS} = 1)
       SELECT 'missing' AS "check", fragment_id::VARCHAR AS key FROM o ANTI JOIN t USING (fragment_id) UNION ALL SELECT 'unexpected', fragment_id::VARCHAR FROM t ANTI JOIN o USING (fragment_id)"""
)
def swap_test_split(spark, d):
    """Another tree's test split, placed by brand alone, against fold 1's own."""
    other = table(spark, d, "part").where(hash_int(F.col("p_brand")) % FOLDS == 1).select(F.col("p_partkey").alias("fragment_id"))
    return L.swap_violations(_fragments(spark, d).where("fold = 1 and split = 'test'"), other, "fragment_id")


@query(f"WITH {PLACED} SELECT DISTINCT 'part' AS library, cluster_key FROM f")
def library_clusters(spark, d):
    return _fragments(spark, d).select(F.lit("part").alias("library"), "cluster_key").distinct()


@query(f"WITH {PLACED} SELECT fragment_id, 'part' AS library, cluster_key, split FROM f WHERE fold = 2 AND split = 'val'")
def fragment_provenance(spark, d):
    """What a generated split's sidecar records of its fragments."""
    rows = _fragments(spark, d).where("fold = 2 and split = 'val'")
    return rows.select("fragment_id", F.lit("part").alias("library"), "cluster_key", "split")


@query(
    """WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS k, CASE WHEN s_suppkey % 11 = 0 THEN 'fever' ELSE s_name END AS name FROM supplier),
            l AS (SELECT *, CASE k WHEN 0 THEN 'filler' WHEN 6 THEN 'mixed' ELSE 'positive' END AS kind, CASE WHEN k IN (2, 6) OR (k = 0 AND s_suppkey % 2 = 0) THEN NULL ELSE 'fever' END AS signal, CASE k WHEN 3 THEN 'fever' WHEN 4 THEN 'coughh' ELSE 'cough' END AS silent, CASE k WHEN 5 THEN 'policy' WHEN 1 THEN 'hope' ELSE 'absent' END AS basis FROM s)
       SELECT 'name_repeats' AS "check", name AS key FROM l GROUP BY name HAVING count(*) > 1
       UNION ALL SELECT 'unknown_kind', name FROM l WHERE kind = 'mixed' UNION ALL SELECT 'filler_with_signal', name FROM l WHERE kind = 'filler' AND signal IS NOT NULL
       UNION ALL SELECT 'no_signal', name FROM l WHERE kind <> 'filler' AND signal IS NULL UNION ALL SELECT 'unknown_silent_signal', name || '/coughh' FROM l WHERE silent = 'coughh'
       UNION ALL SELECT 'silent_on_own_signal', name || '/fever' FROM l WHERE silent = signal UNION ALL SELECT 'silence_repeats', name || '/' || silent FROM l GROUP BY name, silent HAVING count(*) > 1
       UNION ALL SELECT 'unknown_basis', name || '/' || silent FROM l WHERE basis = 'hope' UNION ALL SELECT 'policy_without_note', name || '/' || silent FROM l WHERE basis = 'policy'"""
)
def scan_manifest(spark, d):
    """Suppliers as library declarations with faults of most kinds."""
    key, k = F.col("s_suppkey"), F.col("s_suppkey") % 7
    silent = F.when(k == 3, "fever").when(k == 4, "coughh").otherwise("cough")
    entry = F.struct(silent.alias("signal"), F.when(k == 5, "policy").when(k == 1, "hope").otherwise("absent").alias("basis"), F.lit(" ").alias("note"))
    rows = table(spark, d, "supplier").select(
        F.when(key % 11 == 0, "fever").otherwise(F.col("s_name")).alias("name"), F.concat("s_name", F.lit(".txt")).alias("file"), F.when(k == 0, "filler").when(k == 6, "mixed").otherwise("positive").alias("fragment_type"),
        F.when(~(k.isin(2, 6) | ((k == 0) & (key % 2 == 0))), "fever").alias("signal_key"), F.array(entry).alias("null_on"),
    )
    return L.library_violations(rows, ["fever", "cough"])


ROLE = "CASE p_partkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'ambiguous' ELSE 'filler' END"


@query(
    f"""WITH {PLACED}, p AS (SELECT split, {ROLE.replace('p_partkey', 'fragment_id')} AS role, cluster_key AS library FROM f WHERE fold = 3 AND cluster_key <> 'Brand#1'), c AS (SELECT split, role, count(DISTINCT library) AS n FROM p GROUP BY ALL),
            w AS (SELECT * FROM (VALUES ('train'), ('val'), ('test'), ('extra')) s(split), (VALUES ('positive', 1), ('negative', 1), ('ambiguous', 1), ('filler', 2)) r(role, least))
       SELECT 'pool_too_small' AS "check", split || '/' || role AS key FROM w LEFT JOIN c USING (split, role) WHERE coalesce(n, 0) < least"""
)
def check_pools(spark, d):
    """Pools of fold 3 with brands as libraries; a split nobody generated is missing whole."""
    role = F.element_at(F.array(*map(F.lit, ("positive", "negative", "ambiguous", "filler"))), (F.col("fragment_id") % 4 + 1).cast("int"))
    pools = _fragments(spark, d).where("fold = 3 and cluster_key <> 'Brand#1'").select("split", role.alias("role"), F.col("cluster_key").alias("library"))
    return L.pool_violations(pools, (*L.SPLITS, "extra"))


def _holdout(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    said = lambda c: F.when(F.col("doc_id") % 7 == 0, "null").when(F.col(c) == 1, "true").otherwise("false")
    toxic = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(said("toxic"))
    return rows.select(F.col("doc_id").alias("submission_id"), said("quality").alias("quality"), toxic.alias("toxic"))


def _scores(spark, d, salt):
    """Whole-number scores of every submission, signal and model."""
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("submission_id")).withColumn("signal", F.explode(F.array(F.lit("quality"), F.lit("toxic")))).withColumn("fold", F.explode(F.array(*map(F.lit, MODELS))))
    score = lambda k: (hash_int(F.concat_ws("|", "submission_id", "signal", "fold", F.lit(salt), F.lit(str(k)))) % 1000).cast("long")
    return ids.withColumn("scores", F.array(score(0), score(1), score(2)))


def _held(spark, d, salt):
    return H.cell_predictions(H.judged_cells(_holdout(spark, d), ["quality", "toxic"]), _scores(spark, d, salt), MODELS, HELD_MARGINS)


def held_sql(name: str, salt: str) -> str:
    said = "CASE WHEN doc_id % 7 = 0 THEN 2 WHEN {c} = 1 THEN 1 ELSE 0 END"
    s = [sql_hash(f"unit || '|' || signal || '|' || fold || '|{salt}|{k}'") + " % 1000" for k in range(3)]
    return f"""{name}_c AS (SELECT d.doc_id AS unit, 'quality' AS signal, {said.format(c='quality').replace('doc_id', 'd.doc_id')} AS truth FROM documents d JOIN labels USING (doc_id) UNION ALL SELECT d.doc_id, 'toxic', {said.format(c='toxic').replace('doc_id', 'd.doc_id')} FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 3 <> 0),
        {name}_s AS (SELECT *, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2, CASE signal WHEN 'quality' THEN {HELD_MARGINS['quality']} ELSE {HELD_MARGINS['toxic']} END AS margin FROM {name}_c, (SELECT unnest({MODELS}) AS fold)),
        {name} AS (SELECT fold, signal, unit || ':' || signal AS example_id, truth, unit, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 AND s1 - greatest(s0, s2) >= margin THEN 1 WHEN s0 >= s2 THEN 0 ELSE 2 END AS predicted FROM {name}_s)"""


HA, HB = held_sql("a", "a"), held_sql("b", "b")
SLICED = "x AS (SELECT *, 'all' AS slice FROM a UNION ALL SELECT *, 'decisive' FROM a WHERE truth <> 2)"
SCORED = f"c AS (SELECT signal, slice, fold, {CELLS}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM x GROUP BY signal, slice, fold), r AS (SELECT signal, slice, fold, n, effective_n, {SUMMARY} FROM c)"


@query(f"WITH {HA} SELECT fold, signal, example_id, unit, truth, predicted FROM a")
def holdout_predictions(spark, d):
    return _held(spark, d, "a").select("fold", "signal", "example_id", "unit", "truth", "predicted")


RESAMPLES = 200
COUNTS = [f"c{t}{p}" for t in range(3) for p in range(3)]
#: SQL of the grouped bootstrap's draws, over the sliced predictions x.
DRAWN = f"""u AS (SELECT signal, slice, fold, unit, {CELLS} FROM x GROUP BY signal, slice, fold, unit),
       g AS (SELECT u.*, block, sha256('b|' || unit || '|' || block) AS h FROM u, (SELECT unnest(range({-(-RESAMPLES // stats.DRAWS)})) AS block)),
       t AS (SELECT g.*, block * {stats.DRAWS} + j AS resample, len(list_filter({stats.COPIES}, lambda c: ('0x' || substr(h, 4 * j + 1, 4))::BIGINT >= c)) AS times FROM g, (SELECT unnest(range({stats.DRAWS})) AS j)),
       w AS (SELECT signal, slice, fold, resample, {", ".join(f"sum({c} * times) AS {c}" for c in COUNTS)} FROM t WHERE resample < {RESAMPLES} AND times > 0 GROUP BY ALL),
       i AS (SELECT signal, slice, fold, list_sort(list({ACCURACY})) AS v, len(v) AS m FROM w GROUP BY ALL)"""


@query(
    f"""WITH {HA}, {SLICED}, {SCORED}, {DRAWN} SELECT r.*, round(v[greatest(1, least(m, floor(m * 0.025::DOUBLE)::INT + 1))], 6) AS low, round(v[greatest(1, least(m, ceil(m * 0.975::DOUBLE)::INT))], 6) AS high, m AS used, round(1.959963984540054 * sqrt(0.25 / effective_n), 6) AS half_width
       FROM r JOIN i USING (signal, slice, fold)"""
)
def score_holdout(spark, d):
    """Every fold's scores of a slice with a bootstrap interval over submissions."""
    return H.fold_intervals(_held(spark, d, "a"), RESAMPLES)


@query(f"WITH {HA}, {SLICED}, {SCORED} SELECT signal, slice, max(n) AS n, max(effective_n) AS effective_n, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, count(accuracy) AS folds FROM r GROUP BY signal, slice")
def holdout_summary(spark, d):
    return H.across_folds(H.fold_scores(_held(spark, d, "a")))


@query(
    f"""WITH {HA}, {HB} SELECT a.signal, a.fold, count(*) AS n_pairs, count(*) FILTER (WHERE a.predicted = a.truth AND b.predicted <> b.truth) AS left_only, count(*) FILTER (WHERE a.predicted <> a.truth AND b.predicted = b.truth) AS right_only
       FROM a JOIN b USING (fold, example_id) GROUP BY a.signal, a.fold"""
)
def holdout_fold_pairs(spark, d):
    return H.fold_pairs(_held(spark, d, "a"), _held(spark, d, "b"))


@query(
    """WITH h AS (SELECT * FROM (SELECT 'full' AS model, doc_id FROM labels UNION SELECT 'most', doc_id FROM labels WHERE doc_id % 5 <> 0 UNION SELECT 'same', doc_id FROM labels)), n AS (SELECT model, count(*) AS n FROM h GROUP BY model)
       SELECT l.model AS "left", r.model AS "right", l.n AS n_left, r.n AS n_right, (SELECT count(*) FROM h x JOIN h y USING (doc_id) WHERE x.model = l.model AND y.model = r.model) AS n_common FROM n l JOIN n r ON l.model < r.model WHERE n_common <> n_left OR n_common <> n_right"""
)
def skip_reasons(spark, d):
    """Three models over labelled documents, one of which lacks a fifth of them."""
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("example_id"))
    has = F.array_compact(F.array(F.lit("full"), F.when(F.col("example_id") % 5 != 0, "most"), F.lit("same")))
    return H.unpairable(ids.select(F.explode(has).alias("model"), "example_id"))


@query(f"WITH {HA}, c AS (SELECT fold, signal, {CELLS}, count(*) AS n FROM a WHERE signal = 'toxic' GROUP BY fold, signal) SELECT fold, signal, n, round({ACCURACY}, 6) AS accuracy, round({MACRO}, 6) AS macro_f1 FROM c")
def joint_fan_out(spark, d):
    """One joint model's result restricted to a head."""
    head = _held(spark, d, "a").where("signal = 'toxic'")
    return stats.summarise(head, ["fold", "signal"]).select("fold", "signal", "n", "accuracy", "macro_f1")


@query(f"WITH {HA}, {HB}, u AS (SELECT *, 'a' AS model FROM a UNION ALL SELECT *, 'b' FROM b), c AS (SELECT model, fold, signal, {CELLS}, count(*) AS n, count(DISTINCT unit) AS effective_n FROM u GROUP BY model, fold, signal) SELECT model, fold, signal, n, effective_n, {SUMMARY} FROM c")
def compare_n_models(spark, d):
    """Several models on the same folds, in one pass over their predictions."""
    rows = _held(spark, d, "a").withColumn("model", F.lit("a")).unionByName(_held(spark, d, "b").withColumn("model", F.lit("b")))
    return stats.summarise(rows, ["model", "fold", "signal"])
