"""Trees of generated folds: examples, fragments and a sidecar of statistics for every split of every fold.

A tree holds ``examples/fold=K/split=S`` (JSON Lines), ``fragments/fold=K/split=S`` (Parquet) and
``stats/fold=K/split=S/stats.json``. Readers take fold and split from the path, so a query for one fold
or split opens no other's files.

Statistics are counted from the examples as they lie in the written files, so they cannot differ from
them. A tree is written under another name and renamed when it is complete: whatever fails before leaves
nothing under its name. (Observing them in the pass that writes would save a pass, but from then on Spark
4.1 cannot ship models that MLlib fits in the session.)
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.operators.folds import SPLITS, example_violations, partition_violations, sidecar_violations
from strandmill.operators.relational import violations
from strandmill.sources.shared import written

# Keys that every sidecar has.
REQUIRED = ("generator_version", "signal", "folds", "fold_index", "split_salt", "split", "count", "labels")
STATES = ("true", "false", "null")


def _state(signal: str) -> Column:
    """An example's label as it stands: true, false, null, or null where the signal is masked."""
    masked = ~F.map_contains_key("labels", F.lit(signal))
    return F.when(~masked, F.coalesce(F.element_at("labels", signal).cast("string"), F.lit("null")))


def write_tree(examples: DataFrame, fragments: DataFrame, root: str, configuration: dict, signals: list[str], folds: int) -> list[dict]:
    """Write and publish a tree; returns its sidecars. ``root`` must not exist.

    ``examples`` has (fold, split, example_id, text, labels: map of booleans, fragment_ids: array),
    ``fragments`` (fold, split, fragment_id, cluster_key). ``configuration`` goes into every sidecar.
    """
    store, path = fs.FileSystem.from_uri(root)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(root)
    base = f"{root.rstrip('/')}.{uuid.uuid4().hex}"
    examples.write.partitionBy("fold", "split").option("ignoreNullFields", False).json(f"{base}/examples")
    fragments.write.partitionBy("fold", "split").parquet(f"{base}/fragments")
    counts = [F.count_if(_state(x) == v).alias(f"{x}/{v}") for x in signals for v in STATES]
    stored = read_examples(examples.sparkSession, base).groupBy("fold", "split").agg(F.count("*").alias("count"), *counts)
    # One row a split.
    told = {(r["fold"], r["split"]): r for r in stored.collect()}
    sidecars = []
    store, staged = fs.FileSystem.from_uri(base)
    for k, s in itertools.product(range(folds), SPLITS):
        own = told.get((k, s))
        labels = {x: {v: own[f"{x}/{v}"] if own else 0 for v in STATES} for x in signals}
        sidecars.append(configuration | {"folds": folds, "fold_index": k, "split": s, "count": own["count"] if own else 0, "labels": labels})
        store.create_dir(f"{staged}/stats/fold={k}/split={s}", recursive=True)
        with store.open_output_stream(f"{staged}/stats/fold={k}/split={s}/stats.json") as out:
            out.write(json.dumps(sidecars[-1]).encode())
    store.move(staged, path.rstrip("/"))
    return sidecars


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(fold, split, stats): the sidecars' text, by the path they lie under."""
    return spark.read.schema("value string, fold int, split string").option("wholetext", True).text(f"{root}/stats").select("fold", "split", F.col("value").alias("stats"))


def sidecar_key_violations(sidecars: DataFrame) -> DataFrame:
    """Sidecars that are no JSON object, and required keys that one lacks."""
    keys = F.json_object_keys("stats")
    lacking = sidecars.where(keys.isNotNull()).withColumn("key", F.explode(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)))
    at = F.concat_ws("/", "fold", "split")
    return violations(("sidecar_not_json", sidecars.where(keys.isNull()), at, F.lit("")), ("sidecar_key_missing", lacking, at, F.col("key")))


def read_examples(spark: SparkSession, root: str) -> DataFrame:
    """(example_id, text, labels, fragment_ids, fold, split); lines that are none have nulls, see ``line_errors``. Conditions on fold and split reach the file listing."""
    return spark.read.schema("example_id string, text string, labels map<string,boolean>, fragment_ids array<string>, fold int, split string").json(f"{root}/examples")


def read_fragments(spark: SparkSession, root: str) -> DataFrame:
    """(fragment_id, cluster_key, fold, split)."""
    return spark.read.schema("fragment_id string, cluster_key string, fold int, split string").parquet(f"{root}/fragments")


def line_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, error) of the lines below ``path`` that are no JSON objects; blank lines are skipped, but numbered.

    Lines are counted by the ranges in which Spark reads the files, and numbered by the sum of the
    ranges before; so a file of any length is numbered by many tasks. An object with a repeated
    key counts as invalid.
    """
    read = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    ranges = read.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    wrong = read.withColumn("error", _line_error()).where("error is not null").select("file", "start", "id", "error")
    return wrong.join(placed, ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "error")


def _line_error() -> Column:
    """What is wrong with the line ``value``, or null."""
    told = lambda kind: F.when(kind.isNull(), "not valid JSON").when(~kind.startswith("OBJECT"), "not a JSON object")
    # The array's one element is computed once, however often the function names it.
    once = F.transform(F.array(F.schema_of_variant(F.try_parse_json("value"))), told)
    return F.when(F.trim("value") != "", F.element_at(once, 1))


def _checked_lines(spark: SparkSession, root: str) -> DataFrame:
    """(fold, split, error, example_id, fragment_ids) of the examples' lines that are not blank: all that the checks look at, from one pass over the files."""
    lines = spark.read.schema("value string, fold int, split string").text(f"{root}/examples").where(F.col("value").rlike(r"[^ \t\r]"))
    parsed = F.from_json("value", "example_id string, fragment_ids array<string>")
    return written(lines.select("fold", "split", _line_error().alias("error"), parsed.alias("x")).select("fold", "split", "error", "x.*"), "checked-lines")


def tree_violations(spark: SparkSession, root: str, folds: int) -> DataFrame:
    """(check, key) of everything that is wrong with a tree: its lines, sidecars, splits and examples."""
    named = lambda df: df.select(F.col("rule").alias("check"), F.concat_ws("/", "key", F.when(F.col("detail") != "", F.col("detail"))).alias("key"))
    sidecars, examples, fragments = read_sidecars(spark, root), _checked_lines(spark, root), read_fragments(spark, root)
    at = lambda p: F.get_json_object("stats", f"$.{p}")
    recorded = sidecars.where(F.json_object_keys("stats").isNotNull()).select(
        "fold", "split", at("fold_index").cast("int").alias("recorded_fold"), at("split").alias("recorded_split"), at("folds").cast("int").alias("recorded_folds"), at("split_salt").alias("salt"), F.to_json(F.struct(at("generator_version").alias("v"), at("signal").alias("s"))).alias("version"), at("count").cast("long").alias("count"),
    )
    sized = examples.groupBy("fold", "split").agg(F.count("*").alias("n"))
    miscounted = recorded.join(sized, ["fold", "split"], "left").where("not (count <=> coalesce(n, 0))")
    lines = examples.where("error is not null").select(F.lit("line").alias("check"), F.concat(F.lit("fold="), "fold", F.lit("/split="), "split", F.lit(": "), "error").alias("key"))
    return (
        named(sidecar_key_violations(sidecars))
        .unionByName(sidecar_violations(recorded, folds))
        .unionByName(miscounted.select(F.lit("count_differs").alias("check"), F.concat_ws("/", "fold", "split").alias("key")))
        .unionByName(lines)
        .unionByName(partition_violations(fragments))
        .unionByName(example_violations(examples.where("example_id is not null").withColumn("split", F.concat_ws("/", "fold", "split")), fragments.withColumn("split", F.concat_ws("/", "fold", "split"))))
    )


def load_tree(spark: SparkSession, root: str, folds: int) -> DataFrame:
    """The examples of a sound tree; one that violates a check raises an error that names some of what is wrong."""
    wrong = tree_violations(spark, root, folds).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['check']}: {r['key']}" for r in wrong))
    return read_examples(spark, root)
