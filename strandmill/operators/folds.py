"""Cross-checks of generated folds, their sidecars and library declarations, as frames (check, key) of what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
# Kinds of libraries, and grounds for declaring a library silent on a signal.
LIBRARY_KINDS = ("positive", "negative", "ambiguous", "confounder", "filler")
SILENCE_BASES = ("absent", "policy")


def _named(rows: DataFrame, check: str, *key: str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]).alias("key"))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _several(rows: DataFrame, by: list[str], what: Column) -> DataFrame:
    """Groups in which ``what`` takes several values; the ends of its range tell, with map-side combine."""
    return rows.groupBy(*by).agg(F.min(what).alias("_low"), F.max(what).alias("_high")).where("not (_low <=> _high)")


def sidecar_violations(files: DataFrame, folds: int) -> DataFrame:
    """Checks of sidecars (fold, split: as the path says; recorded_fold, recorded_split, recorded_folds, salt, version).

    Every file records its own split and fold and the number of folds, the files of a fold agree on
    version and configuration, all folds on the salt, and no file of the folds is missing.
    """
    at = ("fold", "split")
    wanted = files.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"), F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    configuration = F.to_json(F.struct("recorded_folds", "salt", "version"), {"ignoreNullFields": "false"})
    salts = files.select(F.lit("all").alias("scope"), F.to_json(F.struct("salt"), {"ignoreNullFields": "false"}).alias("salt"))
    return _union(
        _named(wanted.join(files, list(at), "left_anti"), "file_missing", *at),
        _named(files.where(~F.col("recorded_split").eqNullSafe(F.col("split"))), "split_differs_from_path", *at),
        _named(files.where(~F.col("recorded_fold").eqNullSafe(F.col("fold"))), "fold_differs_from_path", *at),
        _named(files.where(~F.col("recorded_folds").eqNullSafe(F.lit(folds))), "number_of_folds", *at),
        _named(_several(files, ["fold"], configuration), "configuration_differs_within_fold", "fold"),
        _named(_several(salts, ["scope"], F.col("salt")), "salt_differs_between_folds", "scope"),
    )


def partition_violations(fragments: DataFrame) -> DataFrame:
    """Checks of (fold, split, fragment_id, cluster_key): within a fold no fragment and no cluster lies in two splits, and no cluster is tested in two folds."""
    tested = fragments.where("split = 'test'")
    return _union(
        _named(_several(fragments, ["fold", "fragment_id"], F.col("split")), "fragment_in_two_splits", "fold", "fragment_id"),
        _named(_several(fragments, ["fold", "cluster_key"], F.col("split")), "cluster_in_two_splits", "fold", "cluster_key"),
        _named(_several(tested, ["cluster_key"], F.col("fold")), "cluster_tested_twice", "cluster_key"),
    )


def example_violations(examples: DataFrame, fragments: DataFrame, tasks: int | None = None) -> DataFrame:
    """Checks of (split, example_id, fragment_ids array): ids are unique in a split, every example has fragments, and the sidecar's ``fragments`` (split, fragment_id) knows each of them.

    ``tasks`` says how many tasks share what examples use; by default Spark does, whatever its size.
    """
    at = ["split", "fragment_id"]
    dealt = lambda df, *key: df.repartition(tasks, *key) if tasks else df
    used = examples.select("split", "example_id", F.explode("fragment_ids").alias("fragment_id"))
    return _union(
        _named(dealt(examples.select("split", "example_id"), "split", "example_id").groupBy("split", "example_id").count().where("count > 1"), "example_repeats", "split", "example_id"),
        _named(examples.where(F.coalesce(F.size("fragment_ids"), F.lit(0)) < 1), "example_without_fragments", "split", "example_id"),
        _named(dealt(dealt(used, *at).join(dealt(fragments.select(*at), *at).distinct(), at, "left_anti"), "split", "example_id", "fragment_id").distinct(), "fragment_unknown", "split", "example_id", "fragment_id"),
    )


def swap_violations(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Ids that only one of two test splits holds; another tree's test split may stand in only if there are none."""
    mine, theirs = own.select(key).distinct(), other.select(key).distinct()
    return _union(_named(mine.join(theirs, key, "left_anti"), "missing", key), _named(theirs.join(mine, key, "left_anti"), "unexpected", key))


def library_violations(libraries: DataFrame, signals: list[str]) -> DataFrame:
    """Checks of library declarations (name, file, fragment_type, signal_key, null_on: array of signal, basis, note).

    A library has a name of its own and a file, a known kind, and a signal just if it is no filler. It
    declares silence once a signal, on known signals other than its own, on a known basis, and says why
    where the basis is policy.
    """
    filler, signal = F.col("fragment_type").eqNullSafe(F.lit("filler")), F.col("signal_key").isNotNull()
    declared = libraries.select("name", "signal_key", F.inline("null_on"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return _union(
        _named(libraries.where(blank("name")), "no_name", "file"),
        _named(libraries.where(~blank("name")).groupBy("name").count().where("count > 1"), "name_repeats", "name"),
        _named(libraries.where(blank("file")), "no_file", "name"),
        _named(libraries.where(~F.coalesce(F.col("fragment_type").isin(*LIBRARY_KINDS), F.lit(False))), "unknown_kind", "name"),
        _named(libraries.where(filler & signal), "filler_with_signal", "name"),
        _named(libraries.where(~filler & ~signal), "no_signal", "name"),
        _named(declared.where(~F.coalesce(F.col("signal").isin(*signals), F.lit(False))), "unknown_silent_signal", "name", "signal"),
        _named(declared.where(F.col("signal") == F.col("signal_key")), "silent_on_own_signal", "name", "signal"),
        _named(declared.groupBy("name", "signal").count().where("count > 1"), "silence_repeats", "name", "signal"),
        _named(declared.where(~F.coalesce(F.col("basis").isin(*SILENCE_BASES), F.lit(False))), "unknown_basis", "name", "signal"),
        _named(declared.where((F.col("basis") == "policy") & blank("note")), "policy_without_note", "name", "signal"),
    )


def pool_violations(pools: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Checks of pools (split, role, library): each split has fragments of every decisive role and at least two libraries of fillers, which a structural null draws from."""
    per = pools.groupBy("split", "role").agg(F.count_distinct("library").alias("libraries"))
    wanted = [(s, r, 2 if r == "filler" else 1) for s in splits for r in ("positive", "negative", "ambiguous", "filler")]
    least = pools.sparkSession.createDataFrame(wanted, "split string, role string, least int")
    return _named(least.join(per, ["split", "role"], "left").where("coalesce(libraries, 0) < least"), "pool_too_small", "split", "role")
