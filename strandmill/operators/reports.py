"""Reading nested evaluation reports, whose shape differs from file to file, as variants.

A path that a report lacks and one that holds null are both null where a number is read, but not where
presence decides: an arm without a held-out block, or with a null one, was not scored on the held-out
set, while one that has a block must have a row for its report's own signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the classes in a report.
CLASSES = ("true", "false", "null")


def _at(variant: Column, path: str, kind: str = "double") -> Column:
    return F.try_variant_get(variant, path, kind)


def _there(variant: Column) -> Column:
    """Neither absent nor null."""
    return variant.isNotNull() & ~F.coalesce(F.is_variant_null(variant), F.lit(False))


def _short(name: Column) -> Column:
    """A model's name behind its last @."""
    return F.substring_index(F.coalesce(name, F.lit("")), "@", -1)


def _failing(condition: Column, value: Column, kind: str, *said: Column | str) -> Column:
    told = F.concat(*[s if isinstance(s, Column) else F.lit(s) for s in said])
    return F.when(condition, F.raise_error(told).cast(kind)).otherwise(value)


def parsed_reports(reports: DataFrame) -> DataFrame:
    """(path, signal, report: variant) of (path, report: JSON text); text that is no JSON, or names no signal, raises an error."""
    v = F.try_parse_json("report")
    read = reports.select("path", F.when(v.isNull(), F.raise_error(F.concat("path", F.lit(": not readable as JSON"))).cast("variant")).otherwise(v).alias("report"))
    signal = _at(F.col("report"), "$.header.signal", "string")
    return read.select("path", _failing(F.coalesce(signal, F.lit("")) == "", signal, "string", F.col("path"), ": names no signal").alias("signal"), "report")


def signal_scores(reports: DataFrame, arms: list[str]) -> DataFrame:
    """One row a report and arm: path, signal, arm, scored, null_to_true, decisive, recall_*, accuracy, synthetic_null_to_true, n_true.

    Exactly one model of a report bears an arm's name, with whatever stands before its last @; a missing
    or second one raises an error. So does an arm with a held-out block that has no row for the signal.
    """
    read = parsed_reports(reports).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    models = F.coalesce(_at(F.col("report"), "$.models", "array<variant>"), F.array().cast("array<variant>"))
    found = read.withColumn("_found", F.filter(models, lambda m: _short(_at(m, "$.name", "string")) == F.col("arm")))
    count = F.size("_found")
    one = found.select("path", "signal", "arm", _failing(count != 1, F.try_element_at("_found", F.lit(1)), "variant", F.col("path"), ": ", count.cast("string"), " arms named ", F.col("arm")).alias("model"))
    block = _at(F.col("model"), "$.holdout", "variant")
    rows = F.coalesce(_at(block, "$.by_signal", "array<variant>"), F.array().cast("array<variant>"))
    own = F.try_element_at(F.filter(rows, lambda r: _at(r, "$.signal", "string") == F.col("signal")), F.lit(1))
    met = one.select("path", "signal", "arm", "model", _there(block).alias("scored"), own.alias("_own"))
    entry = _failing(F.col("scored") & F.col("_own").isNull(), F.col("_own"), "variant", F.col("path"), ": the held-out block of ", F.col("arm"), " has no row for ", F.col("signal"))
    met = met.withColumn("entry", entry)
    return met.select(
        "path", "signal", "arm", "scored", _at(F.col("entry"), "$.null_to_true.mean_rate").alias("null_to_true"), _at(F.col("entry"), "$.decisive.accuracy.mean").alias("decisive"),
        *[_at(F.col("entry"), f"$.per_class_recall.{c}.mean").alias(f"recall_{c}") for c in CLASSES], _at(F.col("model"), "$.holdout.overall.accuracy.mean").alias("accuracy"),
        _at(F.col("model"), "$.pooled.ruled.null_to_true.rate").alias("synthetic_null_to_true"), _at(F.col("entry"), "$.distribution.true", "long").alias("n_true"),
    )


def paired_rows(reports: DataFrame, one: str, other: str) -> DataFrame:
    """(path, found, left, right, p): the first comparison of the two named arms in each report, whichever stands on the left."""
    read = parsed_reports(reports)
    rows = F.coalesce(_at(F.col("report"), "$.holdout_comparisons", "array<variant>"), F.array().cast("array<variant>"))
    name = lambda r, side: _short(_at(r, f"$.{side}", "string"))
    pair = F.array_sort(F.array(F.lit(one), F.lit(other)))
    first = F.try_element_at(F.filter(rows, lambda r: F.array_sort(F.array(name(r, "left"), name(r, "right"))) == pair), F.lit(1))
    met = read.select("path", first.alias("row"))
    return met.select("path", F.col("row").isNotNull().alias("found"), _at(F.col("row"), "$.left", "string").alias("left"), _at(F.col("row"), "$.right", "string").alias("right"), _at(F.col("row"), "$.p").alias("p"))
