"""Scoring of judged cells (submission x signal) by the models of several folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.numbers import argmax_with_margin, worst_half_width
from strandmill.operators import stats

# What a judge writes into a cell; a blank one was not judged.
CELL_CLASSES = {"false": 0, "true": 1, "null": 2}


def judged_cells(holdout: DataFrame, signals: list[str]) -> DataFrame:
    """(submission_id, signal, truth) of the judged cells; one that holds something else raises an error."""
    long = holdout.unpivot(["submission_id"], signals, "signal", "cell").withColumn("cell", F.trim("cell")).where("cell <> ''")
    known = F.coalesce(*[F.when(F.col("cell") == c, F.lit(k)) for c, k in CELL_CLASSES.items()])
    return long.select("submission_id", "signal", F.coalesce(known, F.raise_error(F.concat(F.lit("no judgement: "), "cell")).cast("int")).alias("truth"))


def cell_predictions(cells: DataFrame, scores: DataFrame, folds: list[int], margins: dict[str, int] | int = 0) -> DataFrame:
    """Prediction rows, one a judged cell and each of the ``folds``; the resampling unit is the submission.

    ``scores`` has (fold, submission_id, signal, scores). ``margins`` is one margin, or one of each
    signal; a signal without one, and a judged cell that some fold did not score, raise an error.
    """
    wanted = cells.withColumn("fold", F.explode(F.array(*map(F.lit, folds))))
    both = wanted.join(scores, ["fold", "submission_id", "signal"], "left")
    margin = F.lit(margins)
    if isinstance(margins, dict):
        margin = F.coalesce(*[F.when(F.col("signal") == s, F.lit(m)) for s, m in margins.items()])
    # The margin is looked at for every row, also where the decision does not depend on it.
    missing = F.raise_error(F.concat(F.lit("no margin for "), "signal")).cast("int")
    told = F.coalesce("scores", F.raise_error(F.lit("a judged cell has no scores")).cast(scores.schema["scores"].dataType))
    return both.select("fold", "signal", F.concat_ws(":", "submission_id", "signal").alias("example_id"), "truth", F.col("submission_id").alias("unit"), told.alias("scores"), F.when(margin.isNull(), missing).otherwise(argmax_with_margin(told, margin)).alias("predicted"))


def slices(predictions: DataFrame) -> DataFrame:
    """Predictions once in the slice ``all``, and the decisive ones (truth not null) in ``decisive`` too."""
    names = F.when(F.col("truth") == stats.NULL_CLASS, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("decisive")))
    return predictions.withColumn("slice", F.explode(names))


def fold_scores(predictions: DataFrame) -> DataFrame:
    """(signal, slice, fold, n, effective_n, accuracy, macro_f1, null_to_true_rate) of every fold by itself."""
    return stats.summarise(slices(predictions), ["signal", "slice", "fold"])


def fold_intervals(predictions: DataFrame, resamples: int = 2000, seed: str = "b", alpha: float = 0.05, places: int = 6) -> DataFrame:
    """``fold_scores`` with low, high and used of the accuracy's bootstrap interval over submissions, and the half width that as many of them have at worst.

    Resamples in which the accuracy is undefined are left out of ``used``.
    """
    by = ["signal", "slice", "fold"]
    rows = slices(predictions)
    values = stats.grouped_bootstrap(rows, by, resamples, stats.accuracy(), seed=seed)
    told = stats.grouped_interval(values, by, alpha)
    r = lambda c: F.round(c, places).alias(c)
    scored = stats.summarise(rows, by, places).join(told, by, "left")
    return scored.select(*by, "n", "effective_n", "accuracy", "macro_f1", "null_to_true_rate", r("low"), r("high"), F.coalesce("used", F.lit(0)).alias("used"), F.round(worst_half_width(F.col("effective_n")), places).alias("half_width"))


def across_folds(scored: DataFrame) -> DataFrame:
    """(signal, slice, n, effective_n, mean, sd, folds): accuracy across folds, which are never pooled.

    Sizes belong to the held-out set and not to a model: folds that disagree on them raise an error.
    Folds with an undefined accuracy are left out of mean and deviation and of ``folds``.
    """
    per = scored.groupBy("signal", "slice").agg(
        F.min(F.struct("n", "effective_n")).alias("_low"), F.max(F.struct("n", "effective_n")).alias("_high"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"), F.count("accuracy").alias("folds")
    )
    size = lambda c: F.when(F.col("_low") == F.col("_high"), F.col(f"_low.{c}")).otherwise(F.raise_error(F.lit("the folds disagree on the size of a slice")).cast("long")).alias(c)
    return per.select("signal", "slice", size("n"), size("effective_n"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "folds")


def fold_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(signal, fold, n_pairs, left_only, right_only) of two models' cells, fold by fold; unequal sets of cells raise an error."""
    both = stats.paired(*[df.select(F.struct("signal", "fold", "example_id").alias("cell"), "truth", "predicted") for df in (left, right)], key="cell")
    l, r = F.col("truth") == F.col("left"), F.col("truth") == F.col("right")
    return both.groupBy("cell.signal", "cell.fold").agg(F.count("*").alias("n_pairs"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"))


def unpairable(models: DataFrame) -> DataFrame:
    """(left, right, n_left, n_right, n_common) of the model pairs whose example ids differ, reported and not dropped.

    ``models`` has (model, example_id). Pairs are counted over the models that share an example, so
    the work is that of the examples times the pairs of models, and models are few.
    """
    held = models.distinct()
    sizes = held.groupBy("model").agg(F.count("*").alias("n"))
    named = held.groupBy("example_id").agg(F.array_sort(F.collect_set("model")).alias("m"))
    pairs = named.select(F.explode("m").alias("left"), "m").select("left", F.explode("m").alias("right")).where("left < right")
    common = pairs.groupBy("left", "right").agg(F.count("*").alias("n_common"))
    side = lambda name: sizes.select(F.col("model").alias(name), F.col("n").alias(f"n_{name}"))
    every = side("left").join(F.broadcast(side("right")), F.col("left") < F.col("right"))
    told = every.join(common, ["left", "right"], "left").withColumn("n_common", F.coalesce("n_common", F.lit(0).cast("long")))
    return told.where("n_left <> n_common or n_right <> n_common").select("left", "right", "n_left", "n_right", "n_common")
