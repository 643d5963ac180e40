"""Evaluation statistics over prediction rows (unit, truth, predicted; classes 0 false, 1 true, 2 null)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.numbers import argmax_with_margin
from strandmill.functions.text import hash_int
from strandmill.operators.dataset import numbered
from strandmill.sources.shared import written

CLASSES = (0, 1, 2)
NULL_CLASS, TRUE_CLASS = 2, 1


def cell(t: int, p: int, truth: str = "truth", predicted: str = "predicted") -> Column:
    return F.count_if((F.col(truth) == t) & (F.col(predicted) == p))


def cells() -> list[Column]:
    """Nine dense confusion counts c00..c22 (truth, prediction)."""
    return [cell(t, p).alias(f"c{t}{p}") for t in CLASSES for p in CLASSES]


def _total(names: list[str]) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def class_metrics(k: int) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of class k from nine counts; null where undefined, F1 null only if the class is nowhere."""
    hit = F.col(f"c{k}{k}")
    support, said = _total([f"c{k}{p}" for p in CLASSES]), _total([f"c{t}{k}" for t in CLASSES])
    f1 = F.when(support + said > 0, 2 * hit / (support + said))
    return F.try_divide(hit, said), F.try_divide(hit, support), f1


def macro_f1() -> Column:
    scores = F.array_compact(F.array(*[class_metrics(k)[2] for k in CLASSES]))
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))


def accuracy() -> Column:
    return F.try_divide(_total([f"c{k}{k}" for k in CLASSES]), _total([f"c{t}{p}" for t in CLASSES for p in CLASSES]))


def null_to_true_rate() -> Column:
    return F.try_divide(F.col(f"c{NULL_CLASS}{TRUE_CLASS}"), _total([f"c{NULL_CLASS}{p}" for p in CLASSES]))


def confusion(preds: DataFrame, by: list[str] | None = None, unit: str = "unit") -> DataFrame:
    """One pass: counts, n and effective n (distinct units) per group."""
    return preds.groupBy(*(by or [])).agg(*cells(), F.count("*").alias("n"), F.count_distinct(unit).alias("effective_n"))


def summarise(preds: DataFrame, by: list[str] | None = None, places: int = 6) -> DataFrame:
    """n, effective n, accuracy, macro F1 and null-to-true rate per group."""
    r = lambda c, name: F.round(c, places).alias(name)
    return confusion(preds, by).select(*(by or []), "n", "effective_n", r(accuracy(), "accuracy"), r(macro_f1(), "macro_f1"), r(null_to_true_rate(), "null_to_true_rate"))


def repredict(preds: DataFrame, margins: list[int], scores: str = "scores") -> DataFrame:
    """Every prediction decided again under each margin; the grid is a literal array, so one pass serves all."""
    grid = preds.withColumn("margin", F.explode(F.array(*map(F.lit, margins))))
    return grid.withColumn("predicted", argmax_with_margin(F.col(scores), F.col("margin")))


def margin_sweep(preds: DataFrame, margins: list[int]) -> DataFrame:
    """(margin, macro_f1, null_to_true_rate, accuracy); aggregated before it leaves the map side."""
    return summarise(repredict(preds, margins), ["margin"])


def select_margin(sweep: DataFrame) -> DataFrame:
    """The best macro F1 among margins whose null-to-true rate is not above that at margin 0; ties: lower rate, smaller margin."""
    base = sweep.where("margin = 0").select(F.col("null_to_true_rate").alias("_base"))
    allowed = sweep.join(F.broadcast(base)).where("_base is null or null_to_true_rate is null or null_to_true_rate <= _base + 1e-12")
    order = [F.coalesce("macro_f1", F.lit(-1.0)).desc(), F.coalesce("null_to_true_rate", F.lit(0.0)), F.col("margin")]
    return allowed.orderBy(*order).limit(1).drop("_base")


def select_margins(preds: DataFrame, margins: list[int], head: str) -> DataFrame:
    """(head, margin): ``select_margin`` of every head by itself, in one pass; heads never trade with each other."""
    sweep = summarise(repredict(preds, margins), [head, "margin"])
    base = sweep.where("margin = 0").select(head, F.col("null_to_true_rate").alias("_base"))
    allowed = sweep.join(base, head).where("_base is null or null_to_true_rate is null or null_to_true_rate <= _base + 1e-12")
    best = F.min(F.struct((-F.coalesce("macro_f1", F.lit(-1.0))).alias("f"), F.coalesce("null_to_true_rate", F.lit(0.0)).alias("r"), "margin"))
    return allowed.groupBy(head).agg(best.alias("_b")).select(head, F.col("_b.margin").alias("margin"))


def decided(preds: DataFrame, rules: DataFrame, head: str, scores: str = "scores") -> DataFrame:
    """Predictions decided again under their head's selected margin; a head without one raises an error."""
    ruled = preds.join(rules.select(head, F.col("margin")), head, "left")
    # The margin is looked at for every row, also where the decision does not depend on it.
    missing = F.raise_error(F.concat(F.lit("no margin was selected for "), F.col(head).cast("string"))).cast("int")
    return ruled.withColumn("predicted", F.when(F.col("margin").isNull(), missing).otherwise(argmax_with_margin(F.col(scores), F.col("margin"))))


def select_then_score(validation: DataFrame, stages: dict[str, DataFrame], margins: list[int], head: str) -> DataFrame:
    """Per stage and head the summary under margins that validation rows alone select; the stages select nothing."""
    rules = written(select_margins(validation, margins, head), "rules")
    rows = [summarise(decided(df, rules, head), [head]).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.join(rules, head, "left")


def error_concentration(groups: DataFrame, group: str) -> DataFrame:
    """How few groups carry half of all errors; ``groups`` has n and n_correct per group."""
    errors = groups.select(group, (F.col("n") - F.col("n_correct")).alias("errors"))
    # Errors per group are tallied by value first: the running total then runs over distinct values.
    by_value = errors.where("errors > 0").groupBy("errors").agg(F.count("*").alias("many"))
    down = Window.orderBy(F.col("errors").desc())
    tall = by_value.withColumns({"groups_to": F.sum("many").over(down), "errors_to": F.sum(F.col("errors") * F.col("many")).over(down), "total": F.sum(F.col("errors") * F.col("many")).over(Window.partitionBy())})
    before = tall.withColumns({"groups_before": F.col("groups_to") - F.col("many"), "errors_before": F.col("errors_to") - F.col("errors") * F.col("many")})
    half = F.col("groups_before") + F.ceil((F.col("total") / 2 - F.col("errors_before")) / F.col("errors"))
    ten = F.least(F.greatest(F.lit(10) - F.col("groups_before"), F.lit(0)), F.col("many")) * F.col("errors")
    found = before.agg(
        F.coalesce(F.sum("many"), F.lit(0)).alias("groups_with_errors"),
        F.coalesce(F.max("total"), F.lit(0)).alias("total_errors"),
        F.coalesce(F.min(F.when((F.col("errors_to") * 2 >= F.col("total")) & (F.col("errors_before") * 2 < F.col("total")), half)), F.lit(0)).cast("long").alias("groups_carrying_half"),
        F.round(F.sum(ten) / F.max("total"), 6).alias("share_in_worst_ten"),
    )
    return found.join(F.broadcast(groups.agg(F.count("*").alias("groups")))).withColumn("even_spread_would_be", F.when(F.col("groups_with_errors") > 0, F.col("groups_with_errors") / 2))


def paired(left: DataFrame, right: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, truth, left, right): both models' predictions of every example. An id that one side lacks or repeats, or truths that differ, raise an error."""
    side = lambda df, name: df.groupBy(key).agg(F.max("truth").alias(f"_{name}_truth"), F.max("predicted").alias(name), F.count("*").alias(f"_{name}_rows"))
    both = side(left, "left").join(side(right, "right"), key, "full")
    sound = F.coalesce((F.col("_left_rows") == 1) & (F.col("_right_rows") == 1) & (F.col("_left_truth") == F.col("_right_truth")), F.lit(False))
    truth = F.when(sound, F.col("_left_truth")).otherwise(F.raise_error(F.concat(F.lit("the models do not pair at "), F.col(key).cast("string"))).cast("int"))
    return both.select(key, truth.alias("truth"), "left", "right")


def cross_pairs(preds: DataFrame, model: str, names: list[str], slice_: str) -> DataFrame:
    """(left, right, slice, n_common, skipped, left_only, right_only) of all pairs of models, after one shuffle by example.

    ``names`` are the models, which are few. A pair whose example ids differ within a slice is skipped and has no counts.
    """
    held = preds.groupBy(slice_, "example_id").agg(*[F.max(F.when(F.col(model) == n, F.col("truth") == F.col("predicted"))).alias(f"_m{i}") for i, n in enumerate(names)])
    pair = lambda i, j: F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"_m{i}").alias("l"), F.col(f"_m{j}").alias("r"))
    order = sorted(range(len(names)), key=lambda i: names[i])
    pairs = held.select(slice_, F.inline(F.array(*[pair(i, j) for k, i in enumerate(order) for j in order[k + 1 :]])))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    per = pairs.groupBy("left", "right", slice_).agg(
        F.count_if(both).alias("n_common"), (F.count_if(F.col("l").isNotNull() != F.col("r").isNotNull()) > 0).alias("skipped"), F.count_if(F.col("l") & ~F.col("r")).alias("_left"), F.count_if(~F.col("l") & F.col("r")).alias("_right")
    )
    told = lambda c: F.when(~F.col("skipped"), F.col(f"_{c}")).alias(f"{c}_only")
    return per.select("left", "right", slice_, "n_common", "skipped", told("left"), told("right"))


def paired_counts(left: DataFrame, right: DataFrame, key: str = "example_id") -> DataFrame:
    """Discordant counts of two models over the same examples."""
    l, r = F.col("truth") == F.col("left"), F.col("truth") == F.col("right")
    return paired(left, right, key).agg(F.count("*").alias("n"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"))


def resampled(units: DataFrame, unit: str, columns: list[str], resamples: int, seed: str = "b") -> DataFrame:
    """(resample, sums of ``columns``): as many units as there are, drawn with replacement by hash, ``resamples`` times.

    ``units`` has one row a unit, whose columns add up; a draw meets its unit by number, so that any
    number of units is served.
    """
    placed = written(numbered(units.select(unit, *columns).withColumn("_all", F.lit(0)), "_all", [F.col(unit)], "_place").drop("_all"), "units")
    many = max(placed.count(), 1)
    draws = units.sparkSession.range(resamples * many).select(F.expr(f"id div {many}").alias("resample"), F.expr(f"id % {many}").alias("turn"))
    draws = draws.select("resample", (F.pmod(hash_int(F.concat_ws("|", F.lit(seed), "resample", "turn")), F.lit(many)) + 1).alias("_place"))
    return draws.join(placed, "_place").groupBy("resample").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap(preds: DataFrame, resamples: int, statistic: Column, unit: str = "unit", seed: str = "b") -> DataFrame:
    """(resample, value): a statistic of confusion counts over resampled units; predictions shrink to nine counts per unit first."""
    names = [f"c{t}{p}" for t in CLASSES for p in CLASSES]
    return resampled(preds.groupBy(unit).agg(*cells()), unit, names, resamples, seed).select("resample", statistic.alias("value"))


def interval(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile interval at floor(alpha/2 * m) and ceil((1 - alpha/2) * m) - 1 of the m defined values."""
    kept = values.agg(F.sort_array(F.collect_list("value")).alias("v"), F.count("*").alias("resamples"))
    m = F.size("v")
    at = lambda i: F.when(m > 0, F.try_element_at("v", F.greatest(F.lit(1), F.least(m, i)).cast("int")))
    return kept.select(at(F.floor(m * F.lit(alpha / 2)) + 1).alias("low"), at(F.ceil(m * F.lit(1 - alpha / 2))).alias("high"), "resamples", (F.col("resamples") - m).alias("undefined"))


#: Draws that one digest yields, and the 16-bit draws from which a unit counts once, twice and so on: a Poisson distribution with mean 1.
DRAWS = 16
COPIES = [math.floor(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(8)]


def multiplicities(units: Iterable[str], resamples: int) -> np.ndarray:
    """(units, resamples): how often each unit, named with its seed, counts; a hash of unit and block of resamples decides, so no units need numbers and reruns agree."""
    digests = b"".join(hashlib.sha256(f"{u}|{k}".encode()).digest() for u in units for k in range(-(-resamples // DRAWS)))
    drawn = np.searchsorted(COPIES, np.arange(65536), side="right").astype("f8")[np.frombuffer(digests, ">u2")]
    return drawn.reshape(-1, -(-resamples // DRAWS) * DRAWS)[:, :resamples]


def grouped_bootstrap(preds: DataFrame, by: list[str], resamples: int, statistic: Column, unit: str = "unit", seed: str = "b") -> DataFrame:
    """(by, resample, value): a statistic of confusion counts over resampled units of every group, in one job.

    A unit's predictions shrink to nine counts, which every resample takes as often as a draw by hash
    says: on average once, so a resample has about as many units as its group (a Poisson bootstrap).
    Draws need neither the number of units nor each other, so a batch of units is one product of matrices,
    copies by counts, and a task passes on one row a group and resample of each batch. A unit is drawn
    alike in all groups. A resample without any unit has no row.
    """
    names = [f"c{t}{p}" for t in CLASSES for p in CLASSES]
    keyed = preds.groupBy(*by, unit).agg(*cells()).withColumn("_unit", F.concat_ws("|", F.lit(seed), unit)).drop(unit)
    units = keyed.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_group"), *by, "_unit", *names)
    kept = T.StructType([units.schema[c] for c in ("_group", *by)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, firsts = {}, {}
        for batch in batches:
            codes, own = pd.factorize(batch["_unit"])
            copies, counts = multiplicities(own, resamples), batch[names].to_numpy("f8")
            for group, at in batch.groupby("_group", sort=False).indices.items():
                drawn = copies[codes[at]]
                found = np.column_stack([(drawn > 0).sum(0), drawn.T @ counts[at]])
                sums[group] = sums[group] + found if group in sums else found
                firsts.setdefault(group, batch.iloc[at[:1]][["_group", *by]])
        for group, found in sums.items():
            told = pd.DataFrame(found[:, 1:], columns=names).assign(resample=np.arange(resamples, dtype="i4"))[found[:, 0] > 0]
            yield firsts[group].merge(told, how="cross")

    drawn = units.mapInPandas(run, T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("resample", T.IntegerType())]))
    # Sums of whole numbers below 2^53 are exact in doubles.
    sums = drawn.groupBy("_group", *by, "resample").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return sums.select(*by, "resample", statistic.alias("value"))


def grouped_interval(values: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, low, high, used): ``interval`` of every group; a group holds as many values as there are resamples."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    kept = values.groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("_v"))
    m = F.size("_v")
    at = lambda i: F.when(m > 0, F.try_element_at("_v", F.greatest(F.lit(1), F.least(m, i)).cast("int")))
    return kept.select(*by, at(F.floor(m * F.lit(alpha / 2)) + 1).alias("low"), at(F.ceil(m * F.lit(1 - alpha / 2))).alias("high"), m.alias("used"))


def spread(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean and sample standard deviation over folds; the latter null for one fold."""
    return values.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("sd"), F.count(column).alias("folds"))
