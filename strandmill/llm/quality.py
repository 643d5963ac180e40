"""Quality scores by a sparse ensemble of conjunctive rules.

Text statistics are Spark column expressions over the whole text. On a bounded sample of labelled
rows a shallow forest is grown, every path from a root becomes a rule (a conjunction of bounds on
statistics), and a lasso-penalised logistic regression over the rules' indicators keeps few of them.
The kept rules compile to one column expression, so scoring is a projection: no Python, no shuffle.

The sample holds at most about ``max_rows`` labelled ids, chosen by their hash, and one row of each.

Defined results: a null text is scored like an empty one; without training rows, or with one label
only, the score is the constant base rate (0.5 without rows); repeated labels of a document count
once, the largest one; null labels are ignored; repeated rows get equal scores; a repeated id lends
its label to one of its texts, that of the smallest hash, and a null one has no label; texts are read whole, at any
length; an empty table gives an empty result; clashing or extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.language import bounded_rows, id_remainder
from strandmill.sources.shared import written

WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text without nulls, all doubles."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars = F.length(text).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return {"chars": chars, "words": F.size(words).cast("double"), "distinct_words": F.size(F.array_distinct(words)).cast("double"), "lines": F.size(lines).cast("double"), "distinct_lines": F.size(F.array_distinct(lines)).cast("double"), "upper": count(r"\p{Lu}"), "digits": count(r"\p{Nd}"), "symbols": count(r"[^\p{L}\p{N}\s.,;:'\"()-]"), "stops": count(r"[.!?]")}


#: Features by name, from the statistics' columns.
FEATURES = {
    "words": lambda s: s("words"),
    "word_length": lambda s: s("chars") / F.greatest(s("words"), F.lit(1.0)),
    "distinct_word_share": lambda s: s("distinct_words") / F.greatest(s("words"), F.lit(1.0)),
    "distinct_line_share": lambda s: s("distinct_lines") / F.greatest(s("lines"), F.lit(1.0)),
    "line_length": lambda s: s("chars") / F.greatest(s("lines"), F.lit(1.0)),
    "upper_share": lambda s: s("upper") / F.greatest(s("chars"), F.lit(1.0)),
    "digit_share": lambda s: s("digits") / F.greatest(s("chars"), F.lit(1.0)),
    "symbol_share": lambda s: s("symbols") / F.greatest(s("chars"), F.lit(1.0)),
    "stop_share": lambda s: s("stops") / F.greatest(s("words"), F.lit(1.0)),
}


def with_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` plus one double column per feature; each statistic is computed once."""
    base = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = base.select(*keep, *[c.alias(f"_{n}") for n, c in statistics(F.col("_text")).items()])
    return counted.select(*keep, *[f(lambda n: F.col(f"_{n}")).alias(n) for n, f in FEATURES.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_above, threshold), with its weight in the ensemble."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        """True where every bound holds."""
        held = F.lit(True)
        for name, above, threshold in self.bounds:
            held = held & (F.col(name) > F.lit(threshold) if above else F.col(name) <= F.lit(threshold))
        return held


@dataclass(frozen=True)
class RuleEnsemble:
    """Log-odds = intercept + weights of the rules that hold."""

    intercept: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """Probability of label 1, from feature columns."""
        odds = F.lit(float(self.intercept))
        for r in self.rules:
            odds = odds + F.when(r.column(), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Every path from a root of the forest as a rule, without repeats; bounds on one feature and side are merged."""
    found: dict = {}

    def walk(node, bounds: dict) -> None:
        if bounds:
            key = tuple(sorted((n, above, t) for (n, above), t in bounds.items()))
            found.setdefault(key, Rule(key))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        name, threshold = names[node.split().featureIndex()], node.split().threshold()
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            old = bounds.get((name, above))
            tight = threshold if old is None else (max if above else min)(old, threshold)
            walk(child, bounds | {(name, above): tight})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found.values())


def fit_rules(sample: DataFrame, label: str, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 11) -> RuleEnsemble:
    """Fit on stored rows with all FEATURES and a 0/1 ``label``.

    The rows are a bounded sample in one partition: the fit makes some hundred passes over them, and
    most of a pass over many small partitions would be scheduling.
    """
    by_label = {int(r[0]): r[1] for r in sample.groupBy(label).count().collect()}
    total = sum(by_label.values())
    if len(by_label) < 2:
        rate = by_label.get(1, 0) / total if total else 0.5
        return RuleEnsemble(math.log((rate + 1e-3) / (1 - rate + 1e-3)), ())
    names = list(FEATURES)
    vectors = sample.select(F.col(label).cast("double").alias("label"), *names, array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed).fit(vectors)
    rules = tree_rules(forest, names)
    held = vectors.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9))


def sample_features(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Features and ``_label`` of one text per id of ``chosen`` (id, _label), which is bounded: of texts that share an id, that of the smallest hash.

    So the sample is bounded too, however many rows have one id, and only one of their texts is measured.
    """
    marked = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_hash")).join(F.broadcast(chosen), id_col)
    least = marked.groupBy(id_col).agg(F.min("_hash").alias("_hash"))
    own = with_features(marked.join(F.broadcast(least), [id_col, "_hash"], "left_semi"), text_col, [id_col, "_label"])
    return own.groupBy(id_col, "_label").agg(*[F.min(n).alias(n) for n in FEATURES]).drop(id_col)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, threshold: float = 0.3
) -> tuple[DataFrame, RuleEnsemble]:
    """(rows, ensemble): rows have id, held_out (crc32(id as text) mod 5 is 0), score and predicted.

    Only labels of rows that are not held out are learnt from.
    """
    held = id_remainder(id_col, 5) == 0
    known = labels.where(F.col(label_col).isNotNull() & ~held).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = bounded_rows(known, max_rows)
    ensemble = fit_rules(written(sample_features(docs, chosen, id_col, text_col), "quality-sample").coalesce(1), "_label")
    scored = with_features(docs, text_col, [id_col]).select(id_col, held.alias("held_out"), ensemble.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)), ensemble
