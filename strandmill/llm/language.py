"""Multilingual mixture inference for whole texts.

Training counts hashed byte trigrams per language and keeps smoothed probabilities: what each trigram
that a language has adds to the language's floor. For each document expectation-maximisation estimates which share of
its trigrams comes from each language; the language set then grows from the best single language as
long as the log-likelihood gain of another one exceeds a penalty per language that rises with the
logarithm of the text's length. The prediction is the selected language with the largest share.

The model may be fitted on a bounded sample: of the labelled rows at most about ``max_rows`` are
read, chosen by a hash of their id, and the trigrams of that sample, whatever its languages, bound the
model. Predicting uses the text alone and needs no shuffle.

Defined results: a null text or one without any letter gets ``und`` with score 0; a text whose
trigrams the model never saw still gets a language, by prior-free likelihood; with no training rows
every document is ``und``; texts are read whole, at any length; repeated rows and null or repeated
ids get results like any others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAMS = 1 << 15
UNKNOWN = "und"
#: Bytes below 128 that are not letters become a space; letters of other scripts stay as they are.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, in order."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(PLAIN), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    mixed = (a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Smoothed trigram probabilities: language ``column[i]`` gives trigram g ``floor[column[i]] + more[i]`` for i from ``start[g]`` to ``start[g + 1]``, all others their floor."""

    languages: list[str]
    floor: np.ndarray
    start: np.ndarray
    column: np.ndarray
    more: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of the trigrams ``at`` under every language."""
        many = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        out = np.tile(self.floor, (len(at), 1))
        out[np.repeat(np.arange(len(at)), many), self.column[entry]] += self.more[entry]
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """The model of labelled rows, whose number is bounded; only their trigram counts per language reach the driver."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                sums[lang] += np.bincount(grams(text), minlength=GRAMS)
            if len(sums) > 64:
                yield from tallied(sums)
                sums = {}
        yield from tallied(sums)

    def tallied(sums):
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    column = np.searchsorted(np.array(languages, dtype=object), counts["lang"].to_numpy(object)) if languages else np.zeros(0, np.int64)
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    total = np.bincount(column, n, len(languages)) + smoothing * GRAMS
    order = np.lexsort((column, gram))
    start = np.r_[0, np.cumsum(np.bincount(gram, minlength=GRAMS))]
    return Model(languages, smoothing / total, start, column[order], (n / total[column])[order])


def em(p: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood) of a mixture with components ``p`` (slots x languages)."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(rounds if p.shape[1] > 1 else 0):
        joint = p * share
        new = (weight / joint.sum(axis=1)) @ joint
        new /= new.sum()
        close, share = np.abs(new - share).max() < 1e-3, new
        if close:
            break
    return share, float(weight @ np.log(p @ share))


def infer(text: str | None, model: Model, penalty: float, rounds: int) -> tuple[list[int], np.ndarray] | None:
    """(selected language numbers, largest share first; shares under all languages), or None if undetermined."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return None
    n = np.bincount(grams(text), minlength=GRAMS)
    at = np.flatnonzero(n)
    if not len(at):
        return None
    p, weight = model.rows(at), n[at].astype(np.float64)
    share, _ = em(p, weight, rounds)
    single = weight @ np.log(p)
    chosen, reached = [int(np.argmax(single))], float(single.max())
    own = np.ones(1)
    price = penalty * np.log(weight.sum() + 1)
    for j in map(int, np.argsort(-share)):
        if j in chosen or share[j] < 0.01:
            continue
        mixed, gained = em(p[:, [*chosen, j]], weight, rounds)
        if gained - reached <= price:
            break
        chosen, reached, own = [*chosen, j], gained, mixed
    order = np.argsort(-own, kind="stable")
    return [chosen[i] for i in order], share


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", penalty: float = 8.0, rounds: int = 12) -> DataFrame:
    """Columns ``keep`` plus lang_pred, score (the predicted language's share), langs (the selected set, largest first) and explained (the set's share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))

    def label(batches):
        languages = shared.value.languages
        for batch in batches:
            found = [infer(t, shared.value, penalty, rounds) for t in batch.column(len(keep)).to_pylist()]
            langs = [[languages[j] for j in x[0]] if x else [] for x in found]
            share = lambda x, chosen: min(1.0, max(0.0, float(x[1][chosen].sum())))
            score = [share(x, x[0][:1]) if x else 0.0 for x in found]
            explained = [share(x, x[0]) if x else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array([x[0] if x else UNKNOWN for x in langs], pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(explained, pa.float64())],
                names=[*keep, "lang_pred", "score", "langs", "explained"],
            )

    schema = source.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("langs", T.ArrayType(T.StringType())).add("explained", "double")
    return source.mapInArrow(label, schema)


def documents_with_language(docs: DataFrame, least_share: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have no language: undetermined ones, and those of which the selected languages together explain less than ``least_share``."""
    names = docs.columns
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    found = language_of_documents(whole, id_col, text_col, keep=["_row", id_col])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("explained") >= least_share)).select("_row.*")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows if there are at most ``max_rows``, else about as many, by a hash of all their columns."""
    total = rows.count()
    if total <= max_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(5), *rows.columns), F.lit(1_000_003)) < int(1_000_003 * max_rows / total))


def language_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 60_000, keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows that are not held out, predict every row: ``keep`` (default: the id), held_out, lang_pred, score, langs, explained.

    ``held_out``: crc32(id as text) mod 4 is 2.
    """
    held = id_remainder(id_col, 4) == 2
    training = bounded_rows(docs.where(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col), max_rows)
    keep = keep or [id_col]
    found = predict(docs, fit(training, text_col, lang_col), keep, text_col)
    return found.select(*keep, held.alias("held_out"), "lang_pred", "score", "langs", "explained")
