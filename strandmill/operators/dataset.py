"""Building labelled datasets: pools, label vectors, generation by hash draws, noise, merging."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.text import assemble, hash_int, normalise_text, whitespace_count
from strandmill.sources.shared import written

# Neighbours on a QWERTY keyboard, and weights of the word and text edits.
NEIGHBOURS = {
    "q": "was", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl", "o": "ipkl",
    "p": "ol", "a": "qwszx", "s": "qweadzxc", "d": "wersfxcv", "f": "ertdgcvb", "g": "rtyfhvbn", "h": "tyugjbnm", "j": "yuihknm",
    "k": "uiojlm", "l": "iopk", "z": "asx", "x": "zasdc", "c": "xsdfv", "v": "cdfgb", "b": "vfghn", "n": "bghjm", "m": "nhjk",
}
WORD_WEIGHTS = {"drop_apostrophe": 0.25, "lowercase": 0.25, "drop_letter": 0.15, "double_letter": 0.10, "transpose": 0.10, "neighbour": 0.15}
TEXT_WEIGHTS = {"drop_terminal": 1.0, "drop_space": 0.5, "lowercase_all": 0.5}
SHAPE_KEEPING = ("drop_apostrophe", "lowercase")
REDRAWS = 3


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return hash_int(F.concat_ws("|", *key)) / F.lit(4294967296.0)


def first_wins(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per normalised text: the first in ``order``. Digests are shuffled, and of each text's rows one a task."""
    w = Window.partitionBy(F.sha2(normalise_text(F.col(text)), 256)).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def pool_role(signal: str) -> Column:
    """Role of a fragment (signal_key, kind, null_on array) for a signal: its own kinds, filler if declared silent, companion if another signal's and declared silent."""
    own, silent = F.col("signal_key") == signal, F.array_contains("null_on", signal)
    return F.when(own & F.col("kind").isin("positive", "negative"), F.col("kind")).when(own, "ambiguous").when(F.col("signal_key").isNull() & silent, "filler").when(silent, "companion")


def label_vectors(parts: DataFrame, fragments: DataFrame, signals: list[str], decided: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(example_id, labels map): no key where some fragment says nothing about the signal, null where all are declared silent, else what one asserts.

    ``parts`` has example_id, fragment_id; ``fragments`` fragment_id, signal_key, asserts (boolean),
    null_on (array). Two fragments of an example that assert one signal raise an error, whether they
    agree or not. ``decided`` (example_id, signal, expected) tells what an example's own signal must come
    out as; a vector without that key, or with another value, raises one too.
    ``tasks`` says how many tasks share the parts; by default Spark does, whatever their number.
    """
    dealt = lambda df, key: df.repartition(tasks, key) if tasks else df
    own = lambda s: F.col("signal_key").eqNullSafe(F.lit(s))
    # One row an example holds all signals, in columns of fixed width.
    told = [F.struct(F.every(own(s) | F.array_contains("null_on", s)).alias("declared"), F.max(F.when(own(s), F.col("asserts"))).alias("value"), (F.count_if(own(s)) > 1).alias("several")).alias(f"_s{i}") for i, s in enumerate(signals)]
    met = dealt(parts, "fragment_id").join(dealt(fragments, "fragment_id"), "fragment_id")
    per = dealt(met, "example_id").groupBy("example_id").agg(*told)
    if decided is not None:
        known = decided.where(F.col("signal").isin(*signals)).groupBy("example_id").agg(F.collect_list(F.struct("signal", "expected")).alias("_told"))
        per = per.join(known, "example_id", "left")
    entries = []
    for i, s in enumerate(signals):
        at = F.col(f"_s{i}")
        # Soundness is looked at for masked signals too.
        sound = F.when(at["several"], F.raise_error(F.lit("two fragments assert a signal")).cast("boolean")).otherwise(at["value"])
        if decided is not None:
            amiss = F.exists("_told", lambda t: (t["signal"] == s) & ~(at["declared"] & at["value"].eqNullSafe(t["expected"])))
            sound = F.when(F.coalesce(amiss, F.lit(False)), F.raise_error(F.lit("a label vector differs from what was decided")).cast("boolean")).otherwise(sound)
        entries.append(F.struct(F.lit(s).alias("signal"), sound.alias("value"), at["declared"].alias("declared")))
    order = sorted(range(len(signals)), key=lambda i: signals[i])
    found = per.select("example_id", F.transform(F.filter(F.array(*[entries[i] for i in order]), lambda e: e["declared"]), lambda e: F.struct(e["signal"], e["value"])).alias("_entries"))
    return found.select("example_id", F.map_from_entries("_entries").alias("labels"))


def label_mode(draw: Column, ambiguous: Column, shares: tuple[float, float] = (0.35, 0.35), ambiguous_share: float = 0.5) -> Column:
    """true, false, or one of the null modes, from two uniform draws."""
    return F.when(draw < shares[0], "true").when(draw < shares[0] + shares[1], "false").when(ambiguous < ambiguous_share, "null_ambiguous").otherwise("null_structural")


def companion_bounds(n: Column, signals: int, fillers: int) -> tuple[Column, Column]:
    """(lower, upper) number of companions of an example with n other fragments."""
    return F.greatest(F.lit(0), n - fillers), F.least(n - 1, F.lit(signals))


def binomial_draw(upper: Column, share: float, *key: Column) -> Column:
    """Sum of ``upper`` Bernoulli draws by hash; none are made at share 0."""
    if share == 0:
        return F.lit(0)
    return F.when(upper <= 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(upper, F.lit(1))), lambda i: uniform(*key, i.cast("string")) < share)))


def companion_count(low: Column, high: Column, share: float, *key: Column) -> Column:
    """Companions of an example: the binomial draw, but no fewer than ``low``; at share 0 a lower bound above 0 is an error."""
    if share <= 0:
        return F.when(low > 0, F.raise_error(F.lit("companions are needed, but their share is 0")).cast("int")).otherwise(0)
    return F.greatest(low, binomial_draw(high, share, *key))


def generate(pools: DataFrame, count: int, seed: str, attempts: int = 50) -> DataFrame:
    """``count`` examples (index, mode, fragment_ids, text) whose normalised texts all differ.

    ``pools`` (stored; fragment_id, role, text) is numbered per role. A draw depends on (seed, index,
    attempt) alone. Indexes whose text was taken by a smaller one draw again, all in one round, until
    none is left; more than ``attempts`` rounds raise an error.
    """
    spark = pools.sparkSession
    numbered = written(pools.withColumns({"place": F.row_number().over(Window.partitionBy("role").orderBy("fragment_id")) - 1, "many": F.count("*").over(Window.partitionBy("role"))}), "pools")
    sizes = {r.role: r.many for r in numbered.select("role", "many").distinct().collect()}
    if "filler" not in sizes:
        raise ValueError("no filler to build from")
    done, open_ = None, spark.range(count).select(F.col("id").alias("index"))
    for attempt in range(attempts + 1):
        key = lambda what: (F.lit(seed), F.col("index").cast("string"), F.lit(str(attempt)), F.lit(what))
        spec = open_.withColumn("mode", label_mode(uniform(F.lit(seed), F.col("index").cast("string"), F.lit("mode")), uniform(F.lit(seed), F.col("index").cast("string"), F.lit("null"))))
        role = F.when(F.col("mode") == "true", "positive").when(F.col("mode") == "false", "negative").when(F.col("mode") == "null_ambiguous", "ambiguous").otherwise("filler")
        wanted = spec.withColumn("slot", F.explode(F.array(F.struct(F.lit(0).alias("slot"), role.alias("role")), *[F.struct(F.lit(i).alias("slot"), F.lit("filler").alias("role")) for i in (1, 2)])))
        many = F.coalesce(*[F.when(F.col("slot.role") == r, F.lit(n)) for r, n in sizes.items()])
        wanted = wanted.select("index", "mode", "slot.slot", "slot.role", F.pmod(hash_int(F.concat_ws("|", *key("draw"), F.col("slot.slot").cast("string"))), many).cast("int").alias("place"))
        drawn = wanted.join(numbered.select("role", "place", "fragment_id", "text"), ["role", "place"])
        order = F.array_sort(F.collect_list(F.struct(hash_int(F.concat_ws("|", *key("order"), F.col("slot").cast("string"))).alias("h"), "slot", "fragment_id", "text")))
        made = drawn.groupBy("index", "mode").agg(order.alias("f")).select("index", "mode", F.col("f.fragment_id").alias("fragment_ids"), assemble(F.col("f.text")).alias("text"))
        made = made.withColumn("norm", normalise_text(F.col("text")))
        if done is not None:
            made = made.join(done.select("norm"), "norm", "left_anti")
        fresh = made.withColumn("first", F.min("index").over(Window.partitionBy("norm"))).where("index = first").select("index", "mode", "fragment_ids", "text", "norm")
        done = written(fresh if done is None else done.unionByName(fresh), "generated")
        open_ = spark.range(count).select(F.col("id").alias("index")).join(done.select("index"), "index", "left_anti")
        if open_.isEmpty():
            return done.drop("norm")
    raise ValueError("some examples found no unused text")


def damage(word: str, rng: random.Random, frozen: frozenset[str]) -> tuple[str, str | None]:
    """At most one edit of a word; edits of letters never touch a frozen word nor make one."""
    bare = lambda w: w.lower().strip(".,;:!?\"()")
    for _ in range(REDRAWS + 1):
        name = rng.choices(list(WORD_WEIGHTS), weights=list(WORD_WEIGHTS.values()))[0]
        if name not in SHAPE_KEEPING and bare(word) in frozen:
            continue
        letters = [i for i, c in enumerate(word) if c.isalpha()]
        new = None
        if name == "lowercase":
            new = word.lower()
        elif name == "drop_apostrophe":
            marks = [i for i, c in enumerate(word) if c in "'‘’"]
            new = word[: (i := rng.choice(marks))] + word[i + 1 :] if marks else None
        elif name == "drop_letter" and len(letters) > 1:
            new = word[: (i := rng.choice(letters))] + word[i + 1 :]
        elif name == "double_letter" and letters:
            new = word[: (i := rng.choice(letters)) + 1] + word[i:]
        elif name == "transpose":
            pairs = [i for i in letters if i + 1 in letters and word[i] != word[i + 1]]
            new = word[: (i := rng.choice(pairs))] + word[i + 1] + word[i] + word[i + 2 :] if pairs else None
        elif name == "neighbour":
            near = [i for i in letters if word[i].lower() in NEIGHBOURS]
            if near:
                i = rng.choice(near)
                c = rng.choice(NEIGHBOURS[word[i].lower()])
                new = word[:i] + (c.upper() if word[i].isupper() else c) + word[i + 1 :]
        if new and new != word and (name in SHAPE_KEEPING or bare(new) not in frozen):
            return new, name
    return word, None


def add_noise(df: DataFrame, id_col: str, text_col: str, rate: float, seed: str, frozen: frozenset[str] = frozenset(), clean_share: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns to ``keep``, noisy text and the edits made; each row's draws depend on (seed, id) alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ops = [], []
            for key, text in zip(batch[id_col], batch[text_col]):
                rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}|{key}".encode()).digest(), "big"))
                made: list[str] = []
                if text and rng.random() >= clean_share:
                    words = text.split(" ")
                    for i, w in enumerate(words):
                        if w and rng.random() < rate:
                            words[i], name = damage(w, rng, frozen)
                            made += [name] if name else []
                    text = " ".join(words)
                    for name, weight in TEXT_WEIGHTS.items():
                        if rng.random() < min(1.0, rate * len(words) * weight):
                            new = text.rstrip(".!?") if name == "drop_terminal" else text.lower() if name == "lowercase_all" else _drop_space(text, rng, frozen)
                            if new and new != text:
                                text = new
                                made.append(name)
                texts.append(text)
                ops.append(made)
            yield pd.DataFrame({c: batch[c] for c in (id_col, *keep)} | {"text": texts, "edits": ops})

    source = df.select(id_col, *keep, text_col)
    kept = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return source.mapInPandas(run, f"{kept}, text string, edits array<string>")


def noise_tree_violations(sidecars: DataFrame, signals: list[str], agree: list[str]) -> DataFrame:
    """(fold, split, fault): files damaged before, files of a signal without frozen words, and fields on which files disagree (fold and split null).

    ``sidecars`` has (fold, split, signal, noised) and the fields to ``agree`` on; nulls are a value of their own.
    """
    known = F.coalesce(F.col("signal").isin(signals), F.lit(False))
    faults = F.array_compact(F.array(F.when(F.col("noised"), F.lit("noised before")), F.when(~known, F.lit("no frozen words"))))
    files = sidecars.select("fold", "split", F.explode(faults).alias("fault"))
    kinds = sidecars.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in agree])
    fields = kinds.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(f"disagree on {c}")) for c in agree]))).alias("fault"))
    return files.unionByName(fields, allowMissingColumns=True)


def noise_tree(examples: DataFrame, sidecars: DataFrame, rate: float, seed: str, frozen: dict[str, frozenset[str]], clean_share: float, agree: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Noisy examples of all files, and their files' new sidecars.

    ``examples`` has (fold, split, example_id, text) and columns that pass through; ``sidecars`` one row
    a file (see ``noise_tree_violations``). A file's signal names the words that stay ``frozen``. Raises
    on a tree that breaks a rule. Sidecars (fold, split, signal, noised, examples, untouched, edits,
    words, edits_per_100_words, edits_by_kind) are counted on the noisy texts; a file without examples has zeros.
    """
    if faults := noise_tree_violations(sidecars, list(frozen), list(agree)).limit(5).collect():
        raise ValueError(f"the tree cannot take noise: {[tuple(f) for f in faults]}")
    files = sidecars.select("fold", "split", "signal")
    keep = tuple(c for c in examples.columns if c not in ("example_id", "text"))
    # One row a file, and files are few.
    rows = examples.join(files.hint("broadcast"), ["fold", "split"])
    made = [add_noise(rows.where(F.col("signal") == signal), "example_id", "text", rate, seed, words, clean_share, (*keep, "signal")) for signal, words in frozen.items()]
    noisy = written(reduce(DataFrame.unionByName, made), "noisy-tree")
    per = noisy.groupBy("fold", "split").agg(F.count("*").alias("examples"), F.count_if(F.size("edits") == 0).alias("untouched"), F.sum(F.size("edits")).alias("edits"), F.sum(whitespace_count(F.coalesce("text", F.lit("")))).alias("words"))
    kinds = noisy.select("fold", "split", F.explode("edits").alias("kind")).groupBy("fold", "split", "kind").count()
    kinds = kinds.groupBy("fold", "split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("edits_by_kind"))
    told = files.join(per, ["fold", "split"], "left").join(kinds, ["fold", "split"], "left").fillna(0, ["examples", "untouched", "edits", "words"])
    rate_made = F.round(F.when(F.col("words") > 0, 100 * F.col("edits") / F.col("words")).otherwise(0.0), 4)
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    return noisy.select(*examples.columns, "edits"), told.select("fold", "split", "signal", F.lit(True).alias("noised"), "examples", "untouched", "edits", "words", rate_made.alias("edits_per_100_words"), F.coalesce("edits_by_kind", empty).alias("edits_by_kind"))


def _drop_space(text: str, rng: random.Random, frozen: frozenset[str]) -> str | None:
    words = text.split(" ")
    gaps = [i for i in range(len(words) - 1) if words[i].lower() not in frozen and words[i + 1].lower() not in frozen]
    if not gaps:
        return None
    i = rng.choice(gaps)
    return " ".join([*words[:i], words[i] + words[i + 1], *words[i + 2 :]])


def running_sum(df: DataFrame, group: str, order: list[Column], value: Column, total: str) -> DataFrame:
    """``total``: the sum of ``value`` over the rows of the group up to this one by ``order``; many tasks share a large group.

    Rows are dealt to ranges of (group, order), summed inside their range, and shifted by the
    group's sum in the ranges before. Orders without ties give the same sums every time.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order)) | {"_value": value}).repartitionByRange(group, *keys).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, "_range").agg(F.sum("_value").alias("_n"))
    offsets = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.sum("_n").over(before).alias("_offset"))
    # Of the groups in a range, the first alone can have begun before it: one row a range at most.
    offsets = F.broadcast(offsets.where("_offset is not null"))
    inside = Window.partitionBy(group, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_place", F.sum("_value").over(inside))
    met = placed.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")), "left")
    return met.withColumn(total, F.coalesce("_offset", F.lit(0)) + F.col("_place")).select(*df.columns, total)


def numbered(df: DataFrame, group: str, order: list[Column], number: str) -> DataFrame:
    """One-based gapless numbers within each group by ``order``; a large group is numbered by many tasks."""
    return running_sum(df, group, order, F.lit(1).cast("long"), number)


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Position within the group; rows sorted by (position, group) interleave the groups."""
    return numbered(df, group, [F.col(c) for c in order], "position")


def permute_labels(df: DataFrame, by: str, label: str, key: str, seed: str) -> DataFrame:
    """Labels dealt anew within each group of ``by``: the i-th row by key gets the label of the i-th row by hash; balances stay."""
    placed = numbered(df, by, [F.col(key)], "_place")
    dealt = numbered(df.select(by, F.col(label).alias("permuted"), key), by, [hash_int(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)], "_place").drop(key)
    return placed.join(dealt, [by, "_place"]).drop("_place")


def content_digests(df: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """(by, digest): SHA-256 over a group's (key, text) pairs in their order; pairs with a null count for nothing.

    Rows come sorted and are hashed one after another, so no group is ever held as a whole. SHA-256
    over one sequence has no parallel form: a group is read by one task, in batches.
    """
    rows = df.select(*by, F.concat(F.col(key).cast("string"), F.lit("\x1f"), F.col(text), F.lit("\x1f")).alias("_pair"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_key", "_text").drop("_key", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        show = lambda: pd.DataFrame([(*now, digest.hexdigest())], columns=[*by, "digest"])
        for batch in batches:
            for *group, pair in batch.itertuples(index=False, name=None):
                group = [None if pd.isna(g) else g for g in group]
                if group != now:
                    if digest:
                        yield show()
                    now, digest = group, hashlib.sha256()
                if pair is not None:
                    digest.update(pair.encode())
        if digest:
            yield show()

    return rows.mapInPandas(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", digest string")
