"""Recombining fragments into examples: draws of groups, libraries and fragments that depend on (example, salt) alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.text import fold_token, hash_int
from strandmill.operators.dataset import companion_bounds, companion_count, numbered
from strandmill.sources.shared import written

#: The pool that an example's one decisive fragment comes from; a structural null has none.
DECISIVE = {"true": "positive", "false": "negative", "null_ambiguous": "ambiguous"}
# Words of negation, person, time and modality that noise never touches, and the longest signal word that it spares.
STRUCTURAL_WORDS = (
    "no", "not", "never", "none", "nothing", "without", "nor", "nope", "dont", "don't", "didnt", "didn't", "havent", "haven't", "hasnt", "hasn't",
    "isnt", "isn't", "wasnt", "wasn't", "arent", "aren't", "cant", "can't", "couldnt", "couldn't", "wouldnt", "wouldn't", "wont", "won't",
    "i", "im", "i'm", "ive", "i've", "my", "me", "he", "she", "they", "his", "her", "their", "him", "them", "son", "daughter", "wife", "husband",
    "mum", "mother", "dad", "father", "partner", "nan", "gran", "he's", "hes", "she's", "shes",
    "had", "has", "have", "was", "were", "is", "am", "are", "been", "did", "does", "do", "ago", "last", "since", "yesterday", "today", "tonight",
    "now", "then", "before", "after", "week", "weeks", "day", "days", "month", "months",
    "maybe", "might", "may", "could", "think", "thought", "feel", "felt", "seems", "seemed", "probably", "possibly", "bit", "slightly", "really", "very",
)
LONGEST_SPARED = 5


def _draw(salt: str | Column, *key: Column) -> Column:
    return hash_int(F.concat_ws("|", F.col("example_id").cast("string"), F.lit(salt), *key))


def distinct_groups(groups: Column, count: Column, salt: str) -> Column:
    """``count`` different elements of an array, every choice alike; more than there are raise an error."""
    shuffled = F.array_sort(F.transform(groups, lambda g: F.struct(_draw(salt, F.lit("group"), g).alias("h"), g.alias("g"))))
    taken = F.slice(shuffled, F.lit(1), F.greatest(count, F.lit(0)).cast("int"))["g"]
    return F.when(count > F.size(groups), F.raise_error(F.lit("more groups are wanted than there are")).cast("array<string>")).otherwise(taken)


def draw_picks(wanted: DataFrame, pool: DataFrame, salt: str, keep: list[str]) -> DataFrame:
    """(scope, example_id, keep, kind, group, library, fragment_id): for each wanted pick a library of its group, then a fragment of that, each choice alike.

    ``wanted`` has (scope, example_id, keep, picks: array of kind and group), ``pool`` (scope, kind,
    group, library, fragment_id); a kind draws under a salt of its own. Fragments are numbered in their
    library by many tasks, and met by number: the pool and its libraries are stored, so Spark knows
    their sizes and broadcasts them while they are small. A group without fragments raises an error.
    """
    at = ["scope", "kind", "group", "library"]
    sizes = pool.groupBy(*at).agg(F.count("*").alias("many"))
    # Libraries are declared by hand, so an array holds those of a group.
    libraries = written(sizes.groupBy(*at[:3]).agg(F.array_sort(F.collect_list(F.struct("library", "many"))).alias("libraries")), "libraries")
    placed = written(numbered(pool.withColumn("_pool", F.concat_ws("/", *at)), "_pool", [F.col("fragment_id")], "place").select(*at, "place", "fragment_id"), "pool")
    own = lambda p, what: _draw(F.concat(F.lit(salt), p["kind"]), F.lit(what), p["group"])
    # Hashed inside the array, which the outer form takes apart: Spark copies what lies below an inner one, or a join's key, into filters, and would hash it several times.
    hashed = F.transform("picks", lambda p: F.struct(p["kind"].alias("kind"), p["group"].alias("group"), own(p, "library").alias("_library"), own(p, "fragment").alias("_fragment")))
    draws = wanted.select("scope", "example_id", *keep, F.inline_outer(hashed)).where("kind is not null").join(libraries, at[:3], "left")
    some = F.coalesce("libraries", F.raise_error(F.concat(F.lit("no fragments of "), "scope", F.lit("/"), "group")).cast(libraries.schema["libraries"].dataType))
    picked = F.element_at(some, (F.col("_library") % F.size(some) + 1).cast("int"))
    draws = draws.select("scope", "example_id", *keep, "kind", "group", "_fragment", picked.alias("p")).select("scope", "example_id", *keep, "kind", "group", F.col("p.library").alias("library"), (F.col("_fragment") % F.col("p.many") + 1).alias("place"))
    return draws.join(placed, [*at, "place"]).drop("place")


def picks(kind: str, groups: Column) -> Column:
    """``groups`` as picks of one kind."""
    return F.transform(groups, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("group")))


def draw_fragments(wanted: DataFrame, pool: DataFrame, salt: str) -> DataFrame:
    """``draw_picks`` of one kind: (scope, example_id, group, library, fragment_id) of ``wanted`` (scope, example_id, groups array)."""
    given = wanted.select("scope", "example_id", picks("", F.col("groups")).alias("picks"))
    return draw_picks(given, pool.withColumn("kind", F.lit("")), salt, []).drop("kind")


def draw_companions(wanted: DataFrame, pool: DataFrame, signals: list[str], salt: str) -> DataFrame:
    """Companions of examples (scope, example_id, companions: how many): a foreign signal each, no signal twice, then a library, then a fragment.

    Neither the label nor its mode is an input, so that companions tell nothing of it.
    """
    chosen = distinct_groups(F.array(*map(F.lit, sorted(signals))), F.col("companions"), f"{salt}c")
    return draw_fragments(wanted.select("scope", "example_id", chosen.alias("groups")), pool, f"{salt}c")


def select_fragments(examples: DataFrame, decisive: DataFrame, companions: DataFrame, fillers: DataFrame, signals: list[str], libraries: list[str], salt: str, share: float = 0.5) -> DataFrame:
    """(scope, example_id, mode, companions, fragment_ids): one decisive fragment (none for a structural null), companions, fillers of different libraries, shuffled.

    ``examples`` has (scope, example_id, mode, fragments: how many), one row each; the pools have (scope,
    group, library, fragment_id), where the group is the decisive role, the companion's signal or the
    filler's library. All kinds are drawn together, and examples are shuffled once, by their id.
    """
    low, high = companion_bounds(F.col("fragments"), len(signals), len(libraries))
    spec = examples.withColumn("companions", companion_count(low, high.cast("int"), share, F.col("example_id").cast("string"), F.lit(f"{salt}n")))
    role = F.coalesce(*[F.when(F.col("mode") == m, F.lit(r)) for m, r in DECISIVE.items()])
    rest = F.col("fragments") - F.col("companions") - role.isNotNull().cast("int")
    own = picks("d", F.array_compact(F.array(role)))
    others = picks("c", distinct_groups(F.array(*map(F.lit, sorted(signals))), F.col("companions"), f"{salt}c"))
    filling = picks("f", distinct_groups(F.array(*map(F.lit, sorted(libraries))), rest, f"{salt}f"))
    pool = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in (("d", decisive), ("c", companions), ("f", fillers))])
    keep = ["mode", "companions"]
    drawn = draw_picks(spec.select("scope", "example_id", *keep, F.concat(own, others, filling).alias("picks")), pool, salt, keep)
    order = F.array_sort(F.collect_list(F.struct(_draw(salt, F.lit("order"), F.col("fragment_id").cast("string")).alias("h"), "fragment_id")))
    made = drawn.groupBy("scope", "example_id").agg(*[F.first(c).alias(c) for c in keep], order["fragment_id"].alias("fragment_ids"))
    return made.select("scope", "example_id", *keep, "fragment_ids")


def noise_lexicon(words: DataFrame, mode: str = "short") -> DataFrame:
    """(signal, word, state) of signals' terms (signal, term): frozen or damageable; structural words are frozen for every signal.

    ``short`` freezes words of up to five letters, ``all`` every one.
    """
    if mode not in ("short", "all"):
        raise ValueError(f"unknown freeze mode {mode!r}")
    own = words.select("signal", F.explode(F.split("term", r"\s+")).alias("word")).select("signal", fold_token(F.col("word")).alias("word")).where("word <> ''")
    structural = own.select("signal").distinct().withColumn("word", F.explode(F.array(*map(F.lit, STRUCTURAL_WORDS))))
    frozen = F.col("word").isin(*STRUCTURAL_WORDS) | F.lit(mode == "all") | (F.length("word") <= LONGEST_SPARED)
    return own.unionByName(structural).distinct().withColumn("state", F.when(frozen, "frozen").otherwise("damageable"))
