"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern; the flow
network has one node per pattern and one per source. A pattern offers its words once per repetition
level, and later levels cost more (convex costs), so words are repeated only where a quota cannot be
met otherwise. Pattern-source arcs follow membership, and each source drains at most its quota. The
solved flow gives the words that each pattern delivers; documents of the pattern are then taken in
seeded order: whole passes first, then documents up to the remaining words, the last one in part.

Patterns, sources, targets and flows are DataFrames of any length. Targets come from one water level
that a few aggregations find. Patterns and sources that are connected form one flow problem, solved
in one task; where no document has two sources, every source is a problem of its own. Running sums
over a pattern's documents are split by ranges of the seeded order.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null
membership is an empty one; a document without words or sources is taken with 0 words; an empty
table gives an empty result; repeated rows are documents of their own. The seeded order goes by id
and text, so rows with null or repeated ids differ in it unless their texts are equal too, and then
any of them may be the one that is taken. Very long texts are only counted and hashed. Other columns
are not read by ``mix_sources`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.graph import components, join_unique
from strandmill.operators.dataset import numbered, running_sum
from strandmill.sources.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Most patterns that are broadcast to the documents; more are joined by shuffling.
SMALL = 20_000


def word_count(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle=(5, 2, 1)) -> DataFrame:
    """``sources`` with a weight: by code point order, null last, repeating ``cycle``."""
    placed = numbered(sources.withColumn("_all", F.lit(0)), "_all", [F.col("source").isNull(), F.col("source")], "_place").drop("_all")
    weight = F.element_at(F.array(*map(F.lit, map(float, cycle))), ((F.col("_place") - 1) % len(cycle) + 1).cast("int"))
    return placed.withColumn("weight", weight).drop("_place")


def capped_targets(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """``sources`` (stored; source, size, weight) with target: ``total`` split by weight; no share exceeds ``cap`` times its source's size, and what is above is shared again by weight.

    Every target is the smaller of its cap and the level times its weight. The level only rises from
    round to round, so one number is all that rounds pass on.
    """
    sources = sources.withColumn("most", F.lit(float(cap)) * F.col("size"))
    level, full = 0.0, -1
    while True:
        closed = F.col("most") < F.col("weight") * F.lit(level)
        open_weight, capped, now = sources.where("weight > 0").agg(F.sum(F.when(~closed, F.col("weight"))), F.sum(F.when(closed, F.col("most"))), F.count_if(closed)).first()
        if not open_weight or now == full:
            break
        level, full = (total - (capped or 0.0)) / open_weight, now
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least("most", F.col("weight") * F.lit(level))).otherwise(0.0)).drop("most")


def min_cost_flow(supplies: list[int], members: list[tuple], quotas: dict, costs: list[int]) -> list[dict]:
    """Words from pattern i to source s, as one dict per pattern, at the least cost of the largest flow.

    ``supplies[i]`` words are on offer once per entry of the rising ``costs``. Costs are small whole
    numbers, so few different path costs occur: for each of them in turn, all paths of that cost are
    filled at once by blocking flows, which are cheap.
    """
    sources = list(quotas)
    place = {s: 1 + len(supplies) + j for j, s in enumerate(sources)}
    sink = 1 + len(supplies) + len(sources)
    head: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(head))
            head.append(y)
            room.append(c)
            price.append(w)

    links = []
    for i, words in enumerate(supplies):
        for cost in costs:
            arc(0, 1 + i, words, cost)
        for s in members[i]:
            links.append((i, s, len(head)))
            arc(1 + i, place[s], words * len(costs), 0)
    for s, quota in quotas.items():
        arc(place[s], sink, quota, 0)

    def distances() -> list[float]:
        far, queue, queued = [math.inf] * (sink + 1), deque([0]), [False] * (sink + 1)
        far[0] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for k in out[a]:
                b = head[k]
                if room[k] and far[a] + price[k] < far[b]:
                    far[b] = far[a] + price[k]
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        return far

    while (far := distances())[sink] < math.inf:
        tight = lambda k, a: room[k] and far[head[k]] == far[a] + price[k]  # noqa: B023, E731
        while True:
            # Hops within arcs of cheapest paths; a blocking flow uses those that go one hop on.
            hops, queue = [-1] * (sink + 1), deque([0])
            hops[0] = 0
            while queue:
                a = queue.popleft()
                for k in out[a]:
                    if hops[head[k]] < 0 and tight(k, a):
                        hops[head[k]] = hops[a] + 1
                        queue.append(head[k])
            if hops[sink] < 0:
                break
            tried, path, a = [0] * (sink + 1), [], 0
            while True:
                if a == sink:
                    push = min(room[k] for k in path)
                    for k in path:
                        room[k] -= push
                        room[k ^ 1] += push
                    cut = next(i for i, k in enumerate(path) if not room[k])
                    a = head[path[cut] ^ 1]
                    del path[cut:]
                while tried[a] < len(out[a]):
                    k = out[a][tried[a]]
                    if hops[head[k]] == hops[a] + 1 and tight(k, a):
                        break
                    tried[a] += 1
                if tried[a] < len(out[a]):
                    path.append(out[a][tried[a]])
                    a = head[path[-1]]
                elif path:
                    a = head[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
    flows: list[dict] = [{} for _ in supplies]
    for i, s, k in links:
        if room[k ^ 1]:
            flows[i][s] = room[k ^ 1]
    return flows


def _key(source: Column) -> Column:
    """A source's name as a key; null has its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def route(patterns: DataFrame, quotas: DataFrame, costs: list[int]) -> DataFrame:
    """(members, source, words): the flow from ``patterns`` (members, words) to ``quotas`` (source, quota), by connected patterns and sources."""
    names = patterns.where(F.size("members") > 0).select("members", "words", F.array_sort(F.transform("members", _key)).alias("keys"))
    links = names.where(F.size("keys") > 1).select(F.element_at("keys", 1).alias("a"), F.explode("keys").alias("b"))
    roots = components(links)
    placed = lambda df, key: df.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key)).drop(key)
    offers = placed(names.withColumn("key", F.element_at("keys", 1)).drop("keys"), "key")
    wanted = placed(quotas.select("source", "quota", _key(F.col("source")).alias("key")), "key")

    def solve(offers: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        members = [tuple(m) for m in offers["members"]]
        order = sorted(range(len(members)), key=lambda i: [(s is None, s or "") for s in members[i]])
        members, words = [members[i] for i in order], [int(offers["words"].iloc[i]) for i in order]
        goals = {None if pd.isna(s) else s: int(q) for s, q in zip(wanted["source"], wanted["quota"])}
        goals = dict(sorted(goals.items(), key=lambda x: (x[0] is None, x[0] or "")))
        found = [(list(m), s, n) for m, flow in zip(members, min_cost_flow(words, members, goals, costs)) for s, n in flow.items()]
        return pd.DataFrame(found, columns=["members", "source", "words"])

    solved = offers.groupBy("root").cogroup(wanted.groupBy("root")).applyInPandas(solve, "members array<string>, source string, words long")
    return written(solved, "mix-flows")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Column | None = None,
    membership: Column | None = None,
    weights=cycled_weights,
    total_share: float = 1.0,
    max_repeat: int = 3,
    seed: int = 29,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, flows), all stored but the first.

    rows: id, members (array of source names), size, taken (words, repeats counted), key (seeded
    order), passes and part (words of the last pass). targets: source, size, weight, target. flows:
    members, source, words. ``membership`` is an array of source names (default: the one ``source``),
    ``weights`` adds a weight to (source, size), ``total_share`` is the part of all words to mix.
    """
    size = word_count(text_col) if size is None else size
    rows = docs.select(F.col(id_col).alias("id"), _members(membership).alias("members"), size.alias("size"), seeded_key(id_col, text_col, seed).alias("key"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows, "mix-rows")
    patterns = written(rows.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-patterns")
    total, many = patterns.agg(F.sum("words"), F.sum("docs")).first()
    sources = patterns.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size"))
    targets = written(capped_targets(written(weights(sources), "mix-sources"), total_share * (total or 0), max_repeat), "mix-targets")
    flows = route(patterns, targets.select("source", F.bround("target").cast("long").alias("quota")), [k * k for k in range(max_repeat)])

    given = flows.groupBy("members").agg(F.sum("words").alias("given"))
    plan = patterns.join(given, "members", "left").select("members", "docs", F.coalesce(F.try_divide(F.col("given") - F.col("given") % F.col("words"), F.col("words")), F.lit(0)).cast("long").alias("passes"), F.coalesce(F.try_mod("given", "words"), F.lit(0)).alias("rest"))
    summed = running_sum(join_unique(rows, written(plan, "mix-plan"), ["members"], "docs", many or 0), "members", [F.col("key"), F.col("id"), F.col("rid")], F.col("size"), "upto")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size"))).cast("long")
    taken = (F.col("passes") * F.col("size") + part).cast("long")
    return summed.select(F.col("id").alias(id_col), "members", "size", taken.alias("taken"), "key", "passes", part.alias("part")), targets, flows


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", membership: Column | None = None, seed: int = 29, **options) -> DataFrame:
    """The mix as documents, columns unchanged: a document that is taken several times is repeated, one taken in part is whole.

    In seeded order the last pass takes all documents up to one key per pattern, so each row decides
    for itself once those keys are known; texts are shuffled only where there are more than ``SMALL``
    patterns. Documents without words are left out.
    """
    rows = written(mix_sources(docs, id_col, text_col, word_count(text_col), membership, seed=seed, **options)[0], "mix-taken")
    last = rows.groupBy("members").agg(F.max("passes").alias("passes"), F.max(F.when(F.col("part") > 0, F.col("key"))).alias("last"), F.count("*").alias("docs"))
    # Rows with one key have equal ids and texts; ``room`` of these ``tied`` rows are taken by the last pass.
    at_last = rows.groupBy("members", "key").agg(F.count("*").alias("tied"), F.count_if(F.col("part") > 0).alias("room")).where("tied > 1 and room > 0 and room < tied")
    ends = written(last.join(at_last.withColumnRenamed("key", "last"), ["members", "last"], "left"), "mix-ends")
    names = docs.columns
    whole = docs.where(F.col(text_col).rlike(WORD)).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _members(membership).alias("members"), seeded_key(id_col, text_col, seed).alias("key"))
    many, most, ties = ends.agg(F.count("*"), F.sum("docs"), F.count("tied")).first()
    placed = whole.join(F.broadcast(ends.drop("docs")), "members") if many <= SMALL else join_unique(whole, ends, ["members"], "docs", most)
    split = F.col("tied").isNotNull() & (F.col("key") == F.col("last"))
    repeated = lambda df, taken: df.select("row", F.explode(F.array_repeat(F.lit(1), (F.col("passes") + F.when(taken, 1).otherwise(0)).cast("int")))).select("row.*")
    out = repeated(placed.where(~split) if ties else placed, F.col("key") <= F.col("last"))
    if not ties:
        return out
    equal = written(placed.where(split).withColumn("rid", F.monotonically_increasing_id()), "mix-tied")
    return out.unionByName(repeated(numbered(equal, "members", [F.col("rid")], "turn"), F.col("turn") <= F.col("room")))


def seeded_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _members(membership: Column | None) -> Column:
    given = F.array(F.col("source")) if membership is None else F.coalesce(membership, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(given))
