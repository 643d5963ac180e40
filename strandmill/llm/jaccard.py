"""Set-similarity join of texts on word shingles, by token-combination prefixes.

A text's set holds the hashes of its distinct word shingles; equal sets collapse to one node, so
copies are never paired. Tokens (shingles) are ordered rare ones first, and a set indexes a prefix:
any partner at the wanted Jaccard similarity must share something in it.

* Rare tokens (document frequency up to T) are indexed alone, so their groups hold T texts at most.
* Frequent tokens come last in the order and are indexed in pairs. They fall into g classes by hash,
  and only tokens of one class are combined; the prefix is extended by g tokens. Partners that share
  no rare token share g + 1 frequent ones of their prefixes, and two of these fall into one class, so
  they share a pair. g grows with the prefix, which keeps the number of pairs linear in it, at every
  set size. A pair of sets goes by the g of the smaller one; a set whose possible partners have
  different g indexes its pairs under each (two or three).

Document frequencies are exact counts over all texts. T is the smallest power of two, at least 16,
for which at most ``MAX_FREQUENT`` tokens are frequent, which bounds what is broadcast.

Groups of rare tokens emit their pairs, which T bounds. Groups of frequent tokens may be large: they
are split by salt, each part is joined to its smallest set as a star, and so are the parts' smallest
sets. Verified links form components. What is left to examine are sets that frequent signatures
connect and that still lie in different components: they are compared block by block inside tasks,
each pair once, without emitting pairs. So no link between components is lost, while texts that are
already connected are not compared again.

Verification compares whole sets: ``100 * intersection >= percent * union``. Hashes have 64 bits.
Components alone are computed: a candidate whose ends lie in one component already is not verified.

Defined results: a null text or one without words has an empty set, linked with nothing; a text with
fewer words than a shingle is one token; repeated rows and copies share a component; null ids are
ignored when the smallest id is chosen; an empty table gives an empty result; other columns are not
read. No candidate is dropped, at any group size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.graph import components, join_unique
from strandmill.sources.shared import written

MAX_FREQUENT = 1 << 19
SALTS = 64
#: Texts that are verified against one other text in one task, about.
SPREAD = 4096
#: Sets in a block of a cluster, about.
BLOCK = 1024
LOW = np.uint64(0xFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: One 64-bit number per byte; A-Z have those of a-z.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
#: An odd base (5 modulo 8) and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and INVERSE modulo 2^64, as far as they have been needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            m = len(cls.up)
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, m, 1 << 64))])
                cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, m, 1 << 64))])
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def shingle_sets(texts: pa.Array, k: int, most_bytes: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; A-Z count as a-z.

    Words of about ``most_bytes`` of text at a time (at least one text) are hashed together: a word's
    polynomial hash is a difference of running sums over the bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1)
        yield from _hashed(data[at[first] : at[last]], at[first : last + 1] - at[first], k)
        first = last


def _hashed(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    up, down = Powers.to(len(data) + 1)
    inside = ~SPACE[data]
    apart = np.ones(len(data) + 1, bool)  # whether a word may begin here
    apart[1:-1] = ~inside[:-1]
    apart[at[at < len(data)]] = True
    start = np.flatnonzero(inside & apart[:-1])
    ends_after = np.ones(len(data), bool)
    ends_after[:-1] = ~inside[1:]
    cuts = at[(at > 0) & (at <= len(data))] - 1
    ends_after[cuts] = True
    end = np.flatnonzero(inside & ends_after)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    words = mixed((sums[end + 1] - sums[start]) * down[start])
    cut = np.searchsorted(start, at)
    joined = words[: max(0, len(words) - k + 1)].copy()
    for i in range(1, k):
        joined = mixed(joined) + words[i : len(joined) + i]
    joined = mixed(joined)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= k:
            yield distinct(joined[a : b - k + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in words[a:b]:
                h = mixed(h ^ x)
            yield h
        else:
            yield words[:0]


def set_digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """Stored (id, body, node, n) per row; body hashes the text, node is the set's digest, null for empty sets."""

    def run(batches):
        for batch in batches:
            found = [(set_digest(s) if len(s) else None, len(s)) for s in shingle_sets(batch.column(2), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["id", "body", "node", "n"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, body long, node long, n long"
    return written(docs.select("id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, schema), "jaccard-sets")


def short_tokens(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Tokens reduced to a part number and 32 bits, for counting."""
    return (tokens >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | tokens & LOW


def frequent_tokens(docs: DataFrame, k: int, tokens: int, least: int = 16, per_part: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted short tokens, their document frequencies, number of parts) of all tokens in more than T texts.

    Tasks count their own tokens first and ship them packed, by part; parts grow in number with the
    corpus, so a task of the second stage holds about ``per_part`` tokens.
    """
    parts = int(min(1 << 20, max(8, tokens // per_part)))

    def local(batches):
        held, size = [], 0

        def packed():
            short, n = np.unique(short_tokens(np.concatenate(held), parts), return_counts=True)
            cuts = np.searchsorted(short, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            low, one = (short & LOW).astype(np.uint32), n == 1
            rows = [(p, low[a:b][one[a:b]].tobytes(), low[a:b][~one[a:b]].tobytes(), n[a:b][~one[a:b]].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "ones", "many", "counts"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), k):
                held.append(own)
                size += len(own)
                if size > 4_000_000:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def total(batches):
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, ones, many, counts in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(ones, np.uint32), np.frombuffer(many, np.uint32)
                by_part.setdefault(part, []).append((np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.uint32), np.frombuffer(counts, np.uint32)])))
        for part in list(by_part):
            found = by_part.pop(part)
            low, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(low, kind="stable")
            low, n = low[order], n[order]
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            sums = np.add.reduceat(n.astype(np.int64), first)
            keep = sums > least
            yield pa.RecordBatch.from_arrays([pa.array((np.int64(part) << np.int64(32)) | low[first][keep].astype(np.int64)), pa.array(sums[keep])], names=["short", "df"])

    packed = docs.select("text").mapInArrow(local, "part int, ones binary, many binary, counts binary").repartition(parts, "part")
    counts = written(packed.mapInArrow(total, "short long, df long"), "jaccard-frequent")
    by_power = dict(counts.groupBy(F.floor(F.log2(F.col("df") - 0.5)).cast("int").alias("power")).count().collect())
    bound = least
    while sum(n for p, n in by_power.items() if (2 << p) > bound) > MAX_FREQUENT:
        bound *= 2
    # df > bound has floor(log2(df - 0.5)) >= log2(bound), for a power of two.
    kept = counts.where(F.col("df") > bound).toPandas().sort_values("short")
    return kept["short"].to_numpy().astype(np.uint64), kept["df"].to_numpy(), parts


class Signer:
    """Signatures of token sets."""

    def __init__(self, percent: int, frequent: np.ndarray, df: np.ndarray, parts: int):
        self.percent, self.frequent, self.df, self.parts = percent, frequent, df, parts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """Document frequency of frequent tokens, 0 for rare ones."""
        out = np.zeros(len(tokens), np.int64)
        at = np.flatnonzero(self.maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at) and len(self.frequent):
            short = short_tokens(tokens[at], self.parts)
            place = np.minimum(np.searchsorted(self.frequent, short), len(self.frequent) - 1)
            out[at] = np.where(self.frequent[place] == short, self.df[place], 0)
        return out

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures of rare tokens, signatures of frequent ones)."""
        n = len(tokens)
        need = n - (self.percent * n + 99) // 100 + 1
        df = self.frequency(tokens)
        rare = tokens[df == 0]  # by hash, as tokens are sorted
        if len(rare) >= need:
            return rare[:need], rare[:0]
        hot = df > 0
        common = tokens[hot][np.lexsort((tokens[hot], df[hot]))]
        rest, least = need - len(rare), (self.percent * n + 99) // 100
        found = [mixed(common[:rest] ^ np.uint64(0x2545F4914F6CDD1D))] if least == 1 else []
        classes = self.classes(least)
        while True:
            found.append(class_pairs(common[: rest + classes], classes))
            if classes >= self.classes(n):
                return rare, np.concatenate(found)
            classes *= 2

    def classes(self, n: int) -> int:
        """Token classes for sets of n tokens: a power of two, about half the prefix, and fewer than the tokens that partners share."""
        least = (self.percent * n + 99) // 100
        return 1 << max(0, min((n - least + 1) // 2, least - 1).bit_length() - 1)


def class_pairs(tokens: np.ndarray, classes: int) -> np.ndarray:
    """A signature for every two tokens of one class."""
    of = mixed(tokens) >> np.uint64(40) & np.uint64(classes - 1)
    order = np.argsort(of, kind="stable")
    tokens, of, found = tokens[order], of[order], []
    for step in range(1, len(tokens)):
        same = np.flatnonzero(of[step:] == of[:-step])
        if not len(same):
            break
        a, b = tokens[same], tokens[same + step]
        found.append(mixed(mixed(np.minimum(a, b)) + np.maximum(a, b) + np.uint64(classes)))
    return np.concatenate(found) if found else tokens[:0]


def signatures(docs: DataFrame, k: int, signer: Signer) -> DataFrame:
    """Stored (sig, node, n, hot) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(signer)

    def run(batches):
        sign = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                sig, node, size, hot = [], [], [], []
                for s in shingle_sets(batch.column(0).slice(at, 500), k):
                    if len(s):
                        digest = set_digest(s)
                        for part, is_hot in zip(sign(s), (False, True)):
                            sig.append(part)
                            node.append(np.full(len(part), digest, np.int64))
                            size.append(np.full(len(part), len(s), np.int32))
                            hot.append(np.full(len(part), is_hot))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, size, hot))], names=["sig", "node", "n", "hot"])

    return written(docs.select("text").mapInArrow(run, "sig long, node long, n int, hot boolean"), "jaccard-signatures")


def group_pairs(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(a, b), a < b, from rows (key columns, node, n): all pairs within each group whose sizes allow a link.

    Groups must be bounded; rows stream through in key order, many small groups at a time.
    """
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "node")

    def run(batches):
        tail = None

        def emit(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in key]
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            new = np.ones(len(node), bool)
            if len(node) > 1:
                new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0) | (node[1:] != node[:-1])
            keys, node, n = [x[new] for x in keys], node[new], n[new]
            i, step, left, right = np.arange(len(node)), 1, [], []
            while len(i := i[i + step < len(node)]):
                i = i[np.all([x[i] == x[i + step] for x in keys], axis=0)]
                fits = i[100 * np.minimum(n[i], n[i + step]) >= percent * np.maximum(n[i], n[i + step])]
                left.append(node[fits])
                right.append(node[fits + step])
                step += 1
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            last = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in key], axis=0)
            cut = int(np.argmax(last)) if len(last) else 0
            if cut:
                yield emit(table.slice(0, cut))
            tail = table.slice(cut).combine_chunks()
        if tail is not None and len(tail):
            yield emit(tail)

    return ordered.mapInArrow(run, "a long, b long")


def star_pairs(hot: DataFrame) -> DataFrame:
    """(a, b): every set of a frequent signature with the smallest set of its salted part, and the parts' smallest sets with each other's smallest."""
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    in_part = salted.select(F.min("node").over(Window.partitionBy("sig", "salt")).alias("a"), F.col("node").alias("b"))
    parts = salted.groupBy("sig", "salt").agg(F.min("node").alias("node"))
    between = parts.select(F.min("node").over(Window.partitionBy("sig")).alias("a"), F.col("node").alias("b"))
    return in_part.unionByName(between).where("a <> b").distinct()


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Stored (node, text) for the given nodes, one row each.

    A bitmap of id buckets (2^20 bits, whatever the corpus) filters the scan first, so that only
    the texts in question, and few others, are hashed again and shuffled.
    """
    chosen = written(sets.join(nodes, "node").groupBy("node").agg(F.min("id").alias("id")), "jaccard-chosen")
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")
    bits = np.zeros(1 << 20, bool)
    bits[chosen.select(bucket.alias("bucket")).distinct().toPandas()["bucket"].to_numpy().astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        own = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            texts = batch.column(0).filter(pa.array(own[batch.column(1).to_numpy(zero_copy_only=False)]))
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) if len(s) else None for s in shingle_sets(texts, k)], pa.int64()), texts], names=["node", "text"])

    passed = docs.where("text is not null").select("text", bucket.alias("bucket")).mapInArrow(run, "node long, text string")
    return written(passed.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-texts")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored (a, b, common, joint, linked) for pairs (a, b).

    The text of a set with many partners is copied to several tasks, which share its partners.
    """
    met = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")), "jaccard-centres")
    salted = pairs.join(met.where("salts > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    centres = met.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "a_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = left.join(centres, ["a", "salt"]).select("a", "b", "a_text", "b_text")

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                a = batch.column(0).to_numpy()
                new = np.r_[True, a[1:] != a[:-1]]  # rows come in runs of a
                left = list(shingle_sets(batch.column(2).filter(pa.array(new)), k))
                rows = []
                for i, other in zip(np.cumsum(new) - 1, shingle_sets(batch.column(3), k)):
                    common = len(np.intersect1d(left[i], other, assume_unique=True))
                    rows.append((common, len(left[i]) + len(other) - common))
                x = np.array(rows, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in x.T.copy()), pa.array(100 * x[:, 0] >= percent * x[:, 1])], names=["a", "b", "common", "joint", "linked"])

    return written(both.mapInArrow(run, "a long, b long, common long, joint long, linked boolean"), "jaccard-verified")


def linked_sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, roots) of ``docs`` (id, text): stored rows (id, body, node, n), and (node, root) of the sets that links connect with others."""
    sets = sets_of(docs, k)
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    signed = signatures(docs, k, Signer(percent, *frequent_tokens(docs, k, tokens)))
    hot = signed.where("hot").select("sig", "node", "n").distinct()
    stars = written(star_pairs(hot), "jaccard-stars")
    pairs = group_pairs(signed.where("not hot").select("sig", "node", "n"), ["sig"], percent).unionByName(stars)
    pairs = written(pairs.distinct(), "jaccard-pairs")

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    texts = texts_of(docs, sets, nodes, k)
    # First every set against the smallest partner, which connects most groups.
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = verify(first, texts, k, percent)
    roots = components(links.where("linked"))
    # Then all pairs that are still apart.
    rest = apart(pairs.join(links, ["a", "b"], "left_anti"), roots)
    more = verify(rest, texts, k, percent)
    tried = links.unionByName(more)
    roots = components(tried.where("linked"))
    # Last, sets that frequent signatures hold together and stars did not.
    last = links_in_clusters(hot, stars, roots, texts, k, percent)
    if not last.isEmpty():
        roots = components(tried.where("linked").select("a", "b").unionByName(last))
    return sets, roots


def with_component(sets: DataFrame, roots: DataFrame, best: Column) -> DataFrame:
    """The rows of ``sets`` that have words, with ``top``, the smallest ``best`` of their component.

    Components are settled per distinct set; a set or component with many rows is never joined in one task.
    """
    worded = sets.where("node is not null")
    nodes = worded.groupBy("node").agg(F.count("*").alias("copies"), F.min(best).alias("best"))
    known = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-known")
    groups = written(known.groupBy("root").agg(F.min("best").alias("top"), F.count("*").alias("size")), "jaccard-groups")
    sizes = known.agg(F.count("*"), F.sum("copies")).first()
    settled = written(join_unique(known, groups, ["root"], "size", sizes[0]).select("node", "copies", "top"), "jaccard-settled")
    return join_unique(worded, settled, ["node"], "copies", sizes[1] or 0)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    sets, roots = linked_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, percent)
    found = with_component(sets, roots, F.col("id")).select("id", "n", "top")
    alone = sets.where("node is null").select("id", "n", F.col("id").alias("top"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("top", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of linked texts, columns unchanged.

    The row with the smallest id stays (null ids come last, ties go by the text's hash); of rows with
    equal id and text exactly one. Rows are told apart by id and text, so that a row whose id
    another text shares is never dropped with it. Rows without words all stay. ``docs`` is read several
    times and need not come in the same order or partitions each time.
    """
    names = docs.columns
    sets, roots = linked_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, percent)
    placed = with_component(sets, roots, F.struct(F.col("id").isNull().alias("late"), "id", "body"))
    placed = placed.select("id", "body", (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("body") == F.col("top.body"))).alias("stays"))
    marks = written(placed.groupBy("id", "body", "stays").agg(F.count("*").alias("times")).where("not stays or times > 1"), "jaccard-marks")
    lost, repeated = marks.where("not stays").select("id", "body"), marks.where("stays").select("id", "body")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    without = lambda rows, gone: rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.body") == F.col("g.body")), "left_anti")
    kept = without(rows, lost)
    if repeated.isEmpty():
        return kept.select("row.*")
    several = rows.alias("r").join(repeated.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.body") == F.col("g.body")), "left_semi")
    return without(kept, repeated).select("row.*").unionByName(several.groupBy("id", "body").agg(F.any_value("row").alias("row")).select("row.*"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components; nodes without a row are their own."""
    ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    return ends.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b")


def links_in_clusters(hot: DataFrame, stars: DataFrame, roots: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored links (a, b) between components of sets that frequent signatures connect.

    Signatures with a set in common form a cluster, in which each set stands once, however many
    signatures it has. The sets of a cluster's largest component need no comparison with each other;
    the others meet every set of the cluster. They are cut into blocks, and each block of them meets
    each block of the cluster in one group, where common shingles are counted through an index of
    the block; no pair leaves the task unless it is a link, one per set and component.
    """
    clusters = components(stars).withColumnRenamed("root", "cluster")
    placed = written(clusters.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-clusters")
    largest = placed.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    largest = largest.where("top.n < all").select("cluster", F.col("top.root").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("odd_blocks"))
    sizes = hot.groupBy("node").agg(F.first("n").alias("n"))
    left = placed.join(largest, "cluster").join(sizes, "node").withColumn("odd", F.col("root") != F.col("top"))
    part = lambda seed, count: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")
    every = left.select("cluster", "node", "root", "n", part(1, "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("odd_block"), F.lit(1).alias("side"))
    odd = left.where("odd").select("cluster", "node", "root", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part(2, "odd_blocks").alias("odd_block"), F.lit(0).alias("side"))
    key = ["cluster", "odd_block", "block"]
    rows = odd.unionByName(every).join(texts, "node").select(*key, "side", "node", "root", "n", "text")
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "side", "node")

    def run(batches):
        now, held, index = None, [], None
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                side, node, root, n = (batch.column(i).to_numpy() for i in range(3, 7))
                out: dict = {}
                for i, own in enumerate(shingle_sets(batch.column(7), k)):
                    if keys[i] != now:
                        now, held, index = keys[i], [], None
                    if side[i] == 0:
                        held.append((node[i], root[i], n[i], own))
                        continue
                    if not held:
                        continue
                    if index is None:
                        tokens = np.concatenate([x[3] for x in held])
                        owner = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
                        order = np.argsort(tokens, kind="stable")
                        index = tokens[order], owner[order], *(np.array([x[j] for x in held]) for j in range(3))
                    tokens, owner, nodes, of, size = index
                    low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                    many = high - low
                    met = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                    common = np.bincount(owner[met], minlength=len(nodes))
                    linked = (100 * common >= percent * (size + len(own) - common)) & (of != root[i])
                    for j in np.flatnonzero(linked):
                        out.setdefault((int(nodes[j]), int(root[i])), int(node[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array(list(out.values()), pa.int64())], names=["a", "b"])

    return written(ordered.mapInArrow(run, "a long, b long"), "jaccard-cluster-links")
