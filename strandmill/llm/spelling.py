"""Spelling variants: words one edit apart, found by intersecting Levenshtein automata with trie shards.

``word_counts`` counts the words of all texts; every task adds up its own counts before they are
shuffled. ``trie_shards`` sorts the kept words by range and turns runs of at most ``SHARD_WORDS`` words
into compact tries (a node per branching, not per letter). Shards are broadcast in passes of at most
``PASS_BYTES`` of them, which bounds what driver and tasks hold whatever the vocabulary; in every pass
each word's distance-one automaton goes depth-first through every shard of the pass. A task's words are a
sorted range, so the states that neighbours share by their common prefix are reached once. The automaton is in
its first state as far as the word and the path agree; the one edit is made where they first differ (two
words that are one edit apart always agree behind one edit there), after which the rest must match. So
every near word is met once. A task passes on the number of near words and the best of them; counts are
added and the best is chosen over passes.

Forms have at least twice their word's count, so chains of forms are short and free of cycles; roots are
found by doubling.

Defined results: null and empty texts have no words; a null id counts as an empty string where a
word's damage is drawn; repeated rows count each; words of any length are kept whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.sources.shared import written

LETTER = "[A-Za-zÀ-ÿ]"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DAMAGE = 97
SHARD_WORDS, PASS_BYTES = 1 << 17, 48 << 20
#: Longest words whose automaton is walked letter by letter.
LONG = 256
#: Distinct words that a task adds up before it passes them on.
HELD_WORDS = 1 << 19


def damaged_words(id_text: str, text: bytes, run: re.Pattern) -> Iterable[tuple[str, int]]:
    """(word, occurrences) of one UTF-8 text, lower-cased in A-Z; words whose checksum with the id is a multiple of ``DAMAGE`` lose a letter."""
    seed = zlib.crc32(f"{id_text}:".encode())
    for word, n in Counter(run.findall(text.translate(LOWER).decode())).items():
        h = zlib.crc32(word.encode(), seed)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least_count`` times."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # Words only become shorter, so shorter runs need not be looked at.
    run = re.compile(f"{LETTER}{{{least_length},}}")

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in damaged_words(i, text, run):
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)
                    held = Counter()
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie of sorted words with counts.

    Node ``x`` stands for the common prefix, ``depth[x]`` long, of the words from ``low[x]`` on. Its
    branches are the slots from ``first[x]`` up to ``first[x + 1]``: a letter, and a node or, where one
    word is left, the complement of the word's place.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, array("q", counts)
        self.depth, self.low, self.first, self.target, letters = array("i"), array("i"), array("i"), array("i"), []
        waiting, nodes = deque([(0, len(words))] if words else []), 1
        while waiting:
            low, high = waiting.popleft()
            head, tail = words[low], words[high - 1]
            d, most = 0, min(len(head), len(tail))
            while d < most and head[d] == tail[d]:
                d += 1
            self.depth.append(d)
            self.low.append(low)
            self.first.append(len(letters))
            at = low + (len(head) == d)
            while at < high:
                end, letter = at + 1, words[at][d]
                while end < high and words[end][d] == letter:
                    end += 1
                letters.append(letter)
                if end == at + 1:
                    self.target.append(~at)
                else:
                    self.target.append(nodes)
                    waiting.append((at, end))
                    nodes += 1
                at = end
        self.first.append(len(letters))
        self.letters = "".join(letters)

    def __getstate__(self):
        return self.__dict__ | {"words": " ".join(self.words)}

    def __setstate__(self, state):
        self.__dict__.update({k: list(v) if isinstance(v, array) else v for k, v in state.items()} | {"words": state["words"].split(" ") if state["words"] else []})

    def _rest(self, ref: int, d: int, word: str, i: int) -> int:
        """Place of the word below ``ref`` that goes on from depth ``d`` exactly as ``word`` does from ``i``; -1 if none does."""
        words, size = self.words, len(word)
        while ref >= 0:
            head, depth = words[self.low[ref]], self.depth[ref]
            if head[d:depth] != word[i : i + depth - d]:
                return -1
            i, d = i + depth - d, depth
            if i >= size:
                return self.low[ref] if i == size and len(head) == d else -1
            slot = self.letters.find(word[i], self.first[ref], self.first[ref + 1])
            if slot < 0:
                return -1
            ref = self.target[slot]
        return ~ref if words[~ref][d:] == word[i:] else -1

    def _edited(self, ref: int, d: int, word: str) -> list[int]:
        """Places of words below ``ref`` that agree with ``word`` up to depth ``d`` and differ there by the one edit."""
        found = [self._rest(ref, d + 1, word, d + 1), self._rest(ref, d + 1, word, d)] if d < len(word) else [self._rest(ref, d + 1, word, d)]
        if d < len(word):
            found.append(self._rest(ref, d, word, d + 1))
        return [x for x in found if x >= 0]

    def near(self, word: str) -> list[int]:
        """Places of all words one edit away from ``word``."""
        if not self.words:
            return []
        found, ref, d, size, words = [], 0, 0, len(word), self.words
        while True:
            head = words[~ref] if ref < 0 else words[self.low[ref]]
            depth = len(head) if ref < 0 else self.depth[ref]
            while d < depth and d < size and head[d] == word[d]:
                d += 1
            if d < depth:
                return found + self._edited(ref, d, word)
            if ref < 0:
                return found + ([~ref] if size == d + 1 else [])
            if size == d + 1 and len(head) == d:
                found.append(self.low[ref])
            follow = None
            for slot in range(self.first[ref], self.first[ref + 1]):
                if d < size and self.letters[slot] == word[d]:
                    follow = self.target[slot]
                else:
                    found += self._edited(self.target[slot], d, word)
            if follow is None:
                return found
            ref = follow

    def _step(self, ref: int, d: int, letter: str) -> tuple[int, int] | None:
        """Where ``letter`` leads from depth ``d`` on the way to ``ref``."""
        if ref < 0:
            head = self.words[~ref]
            return (ref, d + 1) if d < len(head) and head[d] == letter else None
        if d < self.depth[ref]:
            return (ref, d + 1) if self.words[self.low[ref]][d] == letter else None
        slot = self.letters.find(letter, self.first[ref], self.first[ref + 1])
        return None if slot < 0 else (self.target[slot], d + 1)

    def _branches(self, ref: int, d: int) -> list[tuple[str, int]]:
        """(letter, ref) of all ways on from depth ``d``."""
        head = self.words[~ref] if ref < 0 else self.words[self.low[ref]]
        if ref < 0 or d < self.depth[ref]:
            return [(head[d], ref)] if d < len(head) else []
        return [(self.letters[slot], self.target[slot]) for slot in range(self.first[ref], self.first[ref + 1])]

    def _ended(self, ref: int, d: int) -> int:
        """Place of the word that ends here; -1 if none does."""
        if ref < 0:
            return ~ref if len(self.words[~ref]) == d else -1
        return self.low[ref] if self.depth[ref] == d and len(self.words[self.low[ref]]) == d else -1

    def near_all(self, words: Iterable[str]) -> Iterator[list[int]]:
        """``near`` of each of ``words``, which are cheapest when sorted: the automaton's states are kept letter by letter, and those of the prefix that a word shares with the one before are not made again."""
        exact: list[tuple[int, int] | None] = [(0, 0) if self.words else None]
        edited: list[list[tuple[int, int]]] = [[]]
        last, step, branches = "", self._step, self._branches
        for word in words:
            size = len(word)
            if size > LONG:
                yield self.near(word)
                continue
            d, most = 0, min(size, len(last), len(exact) - 1)
            while d < most and word[d] == last[d]:
                d += 1
            del exact[d + 1 :], edited[d + 1 :]
            last = word
            while d < size and (exact[d] or edited[d] or (d and exact[d - 1])):
                letter, now = word[d], exact[d]
                states = [x for ref, at in edited[d] if (x := step(ref, at, letter))]
                follow = None
                if now:
                    ref, at = now
                    for other, x in branches(ref, at):
                        if other == letter:
                            follow = (x, at + 1)
                        else:
                            states.append((x, at + 1))
                            if y := step(x, at + 1, letter):
                                states.append(y)
                # The letter before is left out, unless it is the same one.
                if d and exact[d - 1] and word[d - 1] != letter and (y := step(*exact[d - 1], letter)):
                    states.append(y)
                exact.append(follow)
                edited.append(states)
                d += 1
            found = []
            if d == size:
                ends = list(edited[d])
                if exact[d]:
                    ends += [(x, exact[d][1] + 1) for _, x in branches(*exact[d])]
                if d and exact[d - 1]:
                    ends.append(exact[d - 1])
                found = [x for ref, at in ends if (x := self._ended(ref, at)) >= 0]
            yield found


def trie_shards(vocabulary: DataFrame, total: int) -> DataFrame:
    """(shard) pickled tries of at most ``SHARD_WORDS`` words each."""
    def build(batches):
        words, counts = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(words) >= SHARD_WORDS:
                yield pa.RecordBatch.from_pydict({"shard": [pickle.dumps(Trie(words[:SHARD_WORDS], counts[:SHARD_WORDS]))]})
                words, counts = words[SHARD_WORDS:], counts[SHARD_WORDS:]
        if words:
            yield pa.RecordBatch.from_pydict({"shard": [pickle.dumps(Trie(words, counts))]})

    ranged = vocabulary.select("word", "n").repartitionByRange(max(1, -(-total // SHARD_WORDS)), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(build, "shard binary")


def _near_in(vocabulary: DataFrame, shards: list[Trie], parts: int) -> DataFrame:
    """(word, n, n_near, best, best_n): near words of every word within ``shards``, and the commonest, first by code points."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(shards)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def search(batches):
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            met: list[tuple[int, int, str]] = [(0, 0, "")] * len(words)
            for trie in shared.value:
                for i, places in enumerate(trie.near_all(words)):
                    if places:
                        top = min((-trie.counts[x], trie.words[x]) for x in places)
                        n, *best = met[i]
                        met[i] = (n + len(places), *(min(top, tuple(best)) if n else top))
            rows = [(word, n, m[0], m[2], -m[1]) for word, n, m in zip(words, counts, met) if m[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    ranged = vocabulary.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ranged.mapInArrow(search, "word string, n long, n_near long, best string, best_n long")


def near_words(vocabulary: DataFrame, words_per_task: int = 16_384) -> DataFrame:
    """(word, n_near, best, best_n) for words of a stored vocabulary (word, n) that have near words."""
    total = vocabulary.count()
    parts = max(vocabulary.sparkSession.sparkContext.defaultParallelism, -(-total // words_per_task))
    passes, held, size = [], [], 0
    shards = written(trie_shards(vocabulary, total), "trie-shards")
    for row in shards.toLocalIterator():
        if held and size + len(row.shard) > PASS_BYTES:
            passes.append(written(_near_in(vocabulary, held, parts), "near-words"))
            held, size = [], 0
        held.append(pickle.loads(row.shard))
        size += len(row.shard)
    passes.append(written(_near_in(vocabulary, held, parts), "near-words"))
    met = passes[0]
    for other in passes[1:]:
        met = met.unionByName(other)
    if len(passes) > 1:
        first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
        met = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("x")).select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.less")).alias("best_n"))
    return met.select("word", "n_near", "best", "best_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for stored acyclic (word, form): where following forms from a word ends."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if roots.join(far, "root", "left_semi").isEmpty():
            return roots
        roots = written(roots.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "word-roots")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, factor: int = 2) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. A word's form is its commonest near word, if that has at least ``factor`` times (2 or more) its count."""
    if factor < 2:
        raise ValueError("factor must be 2 or more, or forms could go in circles")
    vocabulary = written(word_counts(docs, id_col, text_col, least_length, least_count), "vocabulary")
    met = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    found = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "word-forms")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
