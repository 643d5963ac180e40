import importlib
import math
import pickle
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandmill.llm import ranking, spelling, token_counts

MODEL = "piece_bpe_32k.model"


def model_path(name=MODEL):
    return importlib.import_module("public_tokenizers").path(name)


# --- spelling variants ---


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)


def test_trie_finds_every_word_one_edit_away():
    draw = random.Random(1)
    for size in (0, 1, 2, 5, 40, 90):
        for _ in range(12):
            words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(1, 6))) for _ in range(size)})
            trie = pickle.loads(pickle.dumps(spelling.Trie(words, [1] * len(words))))
            for word in [*words, "zz", "a" * 7, "ab"]:
                found = [trie.words[x] for x in trie.near(word)]
                assert len(found) == len(set(found))
                assert sorted(found) == [w for w in words if one_edit(w, word)]
            for asked in (words, draw.sample(words, len(words)), sorted({*words, "ab", "aab", "zz"})):
                assert [sorted(x) for x in trie.near_all(asked)] == [sorted(trie.near(w)) for w in asked]


def counted_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def spelling_rows(rows):
    words = counted_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: x for w, found in near.items() if found and words[x := min(found, key=lambda y: (-words[y], y))] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def spelled_docs():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(5, 9))) for _ in range(25)]
    rows = [(None, None), (None, ""), (1, "123 ... ×÷"), (2, "Überfluß " * 5), (2, "Überfluß " * 5), (3, "x" * 70_000), (4, "x" * 70_000), (5, "x" * 69_999), (None, "x" * 69_999 + " straße straße straßen straßen straßen " + "Straßen " * 3), (9, "zzcdef " * 16 + "zzcdeg " * 7 + "zzcdhg " * 3)]
    for i in range(10, 300):
        words = []
        for _ in range(40):
            word = base[int(draw.random() ** 3 * len(base))]
            if draw.random() < 0.2:
                at = draw.randrange(len(word))
                word = word[:at] + draw.choice(["", "e", "ab"]) + word[at + draw.randint(0, 1) :]
            words.append(word.upper() if draw.random() < 0.1 else word)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("shard_words, pass_bytes", [(1 << 17, 48 << 20), (20, 500)])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, shard_words, pass_bytes):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling, "PASS_BYTES", pass_bytes)
    rows = spelled_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    found = sorted(tuple(r) for r in spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    expected = spelling_rows(rows)
    assert found == expected
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] and r[1] != r[2] for r in expected)


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        assert spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots_of(forms).collect()} == {f"w{i}": "w21" for i in range(21)}


# --- ranking ---


def ranked(rows, items, k):
    """Every document scored for every item, in whole numbers."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(split(t))) for i, t in rows if split(t)]
    n, all_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // all_terms
            scored.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c), i))
        best = sorted((-s, i is None, i or 0) for s, i in scored if s > 0)[:k]
        found += [(item, place, None if null else i, -s) for place, (s, null, i) in enumerate(best, 1)]
    return sorted(found, key=repr)


def ranked_docs():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["ñandú", "漢字", "Éa"]
    rows = [(None, None), (None, ""), (None, "w1 w2"), (1, "... !"), (2, "w1, W2;w3"), (2, "w1, W2;w3"), (3, "w5 " * 30_000 + "rare")]
    rows += [(i, " ".join(vocabulary[int(draw.random() ** 2 * len(vocabulary))] for _ in range(draw.randint(1, 80)))) for i in range(10, 700)]
    rows += [(1000 + i, "copied passage of w1 and w40") for i in range(90)]
    return rows


ITEMS = [(0, "w1 w2 w3"), (0, "W1 w1 ñandú"), (None, "rare 漢字 éa Éa"), (1, None), (2, ""), (3, "nowhere"), (4, "copied passage of w1 and w40"), (5, " ".join(f"w{i}" for i in range(60)))]


def test_block_maxima_lose_no_document(spark, monkeypatch):
    rows = ranked_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"score": F.lit("x"), "block": F.lit(1), "query": F.lit(2)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    expected = ranked(rows, ITEMS, 20)
    take = lambda: sorted((tuple(r) for r in ranking.rank(docs, items, 20).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert take() == expected
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_POSTINGS", 40), ("RUN_POSTINGS", 300), ("SLICE_QUERIES", 2), ("SLICE_ENTRIES", 10)):
        monkeypatch.setattr(ranking, name, value)
    assert take() == expected


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 2)
    scored = []
    kept = ranking.score_block
    monkeypatch.setattr(ranking, "score_block", lambda own, match, reached, row, best: (scored.append(int(reached.sum())), kept(own, match, reached, row, best)))
    own = ranking.Slice([("q", {b"a", b"b"})], 100, {b"a": 3, b"b": 90})
    import numpy as np

    best = ranking.Best(1, np.zeros(1))
    for texts in ([b"a b", b"a"], [b"b", b"b c"], [b"c"], [b"a b a"]):
        counts = [Counter(ranking.terms_of(t)) for t in texts]
        row = ranking.block_of(list(range(len(texts))), np.full(len(texts), 100), counts)
        match = own.matches(row["terms"].to_pylist())
        bounds = own.bounds(match, row["maxima"])
        reached = (bounds > 0) & (bounds >= best.thresholds)
        if reached.any():
            ranking.score_block(own, match, reached, row, best)
    assert len(scored) == 2  # neither the block with b alone nor the one without a term


def test_a_task_holds_a_few_blocks_at_a_time(spark, monkeypatch, tmp_path):
    """The size of what a task has in hand does not follow that of the index, here above 30 MB in one task."""
    hashed = F.expr("concat_ws(' ', transform(sequence(0, 9999), x -> hex(xxhash64(id, x))))")
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), hashed.alias("text"))
    asked = docs.where("doc_id in (7, 150)").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 300).alias("text"))
    rows_of, built, build = ranking._index_rows, [], ranking.build_index

    def rows(batches):
        for batch in batches:
            (tmp_path / f"{uuid.uuid4()}").write_text(f"{batch.nbytes}")
            yield from rows_of([batch])

    monkeypatch.setattr(ranking, "_index_rows", rows)
    monkeypatch.setattr(ranking, "build_index", lambda *args: built.append(build(*args)) or built[0])
    found = ranking.rank(docs, asked, 1)
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in found.collect()) == [(7, 1, 7), (150, 1, 150)]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in built[0].inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 30 << 20 and max(groups) < 16 << 20
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"  # the session's own is put back


def test_a_block_is_scored_for_few_queries_at_a_time(spark, monkeypatch):
    """The numbers in hand do not follow the number of queries that meet a block."""
    rows, sizes, kept = ranked_docs(), [], ranking.np.bincount

    def bincount(x, weights=None, minlength=0):
        sizes.append(len(x))
        return kept(x, weights, minlength)

    docs = [(i, t) for i, t in rows if ranking.terms_of((t or "").encode())][-400:]
    counts = [Counter(ranking.terms_of(t.encode())) for _, t in docs]
    row = ranking.block_of([i for i, _ in docs], ranking.np.full(len(docs), 100), counts)
    queries = [(q, {f"w{i}".encode() for i in range(q % 50, 60)}) for q in range(300)]
    own = ranking.Slice(queries, len(docs), Counter(t for c in counts for t in c))
    match, reached = own.matches(row["terms"].to_pylist()), ranking.np.arange(300) % 7 > 0
    whole, parts = (ranking.Best(20, ranking.np.zeros(300)) for _ in range(2))
    monkeypatch.setattr(ranking, "MEETINGS", 1 << 40, raising=False)
    ranking.score_block(own, match, reached, row, whole)
    monkeypatch.setattr(ranking, "MEETINGS", 20_000, raising=False)
    monkeypatch.setattr(ranking.np, "bincount", bincount)
    ranking.score_block(own, match, reached, row, parts)
    assert parts.rows == whole.rows and len(whole.rows) == int(reached.sum())
    assert max(sizes) <= 20_000


def test_ranking_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    for d, i in ((empty, items), (docs.where("doc_id > 1"), items), (docs, items.where("item_id > 99")), (spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), items)):
        found = ranking.rank(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


# --- token counts ---


def token_docs():
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeéß漢 ,\n") for _ in range(draw.randint(1, 9)))
    rows = [(None, None), (None, ""), (1, " "), (2, "a  b<s></s><unk> ▁x Ａ\x00"), (2, "a  b<s></s><unk> ▁x Ａ\x00"), (3, "plain words " * 400)]
    rows += [(4, "a" * 5000), (5, " " * 3001), (6, "漢字" * 2000), (7, "😀" * 1111), (8, "ab" * 2500 + " " + "a" * 2500)]
    return rows + [(i, " ".join(word() for _ in range(draw.randint(1, 1500)))) for i in range(10, 60)]


@pytest.mark.parametrize("sizes", [(2 << 15, 1 << 15, 1 << 8), (300, 120, 40), (64, 64, 17), (30, 20, 1)])
def test_spliced_counts_equal_whole_ones(spark, sizes):
    model = token_counts.processor(model_path())
    rows = token_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"uid": F.lit("x"), "n_tokens": F.lit("x"), "id": F.lit(0)})
    huge, chunk, overlap = sizes
    found = sorted(map(tuple, token_counts.count_tokens(docs, model_path(), 100, huge=huge, chunk=chunk, overlap=overlap).collect()), key=repr)
    expected = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in rows]
    assert found == sorted(expected, key=repr)


def test_unaligned_overlaps_are_widened(spark):
    """Chunks that start at odd places of a run of one letter share no piece."""
    model = token_counts.processor(model_path())
    text, chunk, overlap = "a" * 2000, 121, 30
    parts = [token_counts.chunk_marks(model, 0, k, k == 16, text[k * chunk : (k + 1) * chunk + overlap], chunk, overlap) for k in range(17)]
    left = {r[1:5] for rows in parts for r in rows if r[1] is not None and r[5] is not None}
    right = {r[1:5] for rows in parts for r in rows if r[1] is not None and r[6] is not None}
    assert len({r[0] for r in left & right}) < 16
    stored = spark.createDataFrame([(9, len(text), text)], "uid long, n_chars long, text string")
    assert [tuple(r) for r in token_counts.spliced_counts(stored, model_path(), chunk, overlap).collect()] == [(9, len(model.encode(text)))]


def test_other_models_are_refused():
    with pytest.raises(Exception):
        token_counts.processor(model_path("byte_bpe_50k.json"))


def test_token_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), model_path()).count() == 0
