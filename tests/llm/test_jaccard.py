import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmill.llm import jaccard
from strandmill.llm.graph import components


def brute(rows, k=4, percent=85):
    """{id: (set size, smallest id reachable)} by comparing everything that shares a shingle."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
        sets[i] = frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[j : j + k]) for j in range(len(words) - k + 1)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for t in s for j in holders[t]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for t in s:
            holders[t].append(i)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return {i: (len(sets[i]), min(g)) for g in groups.values() for i in g}


def corpus(seed, n_bases=12):
    """Texts with small and large groups of near copies at all distances, shared passages, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "   ", "one", "one two", "One TWO", "a b c d", "\t\n", "é É", "x " * 3000]
    for base in range(n_bases):
        own = [word() for _ in range(rng.choice([12, 40, 90, 150, 170, 260]))]
        for _ in range(rng.choice([2, 3, 8, 30, 60])):
            w = list(own)
            for _ in range(rng.randint(0, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: rng.randint(len(w) * 8 // 10, len(w))]
            texts.append(" ".join(w))
    for _ in range(70):
        texts.append(" ".join(passage + [word() for _ in range(rng.choice([4, 9, 30, 80]))]))
    texts += [texts[20]] * 25
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(jaccard.link_components(docs)) == brute(rows)


def test_other_thresholds_and_widths(spark):
    rows = corpus(5, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.link_components(docs, k=5, percent=80)) == brute(rows, 5, 80)


def test_empty_table_null_ids_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, None)], "doc_id long, text string").withColumns({"node": F.lit(1), "sig": F.lit("x")})
    got = sorted(map(tuple, jaccard.link_components(odd).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (2, 0, 2)], key=str)


def test_signatures_of_partners_meet_at_every_size():
    """Partners share a signature, be their tokens rare or frequent, and frequent ones make a number of pairs linear in the set."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(1500):
        percent, n = int(rng.choice([85, 80, 60, 30])), int(rng.choice([1, 2, 3, 5, 9, 20, 60, 170, 600, 2000]))
        x = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        gone, new = rng.integers(0, n * (100 - percent) // 100 + 1, 2)
        y = np.unique(np.r_[rng.permutation(x)[gone:], rng.integers(1, 1 << 63, new, dtype=np.uint64)])
        common, union = len(np.intersect1d(x, y)), np.union1d(x, y)
        if 100 * common < percent * len(union) or not len(y):
            continue
        met += 1
        frequent = np.unique(jaccard.short_tokens(union[rng.random(len(union)) < rng.choice([1.0, 0.9, 0.5])], 8))
        sign = jaccard.Signer(percent, frequent, rng.integers(17, 100, len(frequent)), 8)
        (rare_x, hot_x), (rare_y, hot_y) = sign(x.copy()), sign(y.copy())
        assert len(np.intersect1d(rare_x, rare_y)) or len(np.intersect1d(hot_x, hot_y))
        assert percent < 80 or len(hot_x) <= 2 * n
    assert met > 1000


def test_long_sets_that_share_a_passage(spark):
    """One frequent passage in most texts, of 20 to 2,000 shingles, and near copies among them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    passage, texts = [word() for _ in range(60)], []
    for n in [20, 60, 150, 400, 1000, 2000] * 5:
        own = passage + [word() for _ in range(max(3, n - 60))]
        for _ in range(3):
            w = list(own)
            for _ in range(rng.randint(0, len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    rows = list(enumerate(texts))
    assert found(jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_dropped_near_copies_are_rows_and_not_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " + x for x in ("phi chi", "phi", "chi chi"))
    other = "one two three four five six seven eight nine ten"
    rows = [(5, a, 1), (5, other, 2), (2, b, 3), (None, c, 4), (None, "nothing like it at all, in any way", 5), (2, b, 6), (8, None, 7), (8, "", 8), (None, None, 9), (7, other.upper(), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body int").repartition(3)
    got = jaccard.drop_near_copies(docs, k=2, percent=80)
    assert got.columns == docs.columns
    kept = sorted(r.body for r in got.collect())
    assert kept in ([2, 3, 5, 7, 8, 9], [2, 5, 6, 7, 8, 9])  # of the equal rows 3 and 6 one
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_shingles_count_ascii_case_and_white_space():
    s = lambda t: next(jaccard.shingle_sets(pa.array([t]), 4))
    assert np.array_equal(s("A b\tc\nd"), s("a  B c d"))
    assert len(s("É b c d")) == 1 and not np.array_equal(s("É b c d"), s("é b c d"))
    assert len(s("a b")) == 1 and not np.array_equal(s("a b"), s("a b a"))
    assert len(s("a b c d")) == 1 and not np.array_equal(s("a b c d"), s("a b c d"))


def test_texts_are_hashed_alike_alone_and_together():
    texts = [None, "", "a", "b c", "a b c d e f", " ", "A b c d e f ", "x" * 5000 + " y z w v", None, "tail of words here now"]
    for at in range(3):
        together = list(jaccard.shingle_sets(pa.array(texts).slice(at), 4, 64))
        assert len(together) == len(texts) - at
        for text, s in zip(texts[at:], together):
            assert np.array_equal(s, next(jaccard.shingle_sets(pa.array([text], pa.string()), 4)))
            assert len(s) == brute([(0, text)])[0][0]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
