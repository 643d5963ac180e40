"""Pooling, heads, probes, caches and noise over trees against plain Python."""

import ipaddress
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import dataset as D
from strandmill.operators import logistic, ml
from strandmill.operators import rules as R
from strandmill.plans import scalars


def test_pools_follow_their_mask(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [90.0, 90.0], 0), (2, 0, [5.0, 5.0], 0)], "g int, p int, v array<double>, m int")
    got = {r.g: r["mean"] for r in ml.mean_pooled(rows, "g", "v", F.col("m"), 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    assert {r.g: r.first for r in ml.first_pooled(rows, "g", "v", "p").collect()} == {1: [1.0, 2.0], 2: [5.0, 5.0]}


def test_loss_counts_labelled_cells_alone(spark):
    data = [([0.0, 1.0, 2.0], 2), ([500.0, 0.0, -500.0], 0), ([3.0, 1.0, 0.5], 1), ([1.0, 1.0, 1.0], None)]
    cells = spark.createDataFrame(data, "s array<double>, t int")
    want = [math.log(sum(math.exp(x - max(s)) for x in s)) + max(s) - s[t] for s, t in data if t is not None]
    got = ml.masked_cross_entropy(cells, F.col("s"), F.col("t")).first()
    assert got.loss == pytest.approx(sum(want) / 3) and (got.labelled, got.masked) == (3, 1)
    none = ml.masked_cross_entropy(cells.where("t is null"), F.col("s"), F.col("t")).first()
    assert (none.loss, none.labelled, none.masked) == (0.0, 0, 1)


def test_heads_give_one_score_a_class(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert rows.select(ml.linear_heads(F.col("v"), [[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]], [0.5, 0.0, 1.0])).first()[0] == [1.5, 2.0, -2.0]


def test_macro_f1_is_the_mean_over_classes(spark):
    pairs = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "t double, p double")
    assert ml.macro_f1(pairs, "t", "p") == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)
    assert ml.macro_f1(pairs.limit(0), "t", "p") is None


def test_probe_takes_the_fewest_passes_of_the_best_score(spark):
    rows = spark.createDataFrame([([float(i % 3 == k) + i % 7 / 50 for k in range(3)], i % 3) for i in range(90)] + [(None, 1), ([0.0, 0.0, 0.0], None)], "v array<double>, y int")
    model, passes, scores = ml.train_probe(rows, rows, "v", "y", (8, 1, 4))
    assert max(scores) == 1.0 and passes == (1, 4, 8)[scores.index(max(scores))]
    _, passes, scores = ml.train_probe(rows, rows.where("y is null"), "v", "y", (4, 1))
    assert (passes, scores) == (1, [None, None])


def test_cached_vectors_are_not_computed_again(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id int, text string")
    size = lambda t: F.array(F.length(t).cast("double"))
    want = {1: [1.0], 2: [2.0], 3: [2.0], 4: None, 5: [0.0]}
    assert {r.id: r.vector for r in ml.embedded(rows, "text", size, folder).collect()} == want
    never = lambda t: F.array(F.raise_error(t).cast("double"))
    assert {r.id: r.vector for r in ml.embedded(rows, "text", never, folder).collect()} == want
    assert spark.read.parquet(folder).count() == 3
    more = ml.embedded(rows.unionByName(spark.createDataFrame([(6, "new")], rows.schema)), "text", size, folder)
    assert {r.id: r.vector for r in more.collect()} == want | {6: [3.0]}


def test_addresses_are_routable_as_python_says(spark):
    assert {a: _public(a) for a in scalars.FORWARDED} == scalars.FORWARDED
    rows = spark.createDataFrame([("1.1.1.1, 8.8.8.8 ,10.0.0.1", None, "h"), ("10.0.0.1", " 9.9.9.9", "h"), (None, "fd00::1", "h"), ("", "1.1.1.1,8.8.8.8", ""), (None, None, None)], "f string, r string, h string")
    picked = [r[0] for r in rows.select(R.client_address(F.col("f"), F.col("r"), F.col("h"))).collect()]
    assert picked == ["8.8.8.8", "9.9.9.9", "h", None, None]


def _public(address):
    try:
        return ipaddress.ip_address(address).is_global
    except ValueError:
        return False


def sidecars(spark, *rows):
    return spark.createDataFrame(rows, "fold int, split string, signal string, noised boolean, seed string")


def test_noise_over_a_tree_equals_noise_over_its_files(spark):
    data = [(i % 2, "train" if i % 3 else "val", f"e{i}", f"The patient has a fever, number {i}, and it isn't going away." if i else None, i) for i in range(40)]
    examples = spark.createDataFrame(data, "fold int, split string, example_id string, text string, extra int")
    files = sidecars(spark, *[(f, s, "x" if f else "y", False, "1") for f in (0, 1) for s in ("train", "val", "test")])
    frozen = {"x": frozenset({"fever"}), "y": frozenset({"patient"})}
    noisy, told = D.noise_tree(examples, files, 0.4, "s", frozen, 0.25, ("seed",))
    got = {r.example_id: r for r in noisy.collect()}
    want = {r.example_id: r for f, signal in ((0, "y"), (1, "x")) for r in D.add_noise(examples.where(F.col("fold") == f), "example_id", "text", 0.4, "s", frozen[signal], 0.25).collect()}
    assert {k: (r.text, r.edits) for k, r in got.items()} == {k: (r.text, r.edits) for k, r in want.items()} and len(got) == 40
    assert all(got[e].extra == x and (got[e].fold, got[e].split) == (f, s) for f, s, e, _, x in data)
    for r in told.collect():
        mine = [g for g in got.values() if (g.fold, g.split) == (r.fold, r.split)]
        edits = [e for g in mine for e in g.edits]
        words = sum(len((g.text or "").split()) for g in mine)
        assert (r.noised, r.examples, r.untouched, r.edits, r.words) == (True, len(mine), sum(not g.edits for g in mine), len(edits), words)
        assert r.edits_by_kind == {k: edits.count(k) for k in set(edits)}
        assert r.edits_per_100_words == pytest.approx(100 * len(edits) / words if words else 0, abs=1e-4)


def test_trees_that_cannot_take_noise(spark):
    files = sidecars(spark, (0, "train", "x", True, "1"), (0, "val", None, False, "1"), (1, "val", "z", False, None))
    found = {tuple(r) for r in D.noise_tree_violations(files, ["x"], ["seed"]).collect()}
    assert found == {(0, "train", "noised before"), (0, "val", "no frozen words"), (1, "val", "no frozen words"), (None, None, "disagree on seed")}
    with pytest.raises(ValueError, match="cannot take noise"):
        D.noise_tree(spark.createDataFrame([], "fold int, split string, example_id string, text string"), files, 0.1, "s", {"x": frozenset()}, 0.0, ("seed",))


# --- baselines ---


def descended(x, y, classes, steps=4000, rate=1.0):
    """Multinomial logistic regression by plain gradient descent: mean loss plus half the squared weights over the number of rows."""
    n, d = x.shape
    w, b, hot = np.zeros((classes, d)), np.zeros(classes), np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * ((p - hot).T @ x / n + w / n)
        b -= rate * (p - hot).mean(0)
    return lambda q: (lambda e: e / e.sum(1, keepdims=True))(np.exp(q @ w.T + b))


def tfidf_rows(train, rows):
    """Unit TF-IDF vectors in plain Python."""

    def grams(text):
        words = re.findall(r"\b\w\w+\b", (text or "").lower())
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    df = Counter(g for t in train for g in grams(t))
    terms = sorted(g for g, n in df.items() if n >= 2)
    idf = {g: math.log((1 + len(train)) / (1 + df[g])) + 1 for g in terms}
    out = np.zeros((len(rows), len(terms)))
    for i, t in enumerate(rows):
        for g, n in grams(t).items():
            if g in idf:
                out[i, terms.index(g)] = (1 + math.log(n)) * idf[g]
        out[i] /= np.linalg.norm(out[i]) or 1
    return out


def labelled_texts(classes):
    draw = random.Random(classes)
    words = [["fever", "hot", "naïve"], ["no", "cold", "cough"], ["maybe", "über", "a"]]
    rows = []
    for i in range(90):
        k = draw.randrange(classes)
        rows.append((i, " ".join(draw.choice(words[k] if draw.random() < 0.6 else sum(words, []) + ["the", "und", f"w{draw.randrange(9)}"]) for _ in range(draw.randint(1, 12))), k))
    return [*rows, (90, None, 0), (91, "", 1), (92, "seenonlyonce", 0)]


def test_tfidf_and_length_scores_equal_plain_fits(spark):
    rows = labelled_texts(2)
    train, test = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    frame = lambda own: spark.createDataFrame([(i, t, float(k)) for i, t, k in own], "doc_id long, text string, label double")
    texts, y = [t for _, t, _ in train], np.array([k for *_, k in train])
    tokens = lambda own: np.array([[len(re.findall(r"[A-Za-z0-9']+", t or ""))] for _, t, _ in own], float)
    mean, sd = tokens(train).mean(), tokens(train).std()
    for scores, a, b in ((ml.tfidf_scores, tfidf_rows(texts, texts), tfidf_rows(texts, [t for _, t, _ in test])), (ml.length_scores, (tokens(train) - mean) / sd, (tokens(test) - mean) / sd)):
        d = a.shape[1]
        w, c = np.zeros(d), 0.0
        for _ in range(6000):
            p = 1 / (1 + np.exp(-(a @ w + c)))
            w -= 1.0 * (a.T @ (p - y) / len(y) + w / len(y))
            c -= 1.0 * (p - y).mean()
        found = {r.doc_id: r.score for r in scores(frame(train), frame(test)).collect()}
        assert len(found) == len(test)
        for (i, _, _), p in zip(test, 1 / (1 + np.exp(-(b @ w + c)))):
            assert found[i] == pytest.approx(p, abs=2e-3)


def test_vectors_hold_their_non_zeros_alone(spark):
    rows = labelled_texts(2)
    df = spark.createDataFrame([(i, t, float(k)) for i, t, k in rows], "doc_id long, text string, label double")
    expected = tfidf_rows([t for _, t, _ in rows], [t for _, t, _ in rows])
    found = {r.doc_id: r.features for r in ml.tfidf_features(df, df, [], "doc_id").collect()}
    for (i, _, _), row in zip(rows, expected):
        assert type(found[i]).__name__ == "SparseVector" and len(found[i].indices) == np.count_nonzero(row)
        assert found[i].toArray() == pytest.approx(row)


def test_all_folds_equal_separate_fits(spark):
    rows = labelled_texts(3)
    every = [(f, i, t, k, "test" if i % 4 == f else "train") for f in (0, 1) for i, t, k in rows]
    df = spark.createDataFrame(every, "fold int, doc_id long, text string, label int, split string")
    found = {(r.model, r.kind, r.fold): (r.n, r.accuracy) for r in ml.baseline_runs(df, [0, 1]).collect()}
    assert set(found) == {(m, k, f) for m in ("majority", "length", "tfidf") for k in ("baseline", "shuffled") for f in (0, 1)}
    for fold in (0, 1):
        train, test = [r for r in rows if r[0] % 4 != fold], [r for r in rows if r[0] % 4 == fold]
        y, truth = np.array([r[2] for r in train]), np.array([r[2] for r in test])
        top = max(range(3), key=lambda k: ((y == k).sum(), -k))
        assert found["majority", "baseline", fold] == (len(test), pytest.approx((truth == top).mean(), abs=1e-6))
        texts = [r[1] for r in train]
        guess = descended(tfidf_rows(texts, texts), y, 3)(tfidf_rows(texts, [r[1] for r in test])).argmax(1)
        assert found["tfidf", "baseline", fold] == (len(test), pytest.approx((guess == truth).mean(), abs=1.01 / len(test)))
        assert found["tfidf", "baseline", fold][1] > found["tfidf", "shuffled", fold][1]


def test_all_heads_equal_single_heads_in_one_scan(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)], {"a": i % 3, "b": None if i % 2 else 1, "z": 1} if i % 5 else {}) for i in range(40)]
    spark.createDataFrame(rows, "id long, v array<double>, labels map<string,int>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    heads = {h: ([[draw.uniform(-1, 1) for _ in range(4)] for _ in range(3)], [draw.uniform(-1, 1) for _ in range(3)]) for h in "abc"}
    found = ml.multi_head(df, "v", heads, "labels", ["id"])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.id, r.head): r for r in found.collect()}
    assert set(got) == {(i, h) for i, _, labels in rows for h in "abc" if labels.get(h) is not None}
    for (i, h), r in got.items():
        single = df.where(f"id = {i}").select(ml.linear_heads(F.col("v"), *heads[h])).first()[0]
        assert r.scores == pytest.approx(single) and r.truth == rows[i][2][h] and r.predicted == max(range(3), key=lambda k: (single[k], -k))


def test_fits_gather_no_vocabulary_and_equal_the_optimum(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(60)] + [None, "", "w1 w2", "w1 w2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    placed, size = logistic.placed_texts(df, "text")
    rows = {r.text: r.row for r in placed.collect()}
    assert size == len(rows) == len({t or "" for t in texts}) and sorted(rows.values()) == list(range(size))
    at = np.array([rows[t or ""] for t in texts])
    train = np.arange(len(texts)) % 4 > 0
    trained = np.stack([np.bincount(at[train], minlength=size), np.bincount(at, minlength=size)])
    products = logistic.Products(ml.term_counts(placed, "row"), trained, 2)
    given = rng.normal(size=(3, size))
    ordered = sorted(rows, key=rows.get)
    kernels = []
    for own in ([t for t, m in zip(texts, train) if m], texts):
        x = tfidf_rows(own, ordered)
        kernels.append(x @ x.T)
    assert products(given, [0, 1, 0]) == pytest.approx(np.stack([given[0] @ kernels[0], given[1] @ kernels[1], given[2] @ kernels[0]]))
    labels = rng.integers(0, 3, len(texts))
    runs = [(0, at[train], labels[train], 3), (1, at, labels % 2, 2)]
    for (group, own, y, classes), margins in zip(runs, logistic.fitted(runs, products, size)):
        z = margins if classes == 3 else np.stack([np.zeros(size), margins[0]])
        p = (np.exp(z) / np.exp(z).sum(0))[:, own]
        pull = np.stack([np.bincount(own, weights=w, minlength=size) for w in np.eye(classes)[y].T - p])
        # At the optimum intercepts balance, and the weights are what the residuals pull them to.
        assert pull.sum(1) == pytest.approx(0, abs=1e-3)
        bias = z - pull @ kernels[group] if classes == 3 else z[1:] - pull[1:] @ kernels[group]
        assert np.ptp(bias, axis=1).max() < 1e-2


def test_products_of_frequent_terms_and_outputs_that_add_up_to_zero(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["the"] * rng.integers(1, 4) + list(rng.choice([f"w{i}" for i in range(20)], rng.integers(1, 9))) + [f"own{i}"]) for i in range(700)]
    placed, size = logistic.placed_texts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    counts = ml.term_counts(placed, "row")
    assert "Exchange" not in counts.drop("row")._jdf.queryExecution().executedPlan().toString().split("Scan parquet")[0]
    rows = {r.text: r.row for r in placed.collect()}
    ordered, asked = sorted(rows, key=rows.get), []
    x, trained = tfidf_rows(texts, ordered), np.bincount([rows[t] for t in texts], minlength=size)[None, :]
    products = logistic.Products(counts, trained, 2)
    given = rng.normal(size=(2, size))
    assert products(given, [0, 0]) == pytest.approx(given @ x @ x.T)

    def told(v, groups):
        asked.append(len(v))
        return v @ x @ x.T

    labels = rng.integers(0, 3, size)
    margins = logistic.fitted([(0, np.arange(size), labels, 3)], told, size)[0]
    assert set(asked) == {2}
    p = np.exp(margins) / np.exp(margins).sum(0)
    assert np.ptp(margins - (np.eye(3)[labels].T - p) @ x @ x.T, axis=1).max() < 1e-2
