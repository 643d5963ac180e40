"""Queries over small fixtures where a cut of the input would show."""

import datetime
import difflib
import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.functions import text as X
from strandmill.operators import lint, ml, stats
from strandmill.operators.dataset import add_noise, companion_count, generate, label_vectors, running_sum
from strandmill.operators.lint import near_duplicates
from strandmill.plans import registry
from strandmill.sources.shared import shared_dir
from strandmill.sources.tables import tasks_for
from strandmill.streaming import jobs


def stored(spark, tmp_path, name, rows, schema):
    """A folder of tables with ``rows`` as table ``name``."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_similarity_ratio_compares_whole_texts(spark, tmp_path):
    same = "the quick brown fox jumps over the lazy dog and runs " * 9
    texts = [same + "A" * 300, same + "B" * 300, "x" * 450 + same, "y" * 450 + same, None]
    d = stored(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {r.item_id: r.ratio for r in registry.QUERIES["similarity_ratio"](spark, d).collect()}
    want = {i: round(difflib.SequenceMatcher(None, texts[i], texts[i + 1]).ratio(), 6) for i in range(3)} | {3: None}
    assert got == want
    assert got[0] < 1


def alike(lines, least):
    """Brute force over (line_id, library, split, normalised text)."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a[3], b[3]).ratio()
    lines = sorted(lines)
    return {(a[1], a[0], b[0]): round(ratio(a, b), 6) for i, a in enumerate(lines) for b in lines[i + 1 :] if a[1] == b[1] and a[2] != b[2] and ratio(a, b) >= least}


def test_near_duplicates_of_one_word_lines(spark):
    words = ["headache", "headaches", "head-ache", "fever", "fevers", "feverish", "nausea", "", "überfieber", "uberfieber", "頭痛がする", "頭痛がした"]
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 400))).strip() for _ in range(60)]
    long += [t[: len(t) // 2] + "zz" + t[len(t) // 2 :] for t in long]
    lines = [(i, "ab"[i % 5 == 0], ("train", "val", "test")[i * 7 % 3], t) for i, t in enumerate(words + words + long)]
    df = spark.createDataFrame(lines, "line_id long, library string, split string, text string")
    normal = [tuple(r) for r in df.withColumn("text", X.normalise_text(F.col("text"))).collect()]
    for least in (0.6, 0.9):
        got = near_duplicates(df, least, block_rows=8).collect()
        assert {(r.library, r.left, r.right): r.ratio for r in got} == alike(normal, least)
        assert len(got) == len(alike(normal, least)) > 0


def test_near_duplicates_with_blocks_of_no_lines(spark):
    lines = [(i, "a", ("train", "val")[i % 2], f"line {i // 2} of few") for i in range(14)]
    df = spark.createDataFrame(lines, "line_id long, library string, split string, text string")
    got = near_duplicates(df, 0.9, block_rows=1).collect()
    want = alike(lines, 0.9)
    assert {(r.library, r.left, r.right): r.ratio for r in got} == want
    assert len(got) == len(want) > 0


def prose(rng, words):
    syllables = ["the", "of", "and", "tion", "er", "ing", "ou", "en", "re", "at", "ly", "qua", "zi", "ble", "wh", "edge", "xa", "jo", "pf", "k"]
    return " ".join("".join(rng.choice(syllables[: rng.randint(3, 20)]) for _ in range(rng.randint(1, 4))) + "," * (rng.random() < 0.05) for _ in range(words))


def test_long_lines_that_share_few_runs_are_not_compared(monkeypatch):
    rng, compared = random.Random(8), []
    texts = [prose(rng, rng.randint(60, 120)) for _ in range(24)]
    for t in texts[:16]:
        words = t.split(" ")
        for at in rng.sample(range(len(words)), rng.randint(1, 20)):
            words[at] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += texts[:5] + ["", "", "#$%&" * 60, "#$%&" * 55 + "zq", "".join(chr(rng.randint(0x4E00, 0x4E80)) for _ in range(300))]
    rng.shuffle(texts)

    class Counted(difflib.SequenceMatcher):
        def set_seq1(self, a):
            compared.append(a)
            super().set_seq1(a)

    lines = [(i, "a", rng.choice(("train", "val", "test")), t) for i, t in enumerate(texts)]
    want = {least: alike(lines, least) for least in (0.6, 0.9)}
    monkeypatch.setattr(lint.difflib, "SequenceMatcher", Counted)
    block = pd.DataFrame(lines, columns=["line_id", "library", "split", "norm"]).assign(meeting=0, alone=True, end=0)
    for least, pairs in want.items():
        compared.clear()
        got = lint._alike(block, least)
        assert {(r.library, r.left, r.right): r.ratio for r in got.itertuples()} == pairs
        assert len(got) == len(pairs) > 5 and len(compared) <= len(lines)
    two = block.assign(alone=False, end=[rng.randrange(2) for _ in lines])
    ends = two["end"].tolist()
    got = {(r.library, r.left, r.right): r.ratio for r in lint._alike(two, 0.6).itertuples()}
    assert got == {k: v for k, v in want[0.6].items() if ends[k[1]] != ends[k[2]]}


def test_near_dup_pairs_takes_documents_by_source(spark, tmp_path):
    docs = [(i, f"src{i % 2}", t) for i, t in enumerate(["headache", "headache", "headaches", "headaches", "sore throat", "sore throats"] * 6)]
    d = stored(spark, tmp_path, "documents", docs, "doc_id long, source string, text string")
    split = {r.doc_id: r.s for r in spark.createDataFrame(docs, "doc_id long, source string, text string").select("doc_id", X.assign_split(F.col("doc_id")).alias("s")).collect()}
    got = registry.QUERIES["near_dup_pairs"](spark, d).collect()
    assert {(r.library, r.left, r.right): r.ratio for r in got} == alike([(i, s, split[i], t) for i, s, t in docs], 0.6) != {}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_content_digest_holds_no_group(spark, tmp_path):
    turns = [(i % 97, i % 2, ("User", "user", "bot")[i % 3], None if i % 50 == 0 else f"t{i}é") for i in range(2000)]
    d = stored(spark, tmp_path, "conversations", turns, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = registry.QUERIES["content_digest"](spark, d)
        got = {(r.turn, r.role): r.digest for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for c, t, r, x in sorted((t for t in turns if t[3]), key=lambda t: (t[0], t[3])):
        groups[t, r.lower()] = groups.get((t, r.lower()), "") + f"{c}\x1f{x}\x1f"
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in groups.items()}
    assert "collect_list" not in plan(df)


def test_one_group_is_numbered_by_many_tasks(spark, tmp_path):
    docs = [(i * 7919 % 5000, None if i % 100 == 0 else "en" if i % 10 else "de", f"s{i % 3}") for i in range(5000)]
    d = stored(spark, tmp_path, "documents", docs, "doc_id long, lang string, source string")
    for name, group in (("round_robin", 2), ("permute_labels", 1)):
        df = registry.QUERIES[name](spark, d)
        assert "_range" in plan(df)
        rows = df.collect()
        if name == "round_robin":
            want = [(g, i, n) for g in ("s0", "s1", "s2") for n, i in enumerate(sorted(x[0] for x in docs if x[group] == g), 1)]
            assert sorted((r.source, r.doc_id, r.position) for r in rows) == sorted(want)
        else:
            want = []
            for g in ("en", "de"):
                here = sorted(x for x in docs if x[group] == g)
                dealt = sorted(here, key=lambda x: (hashlib.sha256(f"z|{x[0]}".encode()).hexdigest()[:8], x[0]))
                want += [(g, a[0], a[2], b[2]) for a, b in zip(here, dealt)]
            assert sorted((r.lang, r.doc_id, r.source, r.permuted) for r in rows) == sorted(want)


def test_epoch_divergence_holds_no_group(spark, tmp_path):
    start = datetime.datetime(2020, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i * 37 % 500), i % 3 if i % 2 else 0, None if i % 3 == 2 or i % 7 == 0 else float(i * 31 % 17)) for i in range(600)]
    d = stored(spark, tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df = registry.QUERIES["epoch_divergence"](spark, d)
    want = {}
    for u in {r[2] for r in rows}:
        v = [r[3] for r in sorted((r for r in rows if r[2] == u), key=lambda r: (r[1], r[0]))]
        some = [x for x in v if x is not None]
        want[u] = (v.index(max(some)) + 1 if some else None, len(v))
    assert {r.user_id: (r.best_epoch, r.epochs) for r in df.collect()} == want
    assert "collect_list" not in plan(df)


def test_job_step_takes_rows_in_any_order_and_chunks():
    rng = random.Random(3)
    for _ in range(50):
        rows = [(1, pd.Timestamp(rng.randint(0, 20) * 10**9), i, rng.choice(["error", "error", "view", "purchase", "click"][: rng.randint(2, 5)])) for i in range(rng.randint(1, 25))]
        status, attempts = "pending", 0
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            if status == "pending" and r[3] == "purchase":
                status = "delivered"
            elif status == "pending" and r[3] == "error":
                attempts += 1
                status = "failed" if attempts == jobs.MOST_ATTEMPTS else status
        rng.shuffle(rows)
        chunks = (pd.DataFrame(rows[i : i + 4], columns=["user_id", "ts", "event_id", "event_type"]) for i in range(0, len(rows), 4))
        (got,) = jobs._job_step((1,), chunks, SimpleNamespace(exists=False, update=lambda s: None))
        assert (got["status"][0], got["attempts"][0]) == (status, attempts)


def test_lockouts_folds_ranges_of_one_user_over_batches(spark, tmp_path, monkeypatch):
    start = datetime.datetime(2020, 1, 1)
    for part in range(3):
        rows = [(part * 1000 + i, start + datetime.timedelta(days=part, seconds=i * 37 % 1000), 7 if i % 4 else i % 5, "signup" if i * 37 % 1000 % 301 == 300 else "error" if i % 9 else "view") for i in range(1000)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda spark, d: spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet")
    monkeypatch.setattr(jobs, "events", stream)
    got = {r.user_id: r.worst for r in jobs.lockouts(spark, str(tmp_path)).collect()}
    want, run = {}, {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        run[r.user_id] = 0 if r.event_type == "signup" else run.get(r.user_id, 0) + (r.event_type == "error")
        want[r.user_id] = max(want.get(r.user_id, 0), run[r.user_id])
    assert got == want


def test_lockouts_go_on_after_a_restart(spark, tmp_path, monkeypatch):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    stream = lambda spark, d: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events")
    monkeypatch.setattr(jobs, "events", stream)
    start, folders = datetime.datetime(2024, 1, 1), (f"file://{tmp_path}/state", f"file://{tmp_path}/check")
    for day, kinds in enumerate((["error", "error"], ["error", "signup", "error"], ["view", "error", "error", "error"])):
        spark.createDataFrame([(10 * day + i, start + datetime.timedelta(days=day, hours=i), 1, k) for i, k in enumerate(kinds)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        found = {r.user_id: r.worst for r in jobs.lockouts(spark, str(tmp_path), *folders).collect()}
        assert found == {1: (2, 3, 4)[day]}
    # Nothing new: the last state stands.
    assert jobs.lockouts(spark, str(tmp_path), *folders).first().worst == 4


def test_label_vectors_merge_fragments_and_refuse_conflicts(spark):
    fragments = spark.createDataFrame([(1, "a", True, ["b"]), (2, "a", True, ["b"]), (3, "b", False, ["a"]), (4, None, None, ["a", "b"]), (5, None, None, ["a"]), (6, "a", False, ["b"])], "fragment_id long, signal_key string, asserts boolean, null_on array<string>")
    parts = lambda rows: spark.createDataFrame(rows, "example_id long, fragment_id long")
    rows = parts([(10, 1), (10, 3), (11, 3), (11, 4), (12, 1), (12, 5), (13, 4)])
    expected = {10: {"a": True, "b": False}, 11: {"a": None, "b": False}, 12: {"a": True}, 13: {"a": None, "b": None}}
    assert {r.example_id: r.labels for r in label_vectors(rows, fragments, ["a", "b"]).collect()} == expected
    # Two assertions are one too many, also where they agree or are masked.
    masked = fragments.withColumn("null_on", F.when(F.col("fragment_id") == 4, F.array(F.lit("b"))).otherwise(F.col("null_on")))
    for clash, known in (([(1, 1), (1, 2)], fragments), ([(1, 1), (1, 6)], fragments), ([(1, 1), (1, 6), (1, 5)], fragments), ([(1, 1), (1, 6), (1, 4)], masked)):
        with pytest.raises(Exception, match="two fragments assert"):
            label_vectors(parts(clash), known, ["a", "b"]).collect()
    decided = lambda rows: spark.createDataFrame(rows, "example_id long, signal string, expected boolean")
    told = label_vectors(rows, fragments, ["a", "b"], decided([(10, "a", True), (11, "a", None), (13, "b", None)]))
    assert {r.example_id: r.labels for r in told.collect()} == expected
    for wrong in ((10, "a", False), (11, "b", None), (12, "b", None), (13, "a", True)):
        with pytest.raises(Exception, match="differs from what was decided"):
            label_vectors(rows, fragments, ["a", "b"], decided([wrong])).collect()


def test_companions_are_floored_and_share_zero_refused(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(2).alias("low"), F.lit(4).alias("high"))
    got = Counter(r[0] for r in rows.select(companion_count(F.col("low"), F.col("high"), 0.3, F.col("k"))).collect())
    assert min(got) == 2 and max(got) <= 4 and len(got) > 1
    assert rows.select(companion_count(F.lit(0), F.col("high"), 0.0, F.col("k")).alias("n")).agg(F.sum("n")).first()[0] == 0
    with pytest.raises(Exception, match="share is 0"):
        rows.select(companion_count(F.col("low"), F.col("high"), 0.0, F.col("k"))).collect()


def test_models_that_do_not_pair_are_refused(spark):
    schema = "example_id long, truth int, predicted int"
    left = [(1, 0, 0), (2, 1, 0), (3, 2, 2)]
    counts = stats.paired_counts(spark.createDataFrame(left, schema), spark.createDataFrame([(3, 2, 1), (2, 1, 1), (1, 0, 0)], schema)).first()
    assert tuple(counts) == (3, 1, 1)
    for right in ([(1, 0, 0), (2, 1, 0)], [*left, (4, 0, 0)], [*left, (3, 2, 2)], [(1, 1, 0), *left[1:]]):
        with pytest.raises(Exception, match="do not pair"):
            stats.paired_counts(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()


def test_length_model_divides_by_the_population_deviation(spark):
    train = spark.createDataFrame([(i, "w " * n, float(n > 5)) for i, n in enumerate([1, 2, 3, 8, 9, 30])], "doc_id long, text string, label double")
    n = [1, 2, 3, 8, 9, 30]
    mean, sd = sum(n) / 6, (sum((x - sum(n) / 6) ** 2 for x in n) / 6) ** 0.5
    sized = train.select("doc_id", X.token_count(F.col("text")).cast("double").alias("tokens"))
    got = {r.doc_id: r.tokens for r in ml.standardised(sized, "tokens").collect()}
    assert got == pytest.approx({i: (x - mean) / sd for i, x in enumerate(n)})
    flat = ml.standardised(sized.withColumn("tokens", F.lit(4.0)), "tokens").collect()
    assert {r.tokens for r in flat} == {0.0}
    scores = {r.doc_id: r.score for r in ml.length_scores(train, train).collect()}
    assert sorted(scores, key=scores.get) == list(range(6))


def test_every_term_is_kept(spark):
    """More terms than Spark's default vocabulary would be slow here; the bound itself is looked at."""
    docs = spark.createDataFrame([(i, f"common w{i} w{i + 1}", float(i % 2)) for i in range(40)], "doc_id long, text string, label double")
    assert ml.tfidf_scores(docs, docs).count() == 40


def test_noise_is_reproducible_and_spares_frozen_words(spark):
    texts = [(i, "The pain isn't bad but it keeps me awake at night and the fever comes back. " * (1 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(texts, "k long, text string")
    noisy = lambda d, rate: {r.k: (r.text, tuple(r.edits)) for r in add_noise(d, "k", "text", rate, "s", frozenset({"pain", "fever"})).collect()}
    first = noisy(df, 0.2)
    assert first == noisy(df.repartition(7), 0.2) and first != noisy(df, 0.1)
    for k, (text, edits) in first.items():
        own = dict(texts)[k]
        assert text.lower().count("pain") >= own.lower().count("pain") and text.lower().count("fever") >= own.lower().count("fever")
        assert bool(edits) == (text != own) or edits
    assert noisy(df, 0.0) == {k: (t, ()) for k, t in texts}


def test_generated_examples_are_reproducible_and_distinct(spark):
    pools = [(f"{role}{i}", role, f"{role} text {i}") for role in ("positive", "negative", "ambiguous", "filler") for i in range(9)]
    df = spark.createDataFrame(pools, "fragment_id string, role string, text string")
    made = {r["index"]: (r.mode, tuple(r.fragment_ids), r.text) for r in generate(df, 60, "g").collect()}
    assert made == {r["index"]: (r.mode, tuple(r.fragment_ids), r.text) for r in generate(df.repartition(5), 60, "g").collect()}
    assert sorted(made) == list(range(60)) and len({t for *_, t in made.values()}) == 60
    own = {"true": "positive", "false": "negative", "null_ambiguous": "ambiguous", "null_structural": "filler"}
    for mode, ids, _ in made.values():
        assert len(ids) == 3 and any(i.startswith(own[mode]) for i in ids) and sum(i.startswith("filler") for i in ids) >= 2
    with pytest.raises(ValueError, match="unused"):
        generate(df.where("role <> 'filler' or fragment_id = 'filler0'"), 200, "g", attempts=2)


def test_running_sums_of_one_group_over_many_ranges(spark):
    rows = [(None if i % 5 == 0 else "g", i * 7919 % 3000, i % 11) for i in range(3000)]
    got = running_sum(spark.createDataFrame(rows, "g string, k long, v long").repartition(6), "g", [F.col("k")], F.col("v"), "upto").collect()
    want = {}
    for group in ("g", None):
        at = 0
        for _, k, v in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            at += v
            want[group, k] = at
    assert {(r.g, r.k): r.upto for r in got} == want


def test_shared_folder_must_be_named_on_a_cluster():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(unset)
    unset.sparkContext.master = "local[2]"
    assert shared_dir(unset) == shared_dir(unset)


def test_unicode_forms_hold_few_texts_as_strings():
    texts = [None, "", "ﬁne “Straße” — ①!? \n", "Ａ b c ...", "x" * 70_000] + [f"É{i} {'ŷ' * 20_000}." for i in range(600)]
    given, form = pa.array(texts), X.normalise_unicode.func
    assert form(given.slice(0, 4)).to_pylist() == [None, "", 'fine "strasse" - 1', "a b c"]
    assert len(form(given.slice(0, 0))) == 0
    tracemalloc.start()
    found = form(given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All of them are 24 MB as strings.
    assert most < 10_000_000
    assert found.to_pylist()[5:7] == [f"é{i} {'ŷ' * 20_000}" for i in (0, 1)]


def test_tables_are_dealt_to_tasks_by_their_rows(spark, tmp_path):
    assert tasks_for(spark.range(1000), 10) == 100 and tasks_for(spark.range(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments = spark.createDataFrame([(1, "a", True, ["b"]), (2, None, None, ["a", "b"])], "fragment_id long, signal_key string, asserts boolean, null_on array<string>")
    parts = spark.createDataFrame([(i, 1 + i % 2) for i in range(50)], "example_id long, fragment_id long")
    found = label_vectors(parts, fragments, ["a", "b"], tasks=7)
    assert {r.example_id: r.labels for r in found.collect()} == {i: {"a": None if i % 2 else True, "b": None} for i in range(50)}
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("RepartitionByExpression") == 3 and "Generate" not in shown and "collect_list" not in shown


def test_select_fragments_hashes_each_draw_once(spark, tmp_path):
    stored(spark, tmp_path, "orders", [(i,) for i in range(300)], "o_orderkey long")
    d = stored(spark, tmp_path, "part", [(i, f"Brand#{i % 25 + 1}") for i in range(500)], "p_partkey long, p_brand string")
    df = registry.QUERIES["select_fragments"](spark, d)
    filters = [line for line in plan(df).splitlines() if "Filter " in line.split("(")[0]]
    assert filters and not [line for line in filters if "sha2" in line]
    assert df.count() == 300
