import importlib
import random
from collections import Counter

import pytest
from test_jaccard import brute
from test_models_and_graphs import SYLLABLES, brute_targets, prose

from strandmill.llm import packing

pipeline = pytest.importorskip("corpus_pipeline")


def rows():
    """Clean texts in three languages, copies, near copies, and texts without a language."""
    rng, out = random.Random(12), []
    for lang in SYLLABLES:
        for _ in range(60):
            text = prose(rng, lang, rng.randint(30, 200))
            out.append((text, lang))
            if rng.random() < 0.2:
                out += [(text, lang)] * 3
            if rng.random() < 0.3:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "ka"
                out.append((" ".join(words), lang))
    out += [(None, "aa"), ("", "bb"), ("123 456 !!", "aa"), ("² ½ Ⅷ", "aa"), ("① ②", "cc"), ("12", None)] + [("77 88", "cc")] * 20
    rng.shuffle(out)
    return [(i, t, lang, rng.choice(["web"] * 8 + ["code", None]), len(t or "")) for i, (t, lang) in enumerate(out)]


def test_stages_match_brute_force(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stages = docs.columns, []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        stages.append(docs.collect())
        assert n == len(pipeline.STAGES) - 1 or docs.columns == columns
    spoken, exact, near, mixed, packed = stages

    texts = {i: t for i, t, *_ in given}
    assert Counter(r.doc_id for r in spoken) == Counter(i for i, t in texts.items() if any(map(str.isalpha, t or "")))

    last = {}
    for r in spoken:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    groups = brute([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, least) in groups.items() if i == least) and len(near) < len(exact)

    sizes, taken = Counter(), Counter()
    for r in near:
        sizes[r.source] += len(r.text.split(" "))
    for r in mixed:
        taken[r.source] += len(r.text.split(" "))
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    for s, t in brute_targets(sizes).items():
        assert t - 1 <= taken[s] <= t + 201  # the last document is whole

    tokens = packing.TextTokenizer(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    times = Counter(r.doc_id for r in mixed)
    assert length == {i: n * (len(tokens.text_ids(texts[i])) // 4 + 1) for i, n in times.items()}

    whole = pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == length


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_all_stages_by_their_texts(spark, tmp_path):
    """Null and repeated ids, equal rows, a very long text, null sources, and columns named as stages name theirs."""
    rng = random.Random(21)
    given = [(i, t, lang, source, n) for i, t, lang, source, n in rows()][:150]
    given = [(None if i % 7 == 0 else i % 40, *rest) for i, *rest in given]
    long = prose(rng, "aa", 30_000)
    given += [(5, long, "aa", None, len(long)), (None, long, "aa", "web", 0), (5, long, "aa", None, len(long)), *[given[0]] * 3]
    clashing = {n: rng.choice(["1", "x"]) for n in ("size", "members", "key", "row", "component_id", "keep_id", "rid", "id", "score", "passes")}
    from pyspark.sql import functions as F

    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in clashing.items()}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stages = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        stages.append(docs.collect())
        assert n == len(pipeline.STAGES) - 1 or docs.columns == columns
    _, spoken, exact, near, mixed, packed = stages
    assert Counter((r.doc_id, r.text) for r in spoken) == Counter((i, t) for i, t, *_ in given if any(map(str.isalpha, t or "")))
    last = {}
    for r in spoken:
        last[r.text] = max(last.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in exact) == sorted(last.items())
    # Rows stand for themselves, so they are numbered to find their groups.
    numbered = list(enumerate(exact))
    groups = Counter(least for _, least in brute([(i, r.text) for i, r in numbered], 5, 80).values())
    assert len(near) == len(groups) < len(exact) and set(r.text for r in near) <= set(last)
    assert Counter(r.text for r in mixed).keys() <= Counter(r.text for r in near).keys() and max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 3
    tokens = packing.TextTokenizer(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(tokens.text_ids(r.text)) // 4 + 1 for r in mixed)
