import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandmill.sources import tree

EXAMPLES = "fold int, split string, example_id string, text string, labels map<string,boolean>, fragment_ids array<string>"
FRAGMENTS = "fold int, split string, fragment_id string, cluster_key string"
SETTINGS = {"generator_version": "1", "signal": "a", "split_salt": "s"}


def frames(spark, change=lambda rows: rows):
    places = [(k, s) for k in range(2) for s in tree.SPLITS]
    rows = [(k, s, f"{s}{i}", f"text {i}", {"a": [True, False, None][i % 3]} | ({"b": True} if i % 2 else {}), [f"{k}{s}{i % 3}"]) for k, s in places for i in range(9)]
    fragments = [(k, s, f"{k}{s}{i}", f"c{k}{s}{i}") for k, s in places for i in range(3)]
    return spark.createDataFrame(change(rows), EXAMPLES), spark.createDataFrame(fragments, FRAGMENTS)


def test_sidecars_hold_what_a_recount_gives(spark, tmp_path):
    examples, fragments = frames(spark)
    root = f"file://{tmp_path}/tree"
    told = tree.write_tree(examples, fragments, root, SETTINGS, ["a", "b"], 2)
    read = [json.loads(r.stats) for r in tree.read_sidecars(spark, root).orderBy("fold", "split").collect()]
    assert sorted(told, key=str) == sorted(read, key=str) and len(read) == 6
    for stats in read:
        own = [r for r in tree.load_tree(spark, root, 2).where((F.col("fold") == stats["fold_index"]) & (F.col("split") == stats["split"])).collect()]
        assert stats["count"] == len(own) == 9
        for signal in "ab":
            values = [r.labels[signal] for r in own if signal in r.labels]
            assert stats["labels"][signal] == {"true": values.count(True), "false": values.count(False), "null": values.count(None)}
    with pytest.raises(FileExistsError):
        tree.write_tree(examples, fragments, root, SETTINGS, ["a"], 2)


def test_a_failed_write_leaves_nothing_under_the_name(spark, tmp_path):
    examples, fragments = frames(spark)
    failing = fragments.withColumn("cluster_key", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tree.write_tree(examples, failing, f"file://{tmp_path}/tree", SETTINGS, ["a"], 2)
    assert not (tmp_path / "tree").exists()


def test_one_fold_opens_its_own_files_only(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    tree.write_tree(*frames(spark), root, SETTINGS, ["a"], 2)
    one = tree.read_examples(spark, root).where("fold = 1 and split = 'val'")
    assert all("/fold=1/split=val/" in f for f in one.select("_metadata.file_path").distinct().toPandas()["file_path"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*fold[^]]*split", plan)


def faults(spark, root):
    return {(r["check"], r["key"]) for r in tree.tree_violations(spark, root, 2).collect()}


def test_each_fault_is_named_and_refused(spark, tmp_path):
    repeat = lambda rows: [*rows, rows[0]]
    unknown = lambda rows: [(*rows[0][:5], ["nowhere"]), *rows[1:]]
    without = lambda rows: [(*rows[0][:5], []), *rows[1:]]
    for n, (change, check) in enumerate([(repeat, ("example_repeats", "0/train/train0")), (unknown, ("fragment_unknown", "0/train/train0/nowhere")), (without, ("example_without_fragments", "0/train/train0"))]):
        root = f"file://{tmp_path}/tree{n}"
        tree.write_tree(*frames(spark, change), root, SETTINGS, ["a"], 2)
        assert faults(spark, root) == {check}
        with pytest.raises(ValueError, match=check[0]):
            tree.load_tree(spark, root, 2)
    root = f"file://{tmp_path}/sound"
    tree.write_tree(*frames(spark), root, SETTINGS, ["a"], 2)
    assert faults(spark, root) == set()
    stats = tmp_path / "sound/stats/fold=1/split=val/stats.json"
    given = json.loads(stats.read_text())
    (stats.parent / ".stats.json.crc").unlink(missing_ok=True)
    for changed, named in (({k: v for k, v in given.items() if k != "signal"}, {("sidecar_key_missing", "1/val/signal"), ("configuration_differs_within_fold", "1")}), (given | {"count": 8}, {("count_differs", "1/val")}), (given | {"split": "test"}, {("split_differs_from_path", "1/val")})):
        stats.write_text(json.dumps(changed))
        assert faults(spark, root) == named
    stats.unlink()
    assert ("file_missing", "1/val") in faults(spark, root)


def test_lines_are_numbered_through_all_ranges_of_a_file(spark, tmp_path):
    lines = ["" if i % 50 == 7 else "{" if i % 97 == 3 else "[1]" if i % 101 == 5 else '{"a": 1, "a": 2}' if i == 400 else json.dumps({"n": i, "pad": "x" * (i % 40)}) for i in range(1, 1200)]
    for name, own in (("one.json", lines), ("two.json", lines[:300]), ("empty.json", [])):
        Path(tmp_path / name).write_text("".join(x + "\n" for x in own))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = tree.line_errors(spark, f"file://{tmp_path}")
        ranges = found.rdd.getNumPartitions()
        rows = sorted((r.file.rpartition("/")[2], r.line, r.error) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    wrong = lambda name, own: [(name, i, "not a JSON object" if x == "[1]" else "not valid JSON") for i, x in enumerate(own, 1) if x == "[1]" or x == "{" or '"a": 2' in x]
    assert rows == sorted(wrong("one.json", lines) + wrong("two.json", lines[:300])) and ranges > 1


def test_tables_of_a_tree_are_read_with_their_types(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    tree.write_tree(*frames(spark), root, SETTINGS, ["a"], 2)
    assert dict(tree.read_fragments(spark, root).dtypes)["fold"] == "int"
    assert {r.labels["a"] for r in tree.read_examples(spark, root).collect()} == {True, False, None}


def test_checks_parse_the_examples_once(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    tree.write_tree(*frames(spark), root, SETTINGS, ["a", "b"], 2)
    for line in ("", "  ", "{", "[1]", '{"example_id": "n", "example_id": "m", "fragment_ids": ["0val0"]}', '{"example_id": "o", "labels": 3, "fragment_ids": ["0val1"]}'):
        (tmp_path / f"tree/examples/fold=0/split=val/more{len(line)}.json").write_text(line + "\n")
    wrong = tree.tree_violations(spark, root, 2)
    assert sorted((r["check"], r["key"]) for r in wrong.collect()) == [("count_differs", "0/val"), ("line", "fold=0/split=val: not a JSON object"), *[("line", "fold=0/split=val: not valid JSON")] * 2]
    # The examples' own files are not opened again.
    opened = wrong.inputFiles()
    assert not [f for f in opened if "/tree/examples/" in f] and [f for f in opened if "/tree/stats/" in f]
