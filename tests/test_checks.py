"""Violations, draws and choices against plain Python on small fixtures."""

import hashlib
import hmac
import math
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandmill.functions.numbers import binomial_tail
from strandmill.operators import checks, holdout, lint, recombination, stats
from strandmill.operators import folds as L
from strandmill.plans import registry


def test_tokens_are_signed_as_pythons_are(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-{i + 1:02d} 10:0{i}:00") for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.token for r in registry.QUERIES["hmac_token"](spark, str(tmp_path)).collect()}
    for i, user, t in rows:
        time = t[:16].translate(str.maketrans("", "", "-: "))
        sign = hmac.new(b"shared key", f"{user}:{i}:1:password:{time}".encode(), hashlib.sha256).hexdigest()
        assert got[i] == f"{user}:{i}:1:{time}:{sign}"
    for key in ("", "k" * 64, "k" * 65, "schlüssel" * 30):
        found = spark.range(1).select(checks.hmac_sha256(key, F.lit("ä message")).alias("h")).first().h
        assert found == hmac.new(key.encode(), "ä message".encode(), hashlib.sha256).hexdigest()


def test_decimal_places_are_those_of_pythons_decimals(spark):
    from decimal import Decimal

    from strandmill.functions.numbers import decimal_places
    from strandmill.operators.rules import number_failure

    texts = ["0", "12", "12.5", "12.50", "1e-7", "1.25e1", "1.25E+1", "1e3", "-3.1e-2", "0.000", "5e0", "1.e1", ".5"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "NaN", "-Infinity", "true", "x"]], "t string").select("t", decimal_places(F.col("t")).alias("n"), number_failure(F.col("t"), 1).alias("f")).collect()
    for r in rows[: len(texts)]:
        exponent = Decimal(r.t).as_tuple().exponent
        assert r.n == max(0, -exponent) and r.f == ("precision" if -exponent > 1 else None), r.t
    assert [r.f for r in rows[len(texts) :]] == ["missing", "not_finite", "not_finite", "not_a_number", "not_a_number"]


def test_webhooks_pass_all_gates_once(spark):
    sign = lambda stamp, token: hmac.new(b"key", f"{stamp}{token}".encode(), hashlib.sha256).hexdigest()
    rows = [(1, 1000, "1000", "a", sign("1000", "a")), (2, 1001, "1000", "a", sign("1000", "a")), (3, 1000, "1900", "b", sign("1900", "b")), (4, 1000, "1901", "c", sign("1901", "c")), (5, 1000, "1e3", "d", sign("1e3", "d")), (6, 1000, None, "e", "x"), (7, 1000, "1000", "f", sign("1000", "g")), (8, 1000, "1000", "f", None), (9, 999, "1000", "f", sign("1000", "f")), (10, 1000, " 1000", None, sign(" 1000", ""))]
    found = checks.webhook_outcomes(spark.createDataFrame(rows, "id long, received long, stamp string, token string, signature string"), "key").collect()
    assert {r.id: r.outcome for r in found} == {1: "accepted", 2: "replayed", 3: "accepted", 4: "stale", 5: "malformed", 6: "malformed", 7: "bad_signature", 8: "bad_signature", 9: "accepted", 10: "accepted"}


def test_holdout_rejects_unknown_cells_missing_margins_and_scores(spark):
    held = spark.createDataFrame([(1, "true", ""), (2, "null", "false")], "submission_id long, a string, b string")
    cells = holdout.judged_cells(held, ["a", "b"])
    assert {tuple(r) for r in cells.collect()} == {(1, "a", 1), (2, "a", 2), (2, "b", 0)}
    scores = spark.createDataFrame([(0, i, s, [1, 5, 3] if s == "a" else [6, 5, 3]) for i in (1, 2) for s in "ab"], "fold int, submission_id long, signal string, scores array<long>")
    got = {r.example_id: r.predicted for r in holdout.cell_predictions(cells, scores, [0], {"a": 0, "b": 3}).collect()}
    assert got == {"1:a": 1, "2:a": 1, "2:b": 0}
    for bad in (holdout.cell_predictions(cells, scores, [0], {"a": 0}), holdout.cell_predictions(cells, scores, [0, 1]), holdout.judged_cells(held.withColumn("a", F.lit("maybe")), ["a"])):
        with pytest.raises(PySparkException):
            bad.collect()


def test_folds_that_disagree_on_size_raise(spark):
    rows = spark.createDataFrame([("s", "all", f, 10 + (f == 2), 5, 0.5 + f / 10) for f in range(3)], "signal string, slice string, fold int, n long, effective_n long, accuracy double")
    assert holdout.across_folds(rows.where("fold < 2")).first().folds == 2
    with pytest.raises(PySparkException):
        holdout.across_folds(rows).collect()


def test_sound_folds_and_libraries_have_no_violations(spark):
    files = spark.createDataFrame([(f, s, f, s, 2, "s", "1") for f in range(2) for s in L.SPLITS], "fold int, split string, recorded_fold int, recorded_split string, recorded_folds int, salt string, version string")
    assert L.sidecar_violations(files, 2).isEmpty()
    libraries = spark.createDataFrame([("a", "a.txt", "positive", "x", [("y", "policy", "why")]), ("b", "b.txt", "filler", None, [])], "name string, file string, fragment_type string, signal_key string, null_on array<struct<signal: string, basis: string, note: string>>")
    assert L.library_violations(libraries, ["x", "y"]).isEmpty()
    assert {r.check for r in L.library_violations(libraries.unionByName(libraries.where("name = 'a'")), ["x"]).collect()} == {"name_repeats", "unknown_silent_signal", "silence_repeats"}


def test_draws_refuse_more_groups_than_there_are_and_empty_pools(spark):
    wanted = spark.createDataFrame([("all", 1, 3)], "scope string, example_id long, companions int")
    pool = spark.createDataFrame([("all", "s0", "lib", 7), ("all", "s1", "lib", 8)], "scope string, group string, library string, fragment_id long")
    drawn = recombination.draw_companions(wanted.withColumn("companions", F.lit(2)), pool, ["s0", "s1"], "r").collect()
    assert sorted((r.group, r.fragment_id) for r in drawn) == [("s0", 7), ("s1", 8)]
    for bad in (recombination.draw_companions(wanted, pool, ["s0", "s1"], "r"), recombination.draw_companions(wanted, pool, ["s0", "s1", "s2"], "r")):
        with pytest.raises(PySparkException):
            bad.collect()


def test_resamples_hold_as_many_units_as_there_are(spark):
    units = spark.createDataFrame([(i, 1, i) for i in range(50)] + [(None, 1, 1000)], "unit int, n long, v long")
    got = stats.resampled(units, "unit", ["n", "v"], 20).collect()
    assert [r.n for r in got] == [51] * 20
    assert len({r.v for r in got}) > 10


def test_a_head_without_a_margin_raises(spark):
    preds = spark.createDataFrame([(h, i, i % 3, [1, 2, 3], 2) for h in "xy" for i in range(6)], "head string, unit int, truth int, scores array<long>, predicted int")
    with pytest.raises(PySparkException):
        stats.select_then_score(preds.where("head = 'x'"), {"test": preds}, [0, 1], "head").collect()


def test_lines_are_never_checked_against_their_own_signal(spark):
    lines = spark.createDataFrame(
        [(1, "a", "positive", "fever", ["cough"], "hot and a cough"), (2, "f", "filler", None, ["fever"], "hot day"), (3, "f", "filler", None, [], "a dry cough"), (4, "f", "filler", None, ["fever"], "hotter"), (5, "g", "filler", None, None, None)],
        "line_id int, library string, kind string, own_signal string, absent array<string>, text string",
    )
    lexicons = {"fever": ["hot"], "cough": ["cough", "dry"]}
    found = lambda which: {(r.signal, r.line_id, tuple(r.terms)) for r in lint.signal_hits(lines, lexicons, which).collect()}
    assert found("all") == {("cough", 1, ("cough",)), ("fever", 2, ("hot",)), ("cough", 3, ("cough", "dry"))}
    assert found("filler") == {("fever", 2, ("hot",)), ("cough", 3, ("cough", "dry"))}
    assert found("absent") == {("cough", 1, ("cough",)), ("fever", 2, ("hot",))}


def test_binomial_tail_equals_whole_numbers_and_is_quick_for_large_counts():
    whole = lambda k, n: min(1.0, float((2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) * 10**18) // 2**n) / 1e18)
    for n in (0, 1, 7, 999, 1000, 1001, 3000):
        for k in {0, n // 3, max(0, n // 2 - 30), n // 2, n - n // 2, n}:
            assert binomial_tail(k, n) == pytest.approx(whole(k, n), abs=1e-9)
    start = time.monotonic()
    assert binomial_tail(299_000, 600_000) == pytest.approx(math.erfc((1000 - 0.5) / math.sqrt(600_000 / 2)), abs=1e-6)
    assert time.monotonic() - start < 1
