import datetime
import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandmill.operators import holdout, stats, versions
from strandmill.streaming import state

COMMANDS = "key long, ts timestamp, command long, base long, closes boolean"
SESSIONS = "key long, version long, closed boolean"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def drawn_commands(count, seed):
    """Half of all commands are on one session; bases trail the versions, repeat, are null or from nowhere."""
    draw, near = random.Random(seed), defaultdict(int)
    rows = []
    for i in range(count):
        key = 1 if draw.random() < 0.5 else draw.choice([2, 3, 4, 5, 6, 99, None])
        base = near[key] - draw.choice([0, 0, 0, 1, 2]) if draw.random() < 0.9 else draw.choice([None, 10**6])
        near[key] += base == near[key]
        rows.append((key, at(draw.randint(0, count)), i, base, draw.choice([None, False, False, draw.random() < 0.02])))
    return rows


KNOWN = {1: (0, False), 2: (0, False), 3: (2, False), 4: (0, True), 5: (1, False), 6: (0, False)}


def looped(rows, known):
    """Outcomes by command of a plain loop in the order of time."""
    now, found = dict(known), {}
    for key, _, command, base, closes in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in now:
            found[command] = ("unknown", None)
            continue
        version, closed = now[key]
        if closed:
            outcome = "closed"
        elif base != version:
            outcome = "conflict"
        else:
            outcome, version, closed = "accepted", version + 1, bool(closes)
        now[key] = (version, closed)
        found[command] = (outcome, version)
    return found


def test_stretches_are_mapped_as_they_are_walked():
    draw = random.Random(2)
    for _ in range(200):
        steps = [(draw.randint(0, 5), draw.random() < 0.1) for _ in range(draw.randint(0, 12))]
        found = versions.stretch_map([b for b, _ in steps], [c for _, c in steps])
        for start in range(8):
            version, closed = start, False
            for base, closes in steps:
                _, version, closed = versions.decide(version, closed, base, closes)
            assert found.get(start, (start, False)) == (version, closed)


@pytest.mark.parametrize("ranges, seed", [(1, 3), (7, 4), (40, 5)])
def test_versions_in_ranges_equal_a_loop(spark, ranges, seed):
    rows = drawn_commands(600, seed)
    sessions = spark.createDataFrame([(k, *v) for k, v in KNOWN.items()], SESSIONS)
    found = versions.append_versions(spark.createDataFrame(rows, COMMANDS), sessions, "key", ["ts", "command"], "base", "closes", ranges).collect()
    assert {r.command: (r.outcome, r.version) for r in found} == looped(rows, KNOWN) and len(found) == len(rows)
    assert {o for o, _ in looped(rows, KNOWN).values()} == {"accepted", "conflict", "closed", "unknown"}


def test_versions_of_nothing(spark):
    sessions = spark.createDataFrame([(1, 0, False)], SESSIONS)
    assert versions.append_versions(spark.createDataFrame([], COMMANDS), sessions, "key", ["ts", "command"], "base", "closes").count() == 0


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_version_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(drawn_commands(300, 6), key=lambda r: (r[1], r[2]))
    source, sink, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    sessions = spark.createDataFrame([(k, *v) for k, v in KNOWN.items()], SESSIONS)
    for part in (rows[:130], rows[130:]):
        add(spark, source, part, COMMANDS)
        outputs = state.version_stream(streamed(spark, source, COMMANDS), sessions, sink, check)
    accepted, rejected = ([tuple(r) for r in outputs[n].select("command", "outcome", "version").collect()] for n in ("accepted", "rejected"))
    assert {o for _, o, _ in accepted} == {"accepted"} and "accepted" not in {o for _, o, _ in rejected}
    assert {c: (o, v) for c, o, v in accepted + rejected} == looped(rows, KNOWN) and len(accepted + rejected) == len(rows)


EVENTS = "key long, ts timestamp, event long, kind string"


def leased(rows, lease, backoff, until):
    """Plain loop over (key, seconds, event, kind)."""
    jobs, found = {}, []
    for key, second, event, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        job = jobs.get(key)
        if job and job[1] is not None and job[1] <= second:
            found.append((key, job[1], None, "visible"))
            job[1] = None
        if not job:
            if kind == "create":
                jobs[key] = [0, None]
            told = "created" if kind == "create" else "unknown"
        elif kind == "claim":
            told = "claimed" if job[1] is None else "hidden"
            job[1] = job[1] or second + lease
        elif kind == "fail":
            job[0] += 1
            told, job[1] = ("retry", second + job[0] * backoff) if job[0] < 4 else ("failed", None)
            if job[0] == 4:
                del jobs[key]
        elif kind == "deliver":
            told = "delivered"
            del jobs[key]
        else:
            told = "ignored"
        found.append((key, second, event, told))
    return sorted(found + [(k, h, None, "visible") for k, (_, h) in jobs.items() if h is not None and h < until], key=repr)


def test_leases_expire_by_timers_and_restarts_keep_them(spark, tmp_path):
    draw = random.Random(8)
    rows = [(draw.randint(1, 4), draw.randint(1, 40_000), i, draw.choice(["create", "claim", "claim", "fail", "fail", "deliver", "other"])) for i in range(160)]
    rows += [(7, 10, 900, "create"), (7, 20, 901, "claim"), (7, 30, 902, "claim"), (7, 619, 903, "claim"), (7, 620, 904, "claim"), (8, 39_000, 905, "create"), (8, 39_990, 906, "claim"), (9, 50, 907, "create"), (9, 60, 908, "claim")]
    rows.sort(key=lambda r: (r[1], r[2]))
    source, sink, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for part in (rows[:90], rows[90:]):
        add(spark, source, [(k, at(s), e, kind) for k, s, e, kind in part], EVENTS)
        found = state.lease_stream(streamed(spark, source, EVENTS), sink, check, 600, 900, "10 seconds")
    told = sorted(((r.key, round(r.ms / 1000 - START.timestamp()), r.event, r.outcome) for r in found.collect()), key=repr)
    expected = leased(rows, 600, 900, max(r[1] for r in rows) - 10)
    assert told == expected
    assert (7, 620, 904, "claimed") in told and (7, 619, 903, "hidden") in told and (9, 660, None, "visible") in told


def test_histories_grow_by_chunks(spark, tmp_path):
    rows = [(1 if i % 3 else 2 + i % 5, f"e{i}") for i in range(500)]
    source, sink, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for part in (rows[:200], rows[200:]):
        add(spark, source, part, "key long, entry string")
        log = state.history_stream(streamed(spark, source, "key long, entry string"), sink, check)
    held = defaultdict(list)
    for r in log.orderBy("key", "place").collect():
        held[r.key].append((r.place, r.entry))
    for key in {k for k, _ in rows}:
        assert [p for p, _ in held[key]] == list(range(1, sum(k == key for k, _ in rows) + 1))
        assert sorted(e for _, e in held[key]) == sorted(e for k, e in rows if k == key)
        assert {e for _, e in held[key][: sum(k == key for k, _ in rows[:200])]} == {e for k, e in rows[:200] if k == key}


def test_sessions_close_once_and_open_ones_are_told(spark, tmp_path):
    rows = [(1, 0), (1, 50), (1, 1000), (2, 30), (3, 5000), (3, 5050), (1, 5070)]
    source, sink, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for part in (rows[:4], rows[4:]):
        add(spark, source, [(k, at(s)) for k, s in part], "key long, ts timestamp")
        found = state.session_stream(streamed(spark, source, "key long, ts timestamp"), sink, check, "100 seconds", "10 seconds")
    assert sorted((r.key, r.n, r.open) for r in found.collect()) == [(1, 1, False), (1, 1, True), (1, 2, False), (2, 1, False), (3, 2, True)]


# --- grouped bootstrap ---


def poisson_copies(unit, resample, seed):
    digest = hashlib.sha256(f"{seed}|{unit}|{resample // 16}".encode()).hexdigest()
    draw = int(digest[4 * (resample % 16) :][:4], 16)
    return sum(draw >= math.floor(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(8))


def predictions(spark):
    draw = random.Random(9)
    rows = [(signal, fold, f"u{u}", draw.randint(0, 2), draw.randint(0, 2)) for signal in "ab" for fold in (0, 1) for u in range(30) for _ in range(draw.randint(1, 4))]
    rows += [("c", 0, "alone", 1, 1)]
    return rows, spark.createDataFrame([(s, f, u, t, p, f"{i}") for i, (s, f, u, t, p) in enumerate(rows)], "signal string, fold int, unit string, truth int, predicted int, example_id string")


def test_grouped_bootstrap_equals_plain_resampling(spark):
    rows, preds = predictions(spark)
    found = defaultdict(dict)
    for r in stats.grouped_bootstrap(preds, ["signal", "fold"], 37, stats.accuracy()).collect():
        found[r.signal, r.fold][r.resample] = r.value
    groups = defaultdict(list)
    for s, f, u, t, p in rows:
        groups[s, f].append((u, t == p))
    for group, own in groups.items():
        for resample in range(37):
            weights = [(poisson_copies(u, resample, "b"), right) for u, right in own]
            total = sum(w for w, _ in weights)
            if total:
                assert found[group][resample] == pytest.approx(sum(w for w, right in weights if right) / total)
            else:
                assert resample not in found[group]


def test_copies_follow_a_poisson_distribution():
    shares = [sum(poisson_copies(u, r, "x") == k for u in range(200) for r in range(64)) / 12_800 for k in range(4)]
    assert shares == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.02)


def test_fold_intervals_hold_their_points_and_count_used_resamples(spark):
    _, preds = predictions(spark)
    found = {(r.signal, r.slice, r.fold): r for r in holdout.fold_intervals(preds, 100).collect()}
    plain = {(r.signal, r.slice, r.fold): r for r in holdout.fold_scores(preds).collect()}
    assert found.keys() == plain.keys()
    for key, r in found.items():
        assert (r.n, r.effective_n, r.accuracy) == (plain[key].n, plain[key].effective_n, plain[key].accuracy)
        assert r.low <= r.accuracy <= r.high
        assert r.half_width == pytest.approx(1.959963984540054 * math.sqrt(0.25 / r.effective_n), abs=1e-6)
    alone = found["c", "all", 0]
    assert alone.used == sum(poisson_copies("alone", i, "b") > 0 for i in range(100)) and (alone.low, alone.high) == (1.0, 1.0)


def test_interval_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        stats.grouped_interval(spark.createDataFrame([(1, 0.5)], "g int, value double"), ["g"], 1.0)


def test_groups_without_values_have_null_bounds(spark):
    found = stats.grouped_interval(spark.createDataFrame([(1, None), (2, 0.5)], "g int, value double"), ["g"]).orderBy("g").collect()
    assert [(r.low, r.high, r.used) for r in found] == [(None, None, 0), (0.5, 0.5, 1)]


def test_grouped_bootstrap_makes_no_row_for_each_draw(spark):
    preds = spark.range(20_000).selectExpr("'s' AS signal", "id % 2 AS fold", "id AS unit", "cast(id % 3 AS int) AS truth", "cast(id % 5 % 3 AS int) AS predicted")
    values = stats.grouped_bootstrap(preds, ["signal", "fold"], 200, stats.accuracy())
    shown = values._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in shown
    assert values.count() == 400
    # A null unit is one, named by the seed alone.
    alone = stats.grouped_bootstrap(preds.limit(1).withColumn("unit", F.lit(None).cast("long")), ["signal"], 40, stats.accuracy()).collect()
    drawn = [int(hashlib.sha256(f"b|{i // 16}".encode()).hexdigest()[4 * (i % 16) :][:4], 16) >= math.floor(65536 / math.e) for i in range(40)]
    assert {r.resample for r in alone} == {i for i, d in enumerate(drawn) if d}


def test_version_stream_stores_sessions_with_commands_alone(spark, tmp_path):
    source, sink, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    sessions = spark.range(5000).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("version"), F.lit(False).alias("closed"))
    add(spark, source, [(7, at(1), 1, 0, False), (7, at(2), 2, 1, True), (8, at(1), 3, 4, False), (9000, at(1), 4, 0, False)], COMMANDS)
    state.version_stream(streamed(spark, source, COMMANDS), sessions, sink, check)
    # Another state before the first batch, which is not read any more.
    add(spark, source, [(7, at(3), 5, 2, False), (8, at(3), 6, 0, False), (9000, at(3), 7, 0, False)], COMMANDS)
    outputs = state.version_stream(streamed(spark, source, COMMANDS), spark.createDataFrame([(9000, 0, False)], SESSIONS), sink, check)
    found = {r.command: (r.outcome, r.version) for n in outputs for r in outputs[n].collect()}
    assert found == {1: ("accepted", 1), 2: ("accepted", 2), 3: ("conflict", 0), 4: ("unknown", None), 5: ("closed", 2), 6: ("accepted", 1), 7: ("unknown", None)}
    with state.settings(spark, state.STATE):
        held = spark.read.format("statestore").option("path", check).option("stateVarName", "session").load()
    assert {r.key.key for r in held.collect()} == {7, 8}
