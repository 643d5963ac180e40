"""Declarative three-valued rules and answers as Column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandmill.functions.numbers import decimal_places
from strandmill.operators.dataset import running_sum

#: Sources whose values count as explicitly given.
EXPLICIT = ("patient", "encoder_correct", "encoder_incorrect")
KINDS = ("is_true", "is_false", "any", "all")
MAX_DEPTH = 3


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def check_clause(clause: dict, booleans: set[str], depth: int = 1) -> None:
    """Exactly one known kind, non-empty groups, known Boolean keys, bounded depth."""
    if not isinstance(clause, dict) or len(clause) != 1 or next(iter(clause)) not in KINDS:
        raise RuleError(f"a clause needs exactly one of {', '.join(KINDS)}: {clause!r}")
    kind, body = next(iter(clause.items()))
    if kind in ("is_true", "is_false"):
        if body not in booleans:
            raise RuleError(f"unknown or non-Boolean key {body!r}")
        return
    if depth >= MAX_DEPTH:
        raise RuleError(f"clauses nest deeper than {MAX_DEPTH}")
    if not isinstance(body, list) or not body:
        raise RuleError(f"{kind} needs a non-empty list")
    for inner in body:
        check_clause(inner, booleans, depth + 1)


def compile_clause(clause: dict, answer) -> Column:
    """Column of a clause; ``answer`` maps a key to its column. Null never satisfies a leaf; empty all holds, empty any does not, unknown kinds do not."""
    kind, body = next(iter(clause.items()), (None, None))
    if kind == "is_true":
        return answer(body).eqNullSafe(F.lit(True))
    if kind == "is_false":
        return answer(body).eqNullSafe(F.lit(False))
    if kind == "any":
        return reduce(lambda a, b: a | b, [compile_clause(c, answer) for c in body], F.lit(False))
    if kind == "all":
        return reduce(lambda a, b: a & b, [compile_clause(c, answer) for c in body], F.lit(True))
    return F.lit(False)


def fired_rules(rules: dict[str, dict], answer) -> Column:
    """Array of (rule_id, message) of the rules with a true clause, in the ruleset's order."""
    entries = [F.when(compile_clause({"any": r["any"]}, answer), F.struct(F.lit(i).alias("rule_id"), F.lit(r["message"]).alias("message"))) for i, r in rules.items()]
    return F.array_compact(F.array(*entries))


def explicit_value(source: Column, value: Column) -> Column:
    return F.when(source.isin(*EXPLICIT), value)


def keyword_signal(text: Column, keyword: str) -> Column:
    """False where the text contains ``no``, else true where it contains the keyword, else null."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("no")), False).when(F.contains(low, F.lit(keyword)), True)


def apply_encoder(rows: DataFrame, inferred: str) -> DataFrame:
    """Fill value, encoder_value and source where the answer is open and something was inferred."""
    fill = (F.col("source") == "unanswered") & F.col(inferred).isNotNull()
    take = lambda new, old: F.when(fill, new).otherwise(F.col(old)).alias(old)
    rest = [c for c in rows.columns if c not in ("value", "encoder_value", "source")]
    return rows.select(*rest, take(F.col(inferred), "value"), take(F.col(inferred), "encoder_value"), take(F.lit("encoder"), "source"))


def apply_answer(rows: DataFrame, given: str) -> DataFrame:
    """A patient's answer over the old state: the count rises only where an encoder value exists and the old value changes."""
    changed = F.col("encoder_value").isNotNull() & ~F.col("value").eqNullSafe(F.col(given))
    source = F.when(F.col("encoder_value").isNull(), "patient").when(F.col("encoder_value").eqNullSafe(F.col(given)), "encoder_correct").otherwise("encoder_incorrect")
    rest = [c for c in rows.columns if c not in ("value", "source", "change_count", given)]
    return rows.select(*rest, F.col(given).alias("value"), source.alias("source"), (F.col("change_count") + changed.cast("int")).alias("change_count"))


def promote(source: Column) -> Column:
    return F.when(source == "encoder", "encoder_correct").otherwise(source)


def flips(history: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running count of value changes per key (the first row counts none)."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return history.withColumn("change_count", F.sum(moved.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def missing_answer(kind: str, value: Column, places: int = 0) -> Column:
    """Code of the first failure of a required answer, else null."""
    if kind == "Boolean":
        return F.when(value.isNull(), "missing")
    if kind == "text":
        return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "blank")
    return number_failure(value, places)


def number_failure(text: Column, places: int) -> Column:
    """The ladder for numbers given as text: missing, not a number, not finite, too many decimals."""
    number = text.try_cast("double")
    infinite = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(text.isNull(), "missing").when(F.lower(text).isin("true", "false") | number.isNull(), "not_a_number").when(infinite, "not_finite").when(decimal_places(text) > places, "precision")


def failures(*checks: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in checks]))


def is_email(text: Column) -> Column:
    return text.rlike(r"^[^@]+@[^@]+$")


@F.pandas_udf(StringType())
def _last_routable(entries: pd.Series) -> pd.Series:
    def routable(entry: str | None) -> bool:
        try:
            return ipaddress.ip_address(entry or "").is_global
        except ValueError:
            return False

    trimmed = ([e.strip() for e in row if e] if row is not None else [] for row in entries)
    return pd.Series([next((e for e in reversed(row) if routable(e)), None) for row in trimmed], dtype=object)


def client_address(forwarded: Column, real_ip: Column, host: Column) -> Column:
    """The right-most entry of a comma list that is routable everywhere, else ``real_ip`` if that is, else the host; null for an empty one."""
    return F.coalesce(_last_routable(F.split(forwarded, ",")), _last_routable(F.array(real_ip)), F.nullif(host, F.lit("")))


def is_open(row: dict[str, Column]) -> Column:
    """Ordered decision over active, live override, exception of the day (malformed ones fall through) and weekly hours; open <= t < close.

    ``row`` has active, override_open (null: none), override_until, now, exception_type, exception_open,
    exception_close, weekday, open_days, minute, open_minute and close_minute.
    """
    within = lambda t, a, b: (t >= a) & (t < b)
    live = row["override_open"].isNotNull() & (row["now"] < row["override_until"])
    custom = (row["exception_type"] == "custom") & (row["exception_open"] < row["exception_close"])
    weekly = F.array_contains(row["open_days"], row["weekday"]) & within(row["minute"], row["open_minute"], row["close_minute"])
    return (
        F.when(~row["active"], True)
        .when(live, row["override_open"])
        .when(row["exception_type"] == "closed", False)
        .when(custom, within(row["minute"], row["exception_open"], row["exception_close"]))
        .otherwise(weekly)
    )


def first_spelling(values: Column) -> Column:
    """Trimmed, non-empty array entries without case-insensitive repeats; the first spelling stays."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(trimmed, lambda x, i: ~F.exists(F.slice(trimmed, 1, i), lambda y: F.lower(y) == F.lower(x)))


# Names of days, and the longest messages and notes.
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
LONGEST_MESSAGE, LONGEST_NOTE = 500, 500


def _long(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) > most


def opening_errors(days: Column, opens: Column, closes: Column, message: Column) -> Column:
    """What is wrong with weekly hours (minutes of the day): unknown days, hours that do not end after they begin, a message too long."""
    return failures((F.size(F.array_except(days, F.array(*map(F.lit, DAYS)))) > 0, "unknown_day"), (opens >= closes, "hours"), (_long(message, LONGEST_MESSAGE), "message_length"))


def override_errors(status: Column, expires: Column, now: Column, message: Column) -> Column:
    """What is wrong with an override, which is open or closed and expires within the coming 24 hours."""
    return failures(
        (~F.coalesce(status.isin("open", "closed"), F.lit(False)), "status"),
        (expires.isNull(), "no_expiry"),
        (expires <= now, "expiry_past"),
        (expires > now + F.expr("INTERVAL 24 HOURS"), "expiry_far"),
        (_long(message, LONGEST_MESSAGE), "message_length"),
    )


def exception_errors(kind: Column, opens: Column, closes: Column, note: Column) -> Column:
    """What is wrong with an exception: closed days have no hours, those with hours of their own have both, in order."""
    own = kind == "custom_hours"
    return failures(
        (~F.coalesce(kind.isin("closed", "custom_hours"), F.lit(False)), "kind"),
        (own & (opens.isNull() | closes.isNull()), "hours_missing"),
        (own & (opens >= closes), "hours"),
        ((kind == "closed") & (opens.isNotNull() | closes.isNotNull()), "hours_given"),
        (_long(note, LONGEST_NOTE), "note_length"),
    )


def code_outcomes(events: DataFrame, known: Column, issues: Column, matches: Column, most: int, lifetime: str = "INTERVAL 5 DAYS") -> DataFrame:
    """(event_id, reason) of every try of one-time codes, by the first gate that stops it.

    ``events`` has (event_id, user_id, ts); of each, ``issues`` tells that it issues a code and is no
    try, ``matches`` that a try gives the right code, and ``known`` that the user exists. The gates: no such
    user, no code (none issued, or used up), too many wrong tries, expired, mismatch. Running counts per
    user and code stand for the state, in ranges that many tasks share.
    """
    events = events.select("event_id", "user_id", "ts", known.alias("known"), issues.alias("issues"), matches.alias("matches"))
    order = [F.col("ts"), F.col("event_id")]
    counted = lambda df, group, hit, name: running_sum(df, group, order, hit.cast("long"), name)
    rows = counted(events, "user_id", F.col("issues"), "code").withColumn("key", F.concat_ws("/", "user_id", "code"))
    issued = rows.groupBy("key").agg(F.min("ts").alias("issued"))
    match, tried = F.col("matches"), ~F.col("issues")
    rows = rows.join(issued, "key").withColumn("expired", (F.col("code") > 0) & (F.col("ts") > F.col("issued") + F.expr(lifetime)))
    wrong = tried & ~match & ~F.col("expired")
    rows = counted(rows, "key", wrong, "_wrong").withColumn("failed", F.col("_wrong") - wrong.cast("long"))
    right = match & ~F.col("expired") & (F.col("failed") < most)
    rows = counted(rows, "key", right, "_right").withColumn("used", F.col("_right") - right.cast("long"))
    reason = F.when(~F.col("known"), "no_user").when((F.col("code") == 0) | (F.col("used") > 0), "no_code").when(F.col("failed") >= most, "attempts").when(F.col("expired"), "expired").when(~match, "mismatch")
    return rows.where(tried).select("event_id", reason.otherwise("success").alias("reason"))


# Formats and choices of a person's details, and the longest names.
POSTCODE, TEN_DIGITS = r"^(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$", r"^\d{10}$"
PERSONS, GENDERS = ("me", "someone_else"), ("male", "female", "other", "prefer_not_to_say")
LONGEST_FIELD = 255
#: Keys of a person's details; no others are allowed, and none may be missing.
PERSON_KEYS = ("patient_for", "first_name", "last_name", "date_of_birth", "postcode", "gender", "preferred_name", "nhs_number", "submitter_name", "submitter_relationship")


def person_errors(details: Column, today: Column) -> Column:
    """Codes of what is wrong with a map of details; ``date_of_birth`` is ``year-month-day`` in digits.

    The keys are closed. Names, postcode, birth and gender are required, another's details require
    the submitter's, and the number is optional but has ten digits.
    """
    at = lambda k: F.element_at(details, k)
    blank = lambda k: F.coalesce(F.trim(at(k)), F.lit("")) == ""
    long = lambda k: F.coalesce(F.length(at(k)), F.lit(0)) > LONGEST_FIELD
    one_of = lambda k, names: ~F.coalesce(at(k).isin(*names), F.lit(False))
    keys, known = F.map_keys(details), F.array(*map(F.lit, PERSON_KEYS))
    digits = at("date_of_birth").rlike(r"^\d+-\d+-\d+$")
    born = F.try_to_date(at("date_of_birth"), "y-M-d")
    other = at("patient_for").eqNullSafe(F.lit("someone_else"))
    names = [(blank(k) | long(k), k) for k in ("first_name", "last_name")]
    submitter = [(other & (blank(k) | long(k)), k) for k in ("submitter_name", "submitter_relationship")]
    return failures(
        (F.size(F.array_except(keys, known)) > 0, "unexpected_keys"), (F.size(F.array_except(known, keys)) > 0, "missing_keys"), (one_of("patient_for", PERSONS), "patient_for"), *names,
        (~F.coalesce(digits, F.lit(False)), "birth_digits"), (digits & born.isNull(), "birth_date"), (born > today, "birth_future"), (~F.coalesce(F.trim(at("postcode")).rlike(POSTCODE), F.lit(False)), "postcode"),
        (one_of("gender", GENDERS), "gender"), (long("preferred_name"), "preferred_name"), (at("nhs_number").isNotNull() & ~at("nhs_number").rlike(TEN_DIGITS), "nhs_number"), *submitter,
    )
