"""Checks of rulesets, presentation blocks, name lists and deployments as violation rows, and signed tokens."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.relational import violations

# The block size of SHA-256 in bytes, and the bytes that pad a key for the inner and outer hash.
HASH_BLOCK, INNER_PAD, OUTER_PAD = 64, 0x36, 0x5C
# Bounds of a list of names.
MOST_NAMES, LONGEST_NAME = 100, 100
# Bounds of a list of search tags.
MOST_TAGS, LONGEST_TAG = 20, 60


def shared_toggle_disagrees(questions: DataFrame) -> DataFrame:
    """Rulesets whose quantity questions with several systems differ in their set of systems or their default.

    ``questions`` has (ruleset, answer_key, quantity, allowed_systems array, default_system). Questions
    with one system stand outside the shared toggle.
    """
    shared = questions.where(F.col("quantity") & (F.size("allowed_systems") > 1))
    choice = F.struct(F.array_sort(F.array_distinct("allowed_systems")).alias("systems"), F.col("default_system").alias("default"))
    return shared.groupBy("ruleset").agg(F.min(choice).alias("low"), F.max(choice).alias("high"), F.count("*").alias("questions")).where("not (low <=> high)").select("ruleset", "questions")


def presentation_violations(blocks: DataFrame) -> DataFrame:
    """Checks of (condition, presentation: JSON text): an object with a label that is not blank, a prompt that is text, a list of short tags, and no other keys.

    Types are those of the parsed value, so what lies deeper inside, or text that looks like a key, has no say.
    A prompt or tags that are null count as absent; text that is no JSON counts as no presentation.
    """
    parsed = blocks.withColumn("_v", F.try_parse_json("presentation"))
    at = lambda p: F.try_variant_get("_v", f"$.{p}", "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    told = parsed.select(F.col("condition"), kind(F.col("_v")).startswith("OBJECT").alias("object"), F.json_object_keys("presentation").alias("keys"), kind(at("label")).alias("label_kind"), F.try_variant_get("_v", "$.label", "string").alias("label"), kind(at("free_text_prompt")).alias("prompt_kind"), kind(at("search_tags")).alias("tags_kind"), F.from_json(F.to_json(at("search_tags")), "array<string>").alias("tags"))
    extra = F.array_except(F.coalesce("keys", F.array().cast("array<string>")), F.array(F.lit("label"), F.lit("free_text_prompt"), F.lit("search_tags")))
    known, name, tags = told.where("object"), F.col("condition"), F.col("tags")
    listed = known.where(F.col("tags_kind") == "ARRAY<STRING>")
    return violations(
        ("no_presentation", told.where("not object"), name, F.lit("")),
        ("label", known.where((F.col("label_kind") != "STRING") | (F.trim("label") == "")), name, F.lit("")),
        ("prompt_not_text", known.where(~F.col("prompt_kind").isin("STRING", "VOID")), name, F.lit("")),
        ("tags_not_texts", known.where(~F.col("tags_kind").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID") | ((F.col("tags_kind") == "ARRAY<VOID>") & (F.size(tags) > 0))), name, F.lit("")),
        ("too_many_tags", listed.where(F.size(tags) > MOST_TAGS), name, F.lit("")),
        ("tag_blank", listed.where(F.exists(tags, lambda t: F.coalesce(F.trim(t), F.lit("")) == "")), name, F.lit("")),
        ("tag_too_long", listed.where(F.exists(tags, lambda t: F.length(F.trim(t)) > LONGEST_TAG)), name, F.lit("")),
        ("unexpected_keys", known.where(F.size(extra) > 0), name, F.array_join(F.array_sort(extra), ",")),
    )


def name_list_errors(names: Column, most: int = MOST_NAMES, longest: int = LONGEST_NAME) -> Column:
    """Array of what is wrong with an array of names: too many, blank, too long, or equal but for case and surrounding white space."""
    bare = F.transform(names, lambda n: F.lower(F.trim(n)))
    told = F.filter(bare, lambda n: n.isNotNull() & (n != ""))
    return F.array_compact(
        F.array(
            F.when(F.size(names) > most, "too_many"),
            F.when(F.exists(names, lambda n: n.isNull() | (F.trim(n) == "")), "blank"),
            F.when(F.exists(names, lambda n: F.coalesce(F.length(n), F.lit(0)) > longest), "too_long"),
            F.when(F.size(told) > F.size(F.array_distinct(told)), "duplicate"),
        )
    )


def deployment_violations(practices: DataFrame, users: DataFrame, practice: int) -> DataFrame:
    """Checks of a single tenant: the practice exists, is the only one, has an e-mail address and at least one user.

    ``practices`` has (practice_id, email), ``users`` (practice_id). Each check aggregates to one row.
    """
    own = F.col("practice_id") == practice
    held = practices.agg(F.count_if(own).alias("own"), F.count("*").alias("all"), F.count_if(own & (F.trim(F.coalesce("email", F.lit(""))) == "")).alias("blank"))
    staff = users.agg(F.count_if(own).alias("users"))
    key = F.lit(practice)
    return violations(
        ("practice_missing", held.where("own = 0"), key, F.lit("")),
        ("several_practices", held.where("all > 1"), key, F.col("all")),
        ("no_email", held.where("blank > 0"), key, F.lit("")),
        ("no_users", staff.where("users = 0"), key, F.lit("")),
    )


def hmac_sha256(key: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA-256 of a text, in the JVM: the keyed inner hash, hashed again; a key longer than a block is hashed first."""
    inner, outer = hmac_pads(key)
    lit = lambda raw: F.lit(bytearray(raw))
    return F.sha2(F.concat(lit(outer), F.unhex(F.sha2(F.concat(lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """What an HMAC's inner and outer hash begin with."""
    raw = key.encode()
    padded = (hashlib.sha256(raw).digest() if len(raw) > HASH_BLOCK else raw).ljust(HASH_BLOCK, b"\0")
    return bytes(b ^ INNER_PAD for b in padded), bytes(b ^ OUTER_PAD for b in padded)


def webhook_outcomes(signals: DataFrame, key: str, tolerance: int = 900) -> DataFrame:
    """(id, outcome) of signed signals (id, received: seconds, stamp, token, signature: texts), by the first gate that stops each.

    The gates: ``malformed``, the stamp is no whole number; ``stale``, it is more than ``tolerance``
    seconds off; ``bad_signature``, the signature is not that of stamp and token; ``replayed``, an
    earlier signal used the token up. The rest is ``accepted``. A signal's id breaks ties in time.
    """
    stamp = F.trim("stamp").try_cast("long")
    stamp = F.when(F.trim("stamp").rlike(r"^[+-]?\d+$"), stamp)
    signed = hmac_sha256(key, F.concat("stamp", F.coalesce("token", F.lit(""))))
    gate = F.when(stamp.isNull(), "malformed").when(F.abs(F.col("received") - stamp) > tolerance, "stale").when(~F.coalesce(signed == F.col("signature"), F.lit(False)), "bad_signature")
    gated = signals.select("id", "received", F.coalesce("token", F.lit("")).alias("token"), gate.alias("gate"))
    first = gated.where("gate is null").groupBy("token").agg(F.min(F.struct("received", "id")).alias("_first"))
    met = gated.join(first, "token", "left")
    fresh = F.struct("received", "id").eqNullSafe(F.col("_first"))
    return met.select("id", F.coalesce("gate", F.when(fresh, "accepted").otherwise("replayed")).alias("outcome"))


def login_decision(known: Column, cooling: Column, locked: Column, has_password: Column, matches: Column, failures: Column, most: int) -> Column:
    """(reason, failures, lock): the first gate that holds a login up; a wrong password counts, and from ``most`` failures on it locks; success resets the count."""
    reason = F.when(~known, "unknown").when(cooling, "cooldown").when(locked, "locked").when(~has_password, "no_password").when(~matches, "wrong_password").otherwise("success")
    after = F.when(reason == "wrong_password", failures + 1).when(reason == "success", 0).otherwise(failures)
    return F.struct(reason.alias("reason"), after.alias("failures"), ((reason == "wrong_password") & (after >= most)).alias("lock"))
