"""Where modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.operators.checks import hmac_pads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_hash(expr: str) -> str:
    """SQL of ``functions.text.hash_int``."""
    return f"('0x' || substr(sha256({expr}), 1, 8))::BIGINT"


def sql_hmac(key: str, expr: str) -> str:
    """SQL of ``operators.checks.hmac_sha256``."""
    inner, outer = ("'" + "".join(f"\\x{b:02X}" for b in pad) + "'::BLOB" for pad in hmac_pads(key))
    return f"sha256({outer} || unhex(sha256({inner} || encode({expr}))))"
