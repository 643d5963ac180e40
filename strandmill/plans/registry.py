"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

from strandmill.plans import accounts, corpus, decisions, evaluation, holdouts, keyed, recombination, scalars, selection, streams  # noqa: F401  registered on import
from strandmill.plans.book import ORACLE_SQL, QUERIES

FLAGSHIP = evaluation.flagship

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
