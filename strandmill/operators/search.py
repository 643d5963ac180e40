"""Three-layer search over labels and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shortest query that is matched fuzzily, and the edits allowed up to and beyond five letters.
SHORTEST, SHORT_EDITS, LONG_EDITS = 4, 1, 2


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows (label, tags) whose label or a tag contains the query, or a tag token is close to it; all rows if none does or the query is blank."""
    q = query.lower().strip()
    if not q:
        return rows
    clean = lambda c: F.trim(F.lower(c))
    hit = F.contains(clean(F.col("label")), F.lit(q)) | F.exists("tags", lambda t: F.contains(clean(t), F.lit(q)))
    if len(q) >= SHORTEST:
        edits = SHORT_EDITS if len(q) <= 5 else LONG_EDITS
        tokens = F.flatten(F.transform("tags", lambda t: F.split(clean(t), r"\s+")))
        hit = hit | F.exists(tokens, lambda t: F.levenshtein(t, F.lit(q), edits) >= 0)
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    any_hit = marked.where("_hit").limit(1).select(F.lit(True).alias("_any"))
    # One row at most is broadcast: whether anything matched.
    return marked.join(F.broadcast(any_hit), F.lit(True), "left").where("_hit or _any is null").drop("_hit", "_any")
