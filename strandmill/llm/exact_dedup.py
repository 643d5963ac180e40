"""Exact deduplication with a heavy-hitter split.

``freqItems`` runs the Misra-Gries family's frequent-item summary over the text digests; it keeps at
most ``1 / support`` digests whatever the input size, and misses none that holds ``support`` of the
rows. The summary only proposes digests: an aggregation with map-side combine then counts each one
exactly and picks its winning row. Those winners (at most ``1 / support`` rows) are broadcast, so
copies of a frequent text are settled where they are read. Only the remaining, infrequent digests
are shuffled, and only as (id, digest) pairs.

Defined results: a null text equals the empty text; a null id is smaller than any other; of fully
repeated rows exactly one is kept; an empty table gives an empty result; columns other than the id
and the text are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.sources.shared import written


def text_digest(text: str | Column, normalise=None) -> Column:
    """Lower-case hex SHA-256 of the normalised text; null counts as empty."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.sha2(normalise(col) if normalise else col, 256)


def frequent_winners(rows: DataFrame, support: float) -> DataFrame:
    """Verified winners of the frequent digests: digest, top (winning row), group_size.

    ``rows`` has digest and top = struct(id, rid). At most ``1 / support`` rows come back.
    """
    proposed = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return rows.join(F.broadcast(proposed), "digest").groupBy("digest").agg(F.max("top").alias("top"), F.count("*").alias("group_size")).where("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, support: float = 0.002) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256; the largest id stays.

    ``normalise`` maps a text column to the column that is compared (default: no change).
    ``support`` is the share of rows from which a digest counts as frequent.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), text_digest(text_col, normalise).alias("digest"), F.monotonically_increasing_id().alias("rid")), "exact-digests")
    rows = rows.withColumn("top", F.struct("id", "rid"))
    winners = written(frequent_winners(rows, support), "exact-winners")
    frequent = rows.join(F.broadcast(winners.withColumnRenamed("top", "won")), "digest")
    per_digest = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"won": F.max("top").over(per_digest), "group_size": F.count("*").over(per_digest)})
    return frequent.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("won.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("rid") == F.col("won.rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, support: float = 0.002) -> DataFrame:
    """``docs`` without copies, columns unchanged: of equal texts one row with the largest id stays.

    Rows of a frequent digest other than its winner are dropped where they are read; what is left
    of that digest (the winner, repeated only if the row itself is) joins the ordinary shuffle.
    """
    names = docs.columns
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_digest(text_col, normalise).alias("digest"), F.col(id_col).alias("id"))
    winners = written(frequent_winners(hashed.select("digest", F.struct("id").alias("top")), support), "exact-winners")
    left = hashed.join(F.broadcast(winners.select("digest", F.col("top.id").alias("won_id"), F.lit(True).alias("hot"))), "digest", "left").where(F.col("hot").isNull() | F.col("id").eqNullSafe(F.col("won_id")))
    order = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    return left.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
