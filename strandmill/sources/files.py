"""JSON, JSON Lines, text-library and TSV readers, and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import cluster_key, fragment_id, normalise_text

# Fixed value: how a line names its cluster.
TAG = r"^\[([A-Za-z0-9_]+)\]\s+"


def json_tree(spark: SparkSession, folder: str, id_col: str, schema: str, skip: str = "synthetic") -> DataFrame:
    """All ``*.json`` below a folder but for its ``skip`` subtree; repeated ids are an error."""
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    found = found.withColumn("file", F.col("_metadata.file_path")).where(~F.contains(F.col("file"), F.lit(f"{folder.rstrip('/').rpartition('/')[2]}/{skip}/")))
    repeated = [r[0] for r in found.groupBy(id_col).count().where("count > 1").limit(5).collect()]
    if repeated:
        raise ValueError(f"repeated {id_col}: {repeated}")
    return found


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; anything else is an error when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_library(spark: SparkSession, path: str, library: str) -> DataFrame:
    """(fragment_id, library, text, tag, norm, cluster_id): one row per line that does not normalise to nothing; a leading [tag] names its cluster."""
    lines = spark.read.text(path).select(F.regexp_extract("value", TAG, 1).alias("t"), F.trim(F.regexp_replace("value", TAG, "")).alias("text"))
    rows = lines.withColumn("norm", normalise_text(F.col("text"))).where("norm <> ''")
    tag = F.when(F.col("t") != "", F.concat(F.lit(library + ":"), "t"))
    return rows.select(fragment_id(F.lit(library), F.col("norm")).alias("fragment_id"), F.lit(library).alias("library"), "text", tag.alias("tag"), "norm", cluster_key(tag, F.col("norm")).alias("cluster_id"))


def holdout_tsv(spark: SparkSession, path: str, signals: list[str], id_col: str = "submission_id") -> DataFrame:
    """(id, signal, state) with state true, false, null or omitted (a blank cell); the header must name exactly the signals."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "\x00").option("emptyValue", "").option("quote", "").csv(path)
    if sorted(raw.columns) != sorted([id_col, *signals, "text"]):
        raise ValueError(f"unexpected columns {raw.columns}")
    long = raw.unpivot([id_col], signals, "signal", "cell")
    cell = F.lower(F.trim(F.coalesce("cell", F.lit(""))))
    known = F.when(cell == "", "omitted").when(cell.isin("true", "false", "null"), cell).otherwise(F.raise_error(F.concat(F.lit("unknown cell "), cell)))
    return long.select(id_col, "signal", known.alias("state"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, by Spark's committer; null fields are kept."""
    df.write.option("ignoreNullFields", False).json(path)


def report_rows(df: DataFrame, title: str, most: int = 500) -> str:
    """A small result as Markdown; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
