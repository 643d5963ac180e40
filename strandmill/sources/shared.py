"""Durable intermediate results in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset, a session on one machine gets a temporary
folder of its own; on a cluster that is an error, as executors could not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Temporary folders of local applications.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="strandmill-"))
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with the writer's ``options``, and read it back.

    This cuts lineage in a way that survives lost executors, and fixes the values of expressions
    that would differ between evaluations.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
