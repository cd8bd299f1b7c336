"""Where jobs keep what they write between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share. Where it is unset a folder is made if all run on this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, kind: str) -> DataFrame:
    """The rows as a table that is worked out once, for what reads them more than once."""
    path = new_path(rows.sparkSession, kind)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_folder(base: str, now: datetime | None = None) -> str:
    """A run's folder under base, named by the time it began."""
    return f"{base.rstrip('/')}/{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}"
