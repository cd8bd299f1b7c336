"""Results of lanes as they come in, kept so that an interrupted run neither loses nor repeats any.

Each micro-batch has a folder of its own for each lane; a batch that is run again replaces its folders and no others. When all of them are written the batch gets a mark, and readers take marked
batches only, so half a batch is never seen. A lane's rows of several batches are all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def keep_batch(path: str, lane: tuple[str, ...] = ("provider", "mode"), before_mark: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. before_mark is called between the rows and the mark."""

    def keep(rows: DataFrame, batch: int) -> None:
        told = rows.withColumn(BATCH, F.lit(batch).cast("long"))
        told.write.mode("overwrite").partitionBy(BATCH, *lane).option("partitionOverwriteMode", "dynamic").json(f"{path}/rows")
        if before_mark:
            before_mark(batch)
        rows.sparkSession.range(1).select(F.lit(batch).cast("long").alias("done")).write.mode("overwrite").parquet(f"{path}/done/{batch}")

    return keep


def sink(stream: DataFrame, path: str, lane: tuple[str, ...] = ("provider", "mode"), before_mark: Callable[[int], None] | None = None):
    """Starts writing what the stream has now; the query's progress is kept beside the rows, so a later start goes on where this one ended."""
    return stream.writeStream.foreachBatch(keep_batch(path, lane, before_mark)).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all marked batches; schema: of the rows, lanes' columns included."""
    rows = spark.read.schema(f"{schema}, {BATCH} long").json(f"{path}/rows")
    done = spark.read.schema("done long").option("recursiveFileLookup", True).parquet(f"{path}/done")
    return rows.join(done, rows[BATCH] == done["done"], "left_semi").drop(BATCH)
