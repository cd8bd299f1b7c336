"""Exact percentiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, groups: list[str], column: str, wanted: dict[str, float], buckets: int = 64) -> DataFrame:
    """groups and, for each name in wanted, that percentile with linear interpolation; groups without a value are left out, null groups too.

    No task holds a group: values are counted first, dealt into ranges of about equal counts by a sketch's edges, and only the ranges that the
    ranks fall into are sorted, each by itself.
    """
    keys = [F.col(g) for g in groups]
    counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    edges = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000).alias("edges"))
    placed = counted.join(edges, groups).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    sums = sums.withColumn("before", F.sum("m").over(Window.partitionBy(*groups).orderBy("bucket")) - F.col("m"))  # at most `buckets` rows for each group
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), f((F.col("total") - 1) * q).cast("long").alias("rank")) for name, q in wanted.items() for f in (F.floor, F.ceil)])
    sought = sums.select(*groups, "bucket", "before", "m", "total", F.explode(F.array_distinct(ranks)).alias("r")).where("r.rank >= before and r.rank < before + m")
    within = placed.drop("total").join(sought.select(*groups, "bucket", "before").distinct(), [*groups, "bucket"])
    upto = within.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*groups, "bucket").orderBy("v")))
    hits = upto.join(sought.select(*groups, "bucket", "total", "r"), [*groups, "bucket"]).where("r.rank < upto and r.rank >= upto - n")
    values = hits.groupBy(*keys).agg(*[
        F.min(F.when(F.col("r.name") == name, F.col("v"))).alias(f"low_{name}") for name in wanted
    ], *[F.max(F.when(F.col("r.name") == name, F.col("v"))).alias(f"high_{name}") for name in wanted], F.first("total").alias("total"))
    share = {name: (F.col("total") - 1) * q - F.floor((F.col("total") - 1) * q) for name, q in wanted.items()}
    return values.select(*groups, *[(F.col(f"low_{n}") + share[n] * (F.col(f"high_{n}") - F.col(f"low_{n}"))).alias(n) for n in wanted])
