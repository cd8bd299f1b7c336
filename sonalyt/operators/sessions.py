"""Event-time operators within a session: partial transcripts, pauses, endpoints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(partials: Column) -> Column:
    """Share of consecutive non-final, non-empty partials whose text doesn't begin with the one before; null below two of them."""
    said = F.transform(F.filter(partials, lambda p: ~p.is_final & (p.text != "")), lambda p: p.text)
    pairs = F.zip_with(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), lambda a, b: ~b.startswith(a))
    return F.when(F.size(said) >= 2, F.size(F.filter(pairs, lambda x: x)) / (F.size(said) - 1))


def session_churn(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """churn() over event rows (text, is_final) instead of arrays: nothing is gathered, so a session of any length fits."""
    said = events.where("not is_final and text != ''")
    before = F.lag("text").over(Window.partitionBy(session).orderBy(*order))
    pairs = said.withColumn("__before", before).where("__before is not null")
    return pairs.groupBy(session).agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("text").startswith(F.col("__before")), 1)).alias("revised")).withColumn("churn", F.col("revised") / F.col("pairs"))


def interim_rate(partials: Column, audio_s: Column) -> Column:
    interim = F.size(F.filter(partials, lambda p: p.kind == "interim"))
    return F.when((audio_s > 0) & (F.size(partials) > 0), interim / audio_s)


def phantom_finals(partials: Column, reference: Column) -> Column:
    """Finals with text where nothing was said."""
    return F.when(F.trim(F.coalesce(reference, F.lit(""))) == "", F.size(F.filter(partials, lambda p: p.is_final & (F.trim(p.text) != "")))).otherwise(0)


def pauses_hit(pauses: DataFrame, points: DataFrame, session: str) -> DataFrame:
    """Pauses (session, pause_id, start_s, end_s) with how many points (session, t_s) lie in them, start included, end not.

    Points and pauses are cut into seconds' buckets, so the join is by equality, whatever a session's length.
    """
    width = 60.0
    cut = pauses.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.col("end_s") / width))))
    at = points.select(F.col(session), F.col("t_s"), F.floor(F.col("t_s") / width).alias("__b"))
    hit = cut.join(at, [session, "__b"]).where("t_s >= start_s and t_s < end_s").groupBy(session, "pause_id").agg(F.count("*").alias("hits"), F.min("t_s").alias("first_s"))
    return pauses.join(hit, [session, "pause_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def first_after(starts: DataFrame, points: DataFrame, session: str) -> DataFrame:
    """For each start (session, start_id, start_s) the first point (session, t_s) at or after it: one ordered pass per session instead of a range join."""
    rows = starts.select(session, "start_id", F.col("start_s").alias("t"), F.lit(0).alias("k")).unionByName(points.select(session, F.lit(None).cast("long").alias("start_id"), F.col("t_s").alias("t"), F.lit(1).alias("k")))
    after = Window.partitionBy(session).orderBy("t", "k").rowsBetween(0, Window.unboundedFollowing)
    nearest = F.first(F.when(F.col("k") == 1, F.col("t")), ignorenulls=True).over(after)
    return rows.withColumn("first_s", nearest).where("k = 0").select(session, "start_id", F.col("t").alias("start_s"), "first_s", (F.col("first_s") - F.col("t")).alias("latency_s"))


def within(latency: str | Column, budget: float) -> Column:
    """Share of latencies within a budget, null over none."""
    value = F.col(latency) if isinstance(latency, str) else latency
    return F.avg(F.when(value.isNotNull(), (value <= budget).cast("double")))


def islands(rows: DataFrame, session: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a session merged."""
    w = Window.partitionBy(session).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__reach", reach).withColumn("__n", number).groupBy(session, "__n").agg(F.min(start).alias("start_s"), F.max(end).alias("end_s")).drop("__n")


def complement(intervals: DataFrame, bounds: DataFrame, session: str, least: float = 0.0) -> DataFrame:
    """What of each session's bounds (session, from_s, to_s) merged intervals (start_s, end_s) leave, if longer than least: silences to speech."""
    inside = intervals.join(bounds, session).select(session, F.greatest("start_s", "from_s").alias("__s"), F.least("end_s", "to_s").alias("__e")).where("__s < __e")
    edges = inside.unionByName(bounds.select(session, F.col("to_s").alias("__s"), F.col("to_s").alias("__e")))
    w = Window.partitionBy(session).orderBy("__s", "__e")
    gaps = edges.join(bounds, session).withColumn("start_s", F.coalesce(F.lag("__e").over(w), F.col("from_s")))
    return gaps.select(session, "start_s", F.col("__s").alias("end_s")).where(F.col("end_s") - F.col("start_s") > least)


def runs(rows: DataFrame, session: str, order: list[str], flag: str) -> DataFrame:
    """Maximal runs of rows whose flag is true, with their lengths, by the difference of two counts."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    m = F.row_number().over(Window.partitionBy(session, flag).orderBy(*order))
    return rows.withColumn("__n", n).withColumn("__m", m).where(F.col(flag)).groupBy(session, (F.col("__n") - F.col("__m")).alias("__run")).agg(F.count("*").alias("length"), F.min("__n").alias("first")).drop("__run")


def merge_short(segments: DataFrame, session: str, short: float = 2.0, longest: float = 30.0) -> DataFrame:
    """Segments (session, start_s, end_s) below `short` go to the one after them where both span at most `longest`, else to the one before, else out.

    The rule looks at what the last step left, so a session's segments, a few numbers each, pass in order through one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["start_s"], pdf["end_s"], strict=True))
        out: list[tuple[float, float]] = []
        held = None
        for a, b in rows:
            if held is not None:
                if b - held[0] <= longest:
                    a = held[0]
                elif out and held[1] - out[-1][0] <= longest:
                    out[-1] = (out[-1][0], held[1])
                held = None
            if b - a < short:
                held = (a, b)
            else:
                out.append((a, b))
        if held is not None and out and held[1] - out[-1][0] <= longest:
            out[-1] = (out[-1][0], held[1])
        return pd.DataFrame({session: pdf[session].iloc[0], "start_s": [a for a, _ in out], "end_s": [b for _, b in out]})

    return segments.select(session, "start_s", "end_s").groupBy(session).applyInPandas(fold, segments.select(session, F.col("start_s").cast("double"), F.col("end_s").cast("double")).schema)


def split_long(segments: DataFrame, longest: float = 30.0, tail: float = 2.0) -> DataFrame:
    """Segments in pieces of at most `longest`; a last piece below `tail` is dropped, unless it is the only one."""
    n = F.greatest(F.ceil((F.col("end_s") - F.col("start_s")) / longest), F.lit(1)).cast("int")
    cut = segments.withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1)))
    start, end = F.col("start_s") + F.col("__k") * longest, F.least(F.col("end_s"), F.col("start_s") + (F.col("__k") + 1) * longest)
    return cut.withColumn("__s", start).withColumn("__e", end).where((F.col("__k") == 0) | (F.col("__e") - F.col("__s") >= tail)).select(*[c for c in segments.columns if c not in ("start_s", "end_s")], F.col("__s").alias("start_s"), F.col("__e").alias("end_s"))
