"""Tables that compare lanes, a lane being a provider in a mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags

LANE = ("provider", "mode")


def exact(column: str | Column, q: float) -> Column:
    """Percentile with linear interpolation, null over nothing."""
    return F.percentile(column, q)


def rate(edits: Column, length: Column) -> Column:
    """Sum of edits over sum of reference lengths: never a mean of ratios; null where there is no reference."""
    return F.sum(edits) / F.nullif(F.sum(length), F.lit(0))


def usable(rows: DataFrame) -> Column:
    return F.col("error").isNull()


def scored(rows: DataFrame) -> Column:
    """Rows that count for accuracy: no error, and the reference was checked."""
    return F.col("error").isNull() & F.coalesce(F.col("gold_status") != "unverified", F.lit(True))


def stt_summary(rows: DataFrame, fallback: str = "en-US") -> DataFrame:
    """One row for each lane and language, in report order."""
    ok, counts = usable(rows), scored(rows)
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit(fallback))
    out = rows.withColumn("language", language).groupBy(*LANE, "language").agg(
        F.count("*").alias("clips"),
        F.count(F.when(~ok, 1)).alias("failures"),
        rate(F.when(counts, F.col("edits")), F.when(counts, F.col("reference_length"))).alias("error_rate"),
        *[exact(F.when(ok, F.col(c)), q).alias(f"{c}_p{int(q * 100)}") for c in ("ttft_s", "finalize_s") for q in (0.5, 0.95)],
        exact(F.when(ok & (F.col("audio_s") > 0), F.col("total_s") / F.col("audio_s")), 0.5).alias("rtf_p50"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    return out.orderBy("language", F.asc_nulls_last("error_rate"), F.asc_nulls_last("finalize_s_p50"), *LANE)


def supersede(rows: DataFrame, ordinal: str = "file_ordinal") -> DataFrame:
    """Of files given in order, the last with a lane replaces all of the lane's earlier rows, in every language."""
    last = rows.groupBy(*LANE).agg(F.max(ordinal).alias(ordinal))  # a row for each lane, joined by broadcast or not as its size allows
    return rows.join(last, [*LANE, ordinal], "left_semi")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by arrival."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    place = "place"
    while place in rows.columns:
        place += "_"
    return rows.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def with_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join to the dated price list; a provider without a family is its own. Spark broadcasts the list if its size allows."""
    both = rows.join(prices, "provider", "left")
    return both.withColumn("family", F.coalesce("family", "provider"))


def tts_summary(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each provider, mode and load; cold rows count in prompts, characters and cost, not in percentiles."""
    ok, warm = F.col("error").isNull(), F.col("error").isNull() & ~F.col("cold")
    mode = F.when(F.col("load_n") > 1, F.concat("mode", F.lit(" x"), F.col("load_n").cast("string"))).otherwise(F.col("mode"))
    out = rows.withColumn("mode", mode).groupBy(*LANE).agg(
        F.count("*").alias("prompts"), F.count(F.when(~ok, 1)).alias("failures"), F.sum(F.when(ok, F.col("chars"))).alias("chars"), F.sum(F.when(ok, F.col("audio_s"))).alias("audio_s"),
        exact(F.when(warm, F.col("ttfb_s")), 0.5).alias("ttfb_p50"), exact(F.when(warm, F.col("ttfb_s")), 0.95).alias("ttfb_p95"), exact(F.when(warm, F.col("ttfa_s")), 0.5).alias("ttfa_p50"),
    )
    cost = F.coalesce(F.col("chars") * F.col("usd_per_million_chars") / 1e6, F.col("audio_s") * F.col("usd_per_hour") / 3600)
    return with_prices(out, prices).withColumn("cost_usd", cost).drop("usd_per_hour", "usd_per_million_chars").orderBy(F.asc_nulls_last("ttfb_p50"), *LANE)


def mode_delta(rows: DataFrame) -> DataFrame:
    """Streaming against batch by provider, over the prompts that both modes have."""
    one = rows.where("load_n = 1 and not cold and error is null")
    both = one.groupBy("provider", "prompt_id").agg(F.count_distinct("mode").alias("modes")).where("modes = 2")
    shared = one.join(both, ["provider", "prompt_id"], "left_semi")
    p50 = {m: exact(F.when(F.col("mode") == m, F.col("ttfb_s")), 0.5) for m in ("batch", "stream")}
    out = shared.groupBy("provider").agg(F.count_distinct("prompt_id").alias("prompts"), *[v.alias(f"ttfb_p50_{m}") for m, v in p50.items()])
    return out.withColumn("delta_s", F.col("ttfb_p50_stream") - F.col("ttfb_p50_batch")).orderBy("provider")


def common_clips(rows: DataFrame, most: int) -> DataFrame:
    """Rows of the first `most` clips, by language and id, that every lane of the language has."""
    lanes = rows.groupBy("language").agg(F.count_distinct(*LANE).alias("lanes"))
    held = rows.groupBy("language", "clip_id").agg(F.count_distinct(*LANE).alias("held")).join(lanes, "language").where("held = lanes")
    chosen = held.withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy("clip_id"))).where(F.col("n") <= most)
    return rows.join(chosen, ["language", "clip_id"], "left_semi")


def spend(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of audio by provider with a total; cost is null where any price is unknown, but the total counts what is known."""
    hours = with_prices(rows, prices).withColumn("usd", F.col("audio_s") / 3600 * F.col("usd_per_hour"))
    return hours.rollup("provider").agg(F.count("*").alias("clips"), F.sum("usd").alias("usd")).orderBy(F.asc_nulls_last("provider"))


def snr_curve(rows: DataFrame) -> DataFrame:
    """Error rate and finalisation over noise levels: area under the curve by trapezoids over its span, and the change from the cleanest level to the noisiest."""
    by_level = rows.groupBy("provider", "mode", "snr_level").agg(
        rate(F.when(usable(rows), F.col("edits")), F.when(usable(rows), F.col("reference_length"))).alias("error_rate"), exact(F.when(usable(rows), F.col("finalize_s")), 0.5).alias("finalize_p50"), F.count(F.when(~usable(rows), 1)).alias("failures")
    )
    w = Window.partitionBy(*LANE).orderBy("snr_level")
    area = (F.col("error_rate") + F.lead("error_rate").over(w)) / 2 * (F.lead("snr_level").over(w) - F.col("snr_level"))
    return by_level.withColumn("area", area).groupBy(*LANE).agg(
        F.count("*").alias("levels"), F.sum("failures").alias("failures"), F.when(F.count("*") >= 2, F.sum("area") / F.nullif(F.max("snr_level") - F.min("snr_level"), F.lit(0))).alias("auc"),
        (F.min_by("finalize_p50", "snr_level") - F.max_by("finalize_p50", "snr_level")).alias("degradation_s"),
    ).orderBy(*LANE)


def judgeable(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows that a judge can be asked about: no error, a reference that isn't blank and was checked; the last of each lane's clip by `order`. A null gold_status counts as checked."""
    blank = F.trim(F.coalesce("reference", F.lit(""))) == ""
    return keep_last(rows.where(scored(rows) & ~blank), ["provider", "mode", "clip_id"], order)


def snr_summary(rows: DataFrame, fallback: str = "en-US") -> DataFrame:
    """By lane and language, of clips at a noise level (snr+05-...) and over a telephone line (tel8k-...): levels, failures, area under the error rates, change of finalisation, and the line's error rate.

    rows: provider, mode, language, clip_id, error, substitutions, deletions, insertions, reference_length, finalize_s (counts null without a reference). Failures on the line don't count; other clips aren't
    looked at. A lane with one level has no area."""
    named = rows.withColumns({"language": F.coalesce(F.nullif("language", F.lit("")), F.lit(fallback)), "level": tags.snr_level(F.col("clip_id")), "line": F.startswith(F.col("clip_id"), F.lit("tel8k-"))})
    keys = [*LANE, "language"]
    ok, errors = F.col("error").isNull(), F.col("substitutions") + F.col("deletions") + F.col("insertions")
    told = named.where("level is not null or line")
    by_level = told.where(~F.col("line")).groupBy(*keys, "level").agg(
        rate(F.when(ok, errors), F.when(ok, F.col("reference_length"))).alias("error_rate"), exact(F.when(ok, F.col("finalize_s")), 0.5).alias("finalize_p50"), F.count(F.when(~ok, 1)).alias("failures"), F.count(F.when(ok, F.col("reference_length"))).alias("n")
    )
    w = Window.partitionBy(*keys).orderBy("level")
    known = by_level.where("error_rate is not null").withColumn("area", (F.col("error_rate") + F.lead("error_rate").over(w)) / 2 * (F.lead("level").over(w) - F.col("level")))
    curve = known.groupBy(*keys).agg(F.count("*").alias("levels"), F.when(F.count("*") >= 2, F.sum("area") / (F.max("level") - F.min("level"))).alias("auc"))
    timed = by_level.groupBy(*keys).agg(
        F.sum("failures").alias("failures"),
        (F.min_by("finalize_p50", F.when(F.col("finalize_p50").isNotNull(), F.col("level"))) - F.max_by("finalize_p50", F.when(F.col("finalize_p50").isNotNull(), F.col("level")))).alias("finalize_change_s"),
    )
    line = told.where("line").groupBy(*keys).agg(F.count("*").alias("line_clips"), rate(F.when(ok, errors), F.when(ok, F.col("reference_length"))).alias("line_error_rate"))
    out = told.select(*keys).distinct()
    for part in (timed, curve, line):
        out = out.join(part, keys, "left")
    return out.fillna(0, ["levels", "failures", "line_clips"]).orderBy("language", *LANE)
