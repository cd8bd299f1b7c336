"""The report of a run as one table: a row for each section, lane, language and metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import entities, lanes, timings, transcripts

SECTIONS = {
    "stt": ("clips", "failures", "error_rate", "ttft_s_p50", "finalize_s_p50", "rtf_p50"),
    "snr": ("levels", "failures", "auc", "degradation_s"),
    "tts": ("prompts", "failures", "audio_s", "ttfb_p50", "cost_usd"),
    "delta": ("prompts", "delta_s"),
}


def as_rows(table: DataFrame, section: str) -> DataFrame:
    """section, provider, mode, language (null where a table has none), metric, value."""
    keys = [F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in ("provider", "mode", "language")]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in SECTIONS[section]]))
    return table.select(F.lit(section).alias("section"), *keys, cells.alias("c")).select("section", "provider", "mode", "language", "c.*")


def report(stt: DataFrame, tts: DataFrame, prices: DataFrame) -> DataFrame:
    """Of files read in order, lanes that a later file has replace the earlier ones; then accuracy and latency, noise levels, synthesis and cost, streaming against batch."""
    kept = lanes.supersede(stt)
    tables = {"stt": lanes.stt_summary(kept), "snr": lanes.snr_curve(kept), "tts": lanes.tts_summary(tts, prices), "delta": lanes.mode_delta(tts)}
    return reduce(DataFrame.unionByName, [as_rows(t, s) for s, t in tables.items()])


#: by section the metrics of a report from texts; in brackets stands a class or condition
TEXT_SECTIONS = {
    "accuracy": ("clips", "failures", *transcripts.KINDS, "error_rate"),
    "entities": ("occurrences", "error_rate", "exact_rate"),
    "endpointing": ("hold_pauses", "cut_pauses", "finals_in_pauses", "premature_ends", "latency_p50", "latency_p99", "within_0", "within_1", "rtt_p50"),
    "hallucinations": ("clips", "fabricated_clips", "inserted_words", "phantom_finals", "looped_clips", "fabrication_rate", "loop_rate"),
}


def _cells(table: DataFrame, section: str, of: str | None = None) -> DataFrame:
    name = (lambda m: F.concat(F.lit(f"{m}["), F.col(of), F.lit("]"))) if of else F.lit
    cells = F.array(*[F.struct(name(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in TEXT_SECTIONS[section]])
    return table.select(F.lit(section).alias("section"), "provider", "mode", "language", F.explode(cells).alias("c")).select("section", "provider", "mode", "language", "c.*")


def text_report(rows: DataFrame, budgets: tuple[float, float] = (0.3, 0.6), fallback: str = "en-US") -> DataFrame:
    """From clips to all that is told about lanes: edits by kind, entities by class, endpointing, fabrications by condition, as section, provider, mode, language, metric, value.

    rows: provider, mode, language, clip_id, reference, annotated, text, error, audio_s, events, pauses, speech_end_s, eou_source, ws_rtt_s. Rows that failed count as failures only. A null or empty
    language is the fallback's. Metrics without a value are in the result with null."""
    own = rows.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(fallback)))
    kinds = transcripts.with_edit_kinds(own.where("error is null")).groupBy("provider", "mode", "language").agg(*[F.sum(k).alias(k) for k in transcripts.KINDS])
    counted = own.groupBy("provider", "mode", "language").agg(F.count("*").alias("clips"), F.count("error").alias("failures")).join(kinds, ["provider", "mode", "language"], "left")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    accuracy = counted.withColumn("error_rate", errors / F.nullif(F.col("reference_length"), F.lit(0)))
    classes = entities.by_class(entities.with_scores(own))
    parts = [_cells(accuracy, "accuracy"), _cells(classes, "entities", "class"), _cells(timings.endpointing(own, budgets), "endpointing"), _cells(transcripts.hallucinations(own), "hallucinations", "condition")]
    return reduce(DataFrame.unionByName, parts)
