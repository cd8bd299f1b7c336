"""What a session's events say about time: first text, finalisation, endpoints in pauses. Events are an array of a row, so nothing is shuffled.

An event has t_s, text, is_final and kind ("eou" marks an end of utterance). Arrays are in arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lanes import LANE, exact


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def logged(events: str | Column) -> Column:
    """Events that a session keeps: those with text, and ends of utterance."""
    return F.filter(_col(events), lambda e: (e.text != "") | (e.kind == "eou"))


def first_text_s(events: str | Column) -> Column:
    """Time of the first event with text, null without one."""
    return F.get(F.filter(_col(events), lambda e: e.text != ""), 0).t_s


def finals(events: str | Column) -> Column:
    return F.filter(_col(events), lambda e: e.is_final)


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def finalize_s(events: str | Column, end_s: str | Column) -> Column:
    """From end_s to the last final, never negative; null without a final or an end."""
    tail = last(finals(events)).t_s - _col(end_s)
    return F.when(tail.isNotNull(), F.greatest(F.lit(0.0), tail))


def rebased_s(events: str | Column, audio_end_s: str | Column, speech_end_s: str | Column, realtime: str | Column) -> Column:
    """Finalisation from the end of speech where audio was paced in real time and that end is known; else from the end of the audio."""
    known = F.coalesce(_col(realtime) & (_col(speech_end_s) > 0), F.lit(False))
    return F.when(known, finalize_s(events, speech_end_s)).otherwise(finalize_s(events, audio_end_s))


def total_s(events: str | Column) -> Column:
    return last(_col(events)).t_s


def joined_finals(events: str | Column) -> Column:
    """For systems whose finals are segments."""
    return F.array_join(F.filter(F.transform(finals(events), lambda e: F.trim(e.text)), lambda t: t != ""), " ")


def last_final(events: str | Column) -> Column:
    """For systems whose finals restate the whole."""
    return F.coalesce(F.trim(last(finals(events)).text), F.lit(""))


def pairs_only(spans: str | Column) -> Column:
    """Of an array of arrays, those with a start and an end."""
    return F.filter(_col(spans), lambda s: F.size(s) == 2)


def labelled_silences(spans: Column) -> tuple[Column, Column]:
    """(pauses, speech end): the last of the spans in order is the end of speech, the others are pauses; no spans: none, null."""
    ordered = F.array_sort(spans)
    return F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(last(ordered), 0)


def words_text(words: str | Column) -> Column:
    """Words joined by spaces, null if there are none."""
    return F.nullif(F.array_join(F.filter(F.transform(_col(words), lambda w: F.trim(w)), lambda w: w != ""), " "), F.lit(""))


def audible_s(chunks: str | Column, onset_byte: str | Column, bytes_per_s: float) -> Column:
    """When the byte at which speech sets in can be heard: the largest, over chunks (t_s, size) that begin at or before it, of arrival plus what is to be played to it."""
    c = _col(chunks)
    begins = F.transform(c, lambda x, i: F.struct(x.t_s.alias("t_s"), F.aggregate(F.slice(c, 1, i), F.lit(0).cast("long"), lambda a, y: a + y.size).alias("begin")))
    return F.array_max(F.transform(F.filter(begins, lambda x: x.begin <= _col(onset_byte)), lambda x: x.t_s + (_col(onset_byte) - x.begin) / bytes_per_s))


def endpointing(sessions: DataFrame, budgets: tuple[float, float] = (0.3, 0.6)) -> DataFrame:
    """By lane and language: pauses that an end of utterance or a final falls into, premature ends, latency of the first end (in arrival order) at or
    after the end of speech. sessions: provider, mode, language, error, events, pauses, speech_end_s, eou_source, ws_rtt_s. Report order: language, share of cut pauses; lanes without a signal last, by name."""
    ends = F.transform(F.filter("events", lambda e: e.kind == "eou"), lambda e: e.t_s)
    said = F.transform(F.filter("events", lambda e: e.is_final & (e.kind != "eou")), lambda e: e.t_s)

    def held(times: Column) -> Column:
        return F.size(F.filter("pauses", lambda p: F.exists(times, lambda t: (p[0] <= t) & (t < p[1]))))

    ok = F.col("error").isNull()
    spoken = ok & (F.col("speech_end_s") > 0)
    first = F.get(F.filter(ends, lambda t: t >= F.col("speech_end_s")), 0) - F.col("speech_end_s")
    rows = sessions.withColumn("pauses", pairs_only("pauses")).select(
        *LANE, "language", "eou_source", (~ok).cast("long").alias("failed"), F.when(ok, F.size("pauses")).alias("n"), F.when(ok, held(ends)).alias("cut"), F.when(ok, held(said)).alias("finals"),
        F.when(spoken, F.size(F.filter(ends, lambda t: t < F.col("speech_end_s")))).alias("early"), F.when(spoken, first).alias("latency"), F.when(ok, F.col("ws_rtt_s")).alias("rtt"),
    )
    total = rows.groupBy(*LANE, "language").agg(
        F.max("eou_source").alias("eou_source"), F.count("*").alias("clips"), F.sum("failed").alias("failures"), *[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("n", "hold_pauses"), ("cut", "cut_pauses"), ("finals", "finals_in_pauses"), ("early", "premature_ends"))],
        *[exact("latency", q).alias(f"latency_p{int(100 * q)}") for q in (0.5, 0.9, 0.99)], *[F.avg((F.col("latency") <= b).cast("double")).alias(f"within_{i}") for i, b in enumerate(budgets)], exact("rtt", 0.5).alias("rtt_p50"),
    )
    share = F.col("cut_pauses") / F.nullif(F.col("hold_pauses"), F.lit(0))
    return total.withColumn("cut_share", share).orderBy(F.col("eou_source").isNull(), "language", F.coalesce("cut_share", F.lit(0.0)), *LANE)
