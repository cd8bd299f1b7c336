"""Queries over sessions as arrays: a user's events of a day are one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timings as T
from .queries import EVENTS, events, query, rounded

#: a session of the queries: times are seconds, speech ends at noon, audio six hours later
SESSIONS = f"""{EVENTS}, d as (select *, cast(floor(t_s / 86400) as bigint) as day, case when event_type = 'click' then '' else cast(cast(floor(value) as int) as varchar) end as text,
    event_type = 'purchase' as is_final, case when event_type = 'signup' then 'eou' else 'text' end as kind from e),
  s as (select user_id, day, concat('stt', cast(user_id % 6 as varchar)) as provider, case when user_id % 4 = 0 then 'ja-JP' else 'en-US' end as language, user_id % 3 <> 0 as realtime, day * 86400.0 + 64800 as audio_end_s, day * 86400.0 + 43200 as speech_end_s,
    case when user_id % 11 = 0 then 'server error' end as error, case when user_id % 6 < 4 then 'native' end as eou_source, user_id % 7 / 100.0 as ws_rtt_s,
    coalesce(list({{'t_s': t_s, 'text': text, 'is_final': is_final, 'kind': kind}} order by event_id) filter (where event_type <> 'error'), []) as events,
    coalesce(list(case when event_id % 5 = 0 then [t_s] else [t_s, t_s + value * 60] end order by t_s, event_id) filter (where event_type = 'error'), []) as pauses,
    coalesce(list(text order by event_id) filter (where is_final or event_type = 'click'), []) as words, list({{'t_s': t_s, 'size': cast(floor(value * 1000) as bigint)}} order by t_s, event_id) as chunks from d group by user_id, day)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered by user and day, so that no session grows with the table."""
    d = events(spark, sf_dir).withColumn("day", F.floor(F.col("t_s") / 86400).cast("long")).withColumn("text", F.when(F.col("event_type") == "click", "").otherwise(F.floor("value").cast("int").cast("string")))
    event = F.struct("event_id", "t_s", "text", (F.col("event_type") == "purchase").alias("is_final"), F.when(F.col("event_type") == "signup", "eou").otherwise("text").alias("kind"))
    span = F.when(F.col("event_id") % 5 == 0, F.array("t_s")).otherwise(F.array("t_s", F.col("t_s") + F.col("value") * 60))

    def gathered(what, condition=None):
        return F.array_sort(F.collect_list(what if condition is None else F.when(condition, what)))

    s = d.groupBy("user_id", "day").agg(
        gathered(event, F.col("event_type") != "error").alias("events"), F.transform(gathered(F.struct("t_s", "event_id", span.alias("s")), F.col("event_type") == "error"), lambda x: x.s).alias("pauses"),
        F.transform(gathered(F.struct("event_id", "text"), F.col("event_type").isin("purchase", "click")), lambda x: x.text).alias("words"), gathered(F.struct("t_s", "event_id", F.floor(F.col("value") * 1000).cast("long").alias("size"))).alias("chunks"),
    )
    user = F.col("user_id")
    return s.select(
        "*", F.concat(F.lit("stt"), (user % 6).cast("string")).alias("provider"), F.lit("stream").alias("mode"), F.when(user % 4 == 0, "ja-JP").otherwise("en-US").alias("language"), (user % 3 != 0).alias("realtime"),
        (F.col("day") * 86400.0 + 64800).alias("audio_end_s"), (F.col("day") * 86400.0 + 43200).alias("speech_end_s"), F.when(user % 11 == 0, "server error").alias("error"), F.when(user % 6 < 4, "native").alias("eou_source"), (user % 7 / 100.0).alias("ws_rtt_s"),
    )


_FINALS = "list_filter(events, lambda x: x.is_final)"


@query(
    f"""{SESSIONS}, f as (select *, {_FINALS} as finals from s)
  select user_id, day, round(list_filter(events, lambda x: x.text <> '')[1].t_s, 3) as ttft_s, round(case when len(finals) > 0 then greatest(0.0, finals[-1].t_s - audio_end_s) end, 3) as finalize_s,
  round(case when len(finals) > 0 then greatest(0.0, finals[-1].t_s - case when realtime then speech_end_s else audio_end_s end) end, 3) as rebased_s, round(events[-1].t_s, 3) as total_s,
  array_to_string(list_filter(list_transform(finals, lambda x: trim(x.text)), lambda x: x <> ''), ' ') as joined, coalesce(trim(finals[-1].text), '') as last from f"""
)
def session_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First text, finalisation from the end of the audio and from the end of speech, and the transcript of either kind of finals."""
    s = sessions(spark, sf_dir)
    return rounded(s.select(
        "user_id", "day", T.first_text_s("events").alias("ttft_s"), T.finalize_s("events", "audio_end_s").alias("finalize_s"), T.rebased_s("events", "audio_end_s", "speech_end_s", "realtime").alias("rebased_s"), T.total_s("events").alias("total_s"),
        T.joined_finals("events").alias("joined"), T.last_final("events").alias("last"),
    ), 3)


@query(f"{SESSIONS} select provider, cast(sum(len(events)) as bigint) as events, cast(sum(len(list_filter(events, lambda x: x.text <> '' or x.kind = 'eou'))) as bigint) as logged from s group by provider")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and what of them is kept."""
    return sessions(spark, sf_dir).groupBy("provider").agg(F.sum(F.size("events")).alias("events"), F.sum(F.size(T.logged("events"))).alias("logged"))


@query(
    f"""{SESSIONS}, x as (select *, list_filter(pauses, lambda p: len(p) = 2) as held, list_transform(list_filter(events, lambda x: x.kind = 'eou'), lambda x: x.t_s) as ends, list_transform(list_filter(events, lambda x: x.is_final), lambda x: x.t_s) as said from s),
  r as (select *, case when error is null then list_filter(ends, lambda t: t >= speech_end_s)[1] - speech_end_s end as latency from x)
  select provider, 'stream' as mode, language, max(eou_source) as eou_source, count(*) as clips, count(error) as failures, cast(coalesce(sum(len(held)) filter (where error is null), 0) as bigint) as hold_pauses,
  cast(coalesce(sum(len(list_filter(held, lambda p: len(list_filter(ends, lambda t: p[1] <= t and t < p[2])) > 0))) filter (where error is null), 0) as bigint) as cut_pauses,
  cast(coalesce(sum(len(list_filter(held, lambda p: len(list_filter(said, lambda t: p[1] <= t and t < p[2])) > 0))) filter (where error is null), 0) as bigint) as finals_in_pauses,
  cast(coalesce(sum(len(list_filter(ends, lambda t: t < speech_end_s))) filter (where error is null), 0) as bigint) as premature_ends, round(quantile_cont(latency, 0.5), 4) as latency_p50, round(quantile_cont(latency, 0.9), 4) as latency_p90, round(quantile_cont(latency, 0.99), 4) as latency_p99,
  round(avg(case when latency <= 7200 then 1.0 when latency is not null then 0.0 end), 4) as within_0, round(avg(case when latency <= 14400 then 1.0 when latency is not null then 0.0 end), 4) as within_1,
  round(quantile_cont(ws_rtt_s, 0.5) filter (where error is null), 4) as rtt_p50, round(cut_pauses / nullif(hold_pauses, 0), 4) as cut_share from r group by provider, language"""
)
def endpointing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut pauses, premature ends and endpoint latency by lane; budgets of hours, as a session here lasts a day."""
    return rounded(T.endpointing(sessions(spark, sf_dir), (7200.0, 14400.0)), 4)


@query(
    f"""{SESSIONS}, x as (select *, list_sort(list_filter(pauses, lambda p: len(p) = 2)) as o from s) select user_id, day, greatest(len(o) - 1, 0) as pauses, round(o[-1][1], 3) as speech_end_s,
  round(list_sum(list_transform(o[:-2], lambda p: p[2] - p[1])), 3) as paused_s, nullif(array_to_string(list_filter(list_transform(words, lambda w: trim(w)), lambda w: w <> ''), ' '), '') as reference from x"""
)
def labelled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence labels as pauses and an end of speech, word lists as a reference."""
    pauses, end = T.labelled_silences(T.pairs_only("pauses"))
    s = sessions(spark, sf_dir).select("user_id", "day", pauses.alias("p"), end.alias("speech_end_s"), T.words_text("words").alias("reference"))
    paused = F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda a, p: a + p[1] - p[0]))
    return rounded(s.select("user_id", "day", F.size("p").cast("long").alias("pauses"), "speech_end_s", paused.alias("paused_s"), "reference"), 3)


@query(
    f"""{SESSIONS}, x as (select *, cast(floor(list_sum(list_transform(chunks, lambda c: c.size)) * 0.4) as bigint) as onset from s),
  y as (select *, list_transform(chunks, lambda c, i: {{'t_s': c.t_s, 'b': coalesce(list_sum(list_transform(chunks[:i - 1], lambda z: z.size)), 0)}}) as begins from x)
  select user_id, day, len(chunks) as chunks, round(list_max(list_transform(list_filter(begins, lambda b: b.b <= onset), lambda b: b.t_s + (onset - b.b) / 32000.0)), 3) as audible_s from y"""
)
def audible_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When speech that sets in after two fifths of a stream's bytes can be heard."""
    whole = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c.size)
    s = sessions(spark, sf_dir).withColumn("onset", F.floor(whole * 0.4).cast("long"))
    heard = s.withColumn("audible_s", T.audible_s("chunks", "onset", 32000.0))
    return rounded(heard.select("user_id", "day", F.size("chunks").cast("long").alias("chunks"), "audible_s"), 3)
