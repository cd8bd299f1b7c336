"""Queries over sessions with deadlines, as streams held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import deadlines
from .queries import query, rounded, table

GRACE_S = 6 * 3600.0

#: five days of a user are a session; every 17th event arrives two hours late. Times are whole microseconds since the session began, so no sum of theirs is off; seq is the order of arrival.
_DAY, _HOUR = 86_400_000_000, 3_600_000_000
_FIVE = f"cast(floor({{us}} / cast({5 * _DAY} as double)) as bigint)"
_PARTS = f"""user_id * 8 + {_FIVE} as session, {{us}} - {_FIVE} * {5 * _DAY} as t_us, ({{us}} + case when event_id % 17 = 0 then {2 * _HOUR} else 0 end) * 4 + case when event_id % 17 = 0 then 1 else 0 end as seq,
  case event_type when 'signup' then 'audio_end' when 'purchase' then 'eou' when 'error' then 'final' else 'interim' end as kind, substr('abcdefgh', 1, 1 + cast(floor(value) as int) % 8) as text, {_DAY} * (1 + user_id % 3) as clip_us, {_DAY} * (1 + user_id % 3) - {12 * _HOUR} as speech_end_us"""
_DUCK = _PARTS.format(us="(epoch_us(ts) - 1704067200000000)")
_SPARK = _PARTS.format(us="(unix_micros(cast(ts as timestamp)) - 1704067200000000)")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("ts is not null and user_id is not null").selectExpr("cast(ts as timestamp) as ts", *[x for x in _split(_SPARK)])
    return rows.selectExpr("session", "seq", "ts", "kind", "text", "timestamp_micros(unix_micros(ts) - t_us) as began", "clip_us / 1e6 as clip_s", "speech_end_us / 1e6 as speech_end_s")


def _split(columns: str) -> list[str]:
    """A list of expressions, at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_GRACE = int(GRACE_S * 1e6)
_ROUNDED = "(({0} + 500) // 1000) / 1000.0"  # to whole milliseconds, halves up, in integers

SQL = f"""with p as (select {_DUCK}, max(epoch_us(ts) - 1704067200000000) over () - {3 * _HOUR} as mark from events where ts is not null and user_id is not null),
  a as (select session, arg_min(t_us, seq) filter (where kind = 'audio_end' and t_us <= clip_us + {_GRACE}) as audio_end, any_value(clip_us) as clip, any_value(speech_end_us) as speech_end, any_value(mark) as mark from p group by session),
  d as (select *, coalesce(audio_end, clip) + {_GRACE} as deadline from a), e as (select p.*, deadline from p join d using (session) where kind <> 'audio_end' and t_us <= deadline),
  i as (select session, text, lag(text) over (partition by session order by seq, text) as shown from e where kind = 'interim' and text <> ''),
  c as (select session, count(*) as interim, count(*) filter (where not starts_with(text, shown)) as revised from i where shown is not null group by session),
  n as (select session, count(*) as events, count(*) filter (where kind = 'final') as finals, count(*) filter (where kind = 'eou' and t_us < speech_end_us) as early_ends, arg_min(t_us - speech_end_us, seq) filter (where kind = 'eou' and t_us >= speech_end_us) as first_end from e group by session)
  select session, case when audio_end is null then 'clip' else 'audio' end as ended_by, {_ROUNDED.format("deadline")} as ended_s, coalesce(events, 0) as events, coalesce(interim, 0) as interim, coalesce(revised, 0) as revised, coalesce(finals, 0) as finals, coalesce(early_ends, 0) as early_ends, {_ROUNDED.format("first_end")} as first_end_s
  from d left join n using (session) left join c using (session) where (events > 0 or audio_end is not null) and deadline + (session % 8) * {5 * _DAY} + 2000 < mark"""


@query(SQL)
def session_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end with their clip or their audio, as a stream of two micro-batches: how each ended, rewrites of what was shown, ends of utterance around the end of speech."""
    return rounded(deadlines.replayed(frames(spark, sf_dir), GRACE_S)[0], 3)


@query(SQL)
def session_deadlines_in_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with another cut into micro-batches."""
    return rounded(deadlines.replayed(frames(spark, sf_dir), GRACE_S, cuts=5)[0], 3)
