"""Queries that choose rows in turn under caps and quotas, and records of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, records
from .queries import VERDICTS, query, rounded, table, verdicts

COUNT, CAP, SEED, QUOTAS = 60, 2, 20, {"en": 30, "fr": 12, "de": 10}

_BUCKET = "case when n_chars < 800 then '1-short' when n_chars < 1800 then '2-medium' else '3-long' end"
_STRATA = [(b, lang) for b in ("1-short", "2-medium", "3-long") for lang in ("de", "en", "es", "fr")]
#: the state is one row: what was taken so far; each step is the turn of a stratum, and a session's rows that don't fit any more are passed over
_TAKE = f"""c as (select doc_id, lang, source as session, {_BUCKET} as bucket, case when doc_id % 3 = 0 then 0 else 1 end as tier, md5('{SEED}:' || source || ':' || doc_id) as d from documents),
  l as (select tier, bucket, lang, list({{'id': doc_id, 's': session, 'q': lang}} order by d, doc_id) as rows from c group by all), g as (select *, row_number() over (partition by tier order by bucket, lang) - 1 as k, count(*) over (partition by tier) as strata from l),
  m as (select tier, list(rows order by k) as waiting, any_value(strata) as strata from g group by tier), w as (select list(waiting order by tier) as waiting, list(strata order by tier) as strata from m),
  t(tier, k, idle, taken, found) as (select 1, 0, 0, [{{'id': cast(-1 as bigint), 's': '', 'q': ''}}], null::struct(id bigint, s varchar, q varchar) union all
    select case when n.idle >= strata[n.tier] then n.tier + 1 else n.tier end, case when n.idle >= strata[n.tier] then 0 else n.k end, case when n.idle >= strata[n.tier] then 0 else n.idle end, n.taken, n.found
    from (select f.tier, (f.k + 1) % strata[f.tier] as k, case when f.x is null then f.idle + 1 else 0 end as idle, case when f.x is null then f.taken else list_append(f.taken, f.x) end as taken, f.x as found, strata, waiting
      from (select t.*, strata, waiting, list_filter(waiting[t.tier][t.k + 1], lambda x: not list_contains(list_transform(t.taken, lambda y: y.id), x.id) and len(list_filter(t.taken, lambda y: y.s = x.s)) < {CAP}
        and len(list_filter(t.taken, lambda y: y.q = x.q)) < {" ".join(f"case when x.q = '{k}' then {v} else" for k, v in QUOTAS.items())} 0 {"end " * len(QUOTAS)})[1] as x from t, w where t.tier <= 2 and len(t.taken) <= {COUNT}) f) n)"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("bucket", F.expr(_BUCKET)).withColumn("tier", F.expr("case when doc_id % 3 = 0 then 0 else 1 end"))
    return ranking.quota_take(docs, COUNT, ["bucket", "lang"], "doc_id", "source", SEED, CAP, "lang", QUOTAS, "tier")


@query(f"with recursive {_TAKE} select x.id as doc_id, cast(n - 1 as integer) as place from (select unnest(taken) as x, generate_subscripts(taken, 1) as n from (select taken from t order by len(taken) desc limit 1)) where n > 1")
def quota_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen in turn from strata of length and language, two tiers after one another, at most two of a source, with quotas by language."""
    return chosen(spark, sf_dir).select("doc_id", "place")


@query(f"with recursive {_TAKE}, y as (select unnest(taken) as x from (select taken from t order by len(taken) desc limit 1)) select concat(source, '-', lpad(cast(doc_id as varchar), 4, '0')) as id, concat('clips/', doc_id, '.wav') as clip, source as session, lang as language, round(n_chars / 15.0, 3) as duration_s from documents join y on x.id = doc_id")
def pilot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of such a choice, one line for each clip."""
    rows = chosen(spark, sf_dir).select(F.col("source").alias("session_id"), F.format_string("/data/set/clips/%d.wav", "doc_id").alias("clip_path"), F.col("lang").alias("language"), (F.col("n_chars") / 15).alias("duration"), F.lit("video").alias("source"), "doc_id", "place")
    told = records.pilot_rows(rows, "/data/set", stem=F.lpad(F.col("doc_id").cast("string"), 4, "0"))
    return rounded(told.select("id", "clip", "session", "language", "duration_s"), 3)


@query(f"{VERDICTS}, u as (select first as system, case when winner = first then 1.0 when winner = 'tie' then 0.5 else 0.0 end as c from v where winner is not null union all select second, case when winner = second then 1.0 when winner = 'tie' then 0.5 else 0.0 end from v where winner is not null) select system, cast(sum(c) as double) as wins, count(*) as games from u group by system")
def system_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and games of each system, ties as halves."""
    return ranking.records(verdicts(spark, sf_dir))
