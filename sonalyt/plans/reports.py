"""The report as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators import judging
from ..operators.report import SECTIONS, TEXT_SECTIONS, report, text_report
from ..sources import runs as R
from .entities import ORDERS, SCORED, orders
from .queries import ORACLE_SQL, query, rounded
from .texts import _D, _S, kinds

_KEPT = "z as (select * exclude (m) from (select *, max(file_ordinal) over (partition by provider, mode) as m from s) where file_ordinal = m)"
_TABLES = {
    "stt": ORACLE_SQL["lane_summary"].replace("from s group by all", "from z group by all").replace(", summary as (", f", {_KEPT}, summary as (", 1),
    "snr": ORACLE_SQL["snr_degradation"].replace("from s group by all", "from z group by all").replace(", l as (", f", {_KEPT}, l as (", 1),
    "tts": ORACLE_SQL["tts_lane_summary"],
    "delta": ORACLE_SQL["batch_stream_delta"],
}
_TABLES = {k: sql.replace(", 4)", ", 12)").replace(", 6)", ", 12)") for k, sql in _TABLES.items()}  # rounded once, at the end
_KEYS = {"stt": "provider, mode, language", "snr": "provider, mode, null as language", "tts": "provider, mode, null as language", "delta": "provider, null as mode, null as language"}


@query(" union all ".join(f"select '{s}' as section, {_KEYS[s]}, '{m}' as metric, round(cast({m} as double), 3) as value from ({_TABLES[s]})" for s in SECTIONS for m in SECTIONS[s]))
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report(R.stt_runs(spark, sf_dir), R.tts_runs(spark, sf_dir), R.prices(spark)), 3)


_SAID = "concat({text}, case when k % 11 = 0 then ' thank you for watching' else '' end)"
_EVENTS = [("k % 4 = 0", "1.2", "eou"), ("k % 6 = 0", "3.0", "eou"), ("true", "4.0 + (k % 10) / 10.0", "eou"), ("k % 5 < 4", "5.0", "text")]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' calls as clips with texts, events and pauses; every fifth final is missing, every eleventh text goes on after the speech."""
    event = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.expr(f"cast({at} as double)").alias("t_s"), F.lit("" if kind == "eou" else "said").alias("text"), F.lit(kind == "text").alias("is_final"), F.lit(kind).alias("kind"))) for when, at, kind in _EVENTS]))
    pauses = F.array(F.array(F.lit(1.0), F.lit(1.5)), F.array(F.lit(4.9), F.lit(5.5)))
    return orders(spark, sf_dir).withColumns({
        "text": F.expr(_SAID.format(text="text")), "clip_id": F.concat(F.when(F.col("k") % 7 == 0, "noise-").otherwise(""), F.col("k").cast("string")), "audio_s": F.lit(6.0), "events": event, "pauses": pauses,
        "speech_end_s": F.lit(4.0), "eou_source": F.lit("native"), "ws_rtt_s": F.col("k") % 10 / 100,
    })


_ROWS = f"""{SCORED}, p as (select *, error is not null as failed, string_split(regexp_replace({_SAID.format(text="text")}, '[$]([0-9]+)', '\\1 dollars'), ' ') as w, string_split(regexp_replace(reference, '[$]([0-9]+)', '\\1 dollars'), ' ') as r from (select *, case when k % 5 = 0 then 'failed' end as error from o)),
  q as (select *, case when not failed then {kinds("r", "w")} end as c, len(w) - list_position(w, 'lots') as tail, case when k % 7 = 0 then 'noise' else 'speech' end as condition from p),
  n as (select *, (c // {_S}) % 16384 as s, (c // {_D}) % 16384 as d, c % 16384 as i from q),
  accuracy as (select provider, count(*) as clips, count(*) filter (where failed) as failures, sum(s) as substitutions, sum(d) as deletions, sum(i) as insertions, sum(len(r)) filter (where not failed) as reference_length, sum(s + d + i) / sum(len(r)) filter (where not failed) as error_rate from n group by provider),
  entities as (select provider, class, count(*) as occurrences, sum(gone + put_in) / sum(tokens) as error_rate, count(*) filter (where gone = 0 and put_in = 0) / count(*) as exact_rate from e group by all),
  endpointing as (select provider, 2 * count(*) filter (where not failed) as hold_pauses, count(*) filter (where not failed and k % 4 = 0) + count(*) filter (where not failed and k % 10 = 9) as cut_pauses, count(*) filter (where not failed and k % 5 < 4) as finals_in_pauses,
    count(*) filter (where not failed and k % 4 = 0) + count(*) filter (where not failed and k % 6 = 0) as premature_ends, quantile_cont((4.0 + (k % 10) / 10.0)::double - 4.0, 0.5) filter (where not failed) as latency_p50, quantile_cont((4.0 + (k % 10) / 10.0)::double - 4.0, 0.99) filter (where not failed) as latency_p99,
    avg(case when not failed then ((4.0 + (k % 10) / 10.0)::double - 4.0 <= 0.35)::int end) as within_0, avg(case when not failed then ((4.0 + (k % 10) / 10.0)::double - 4.0 <= 0.65)::int end) as within_1, quantile_cont(k % 10 / 100.0, 0.5) filter (where not failed) as rtt_p50 from n group by provider),
  hallucinations as (select provider, condition, count(*) as clips, count(*) filter (where not failed and tail >= 3) as fabricated_clips, coalesce(sum(i), 0) as inserted_words, 0 as phantom_finals, 0 as looped_clips,
    count(*) filter (where not failed and tail >= 3) / nullif(count(*) filter (where not failed), 0) as fabrication_rate, 0.0 as loop_rate from n group by all)"""
_OF = {"entities": "class", "hallucinations": "condition"}


@query(
    f"{_ROWS} "
    + " union all ".join(
        f"select '{s}' as section, provider, 'stream' as mode, 'en-US' as language, " + (f"concat('{m}[', {_OF[s]}, ']')" if s in _OF else f"'{m}'") + f" as metric, round(cast({m} as double), 4) as value from {s}" for s, metrics in TEXT_SECTIONS.items() for m in metrics
    )
)
def text_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run from its texts and events in one job."""
    return rounded(text_report(calls(spark, sf_dir), (0.35, 0.65)), 4)


_FAMILY = {"tts0": "x", "tts1": "y", "ja": "x", "jb": "y"}
_JUDGED = f"""with o as ({ORDERS}), p as (select concat('tts', cast(k % 3 as string)) as provider, concat('j', provider) as judge, k, reference, text from o)"""


@query(
    f"""{_JUDGED.replace("as string", "as varchar")}, w as (select *, string_split(regexp_replace(text, '[$]([0-9]+)', '\\1 dollars'), ' ') as h, string_split(regexp_replace(reference, '[$]([0-9]+)', '\\1 dollars'), ' ') as r from p where k % 5 <> 0 and k % 11 <> 0 and not (judge = 'jc' and k % 2 = 0)),
  c as (select provider, judge, sum((c // {_S}) % 16384 + (c // {_D}) % 16384 + c % 16384) as e, sum(n) as n, any_value(provider = 'tts0' and judge = 'ja' or provider = 'tts1' and judge = 'jb') as same from (select *, {kinds("r", "h")} as c, len(r) as n from w) group by all)
  select provider, 'batch' as mode, round(sum(e) filter (where not same) / sum(n) filter (where not same), 6) as roundtrip_error_rate, max(e / n) - min(e / n) > 0.02 as diverged, {", ".join(f'round(max(e / n) filter (where judge = {j!r}), 6) as "rt[{j}]", bool_or(same) filter (where judge = {j!r}) as "rt_own[{j}]"' for j in ("ja", "jb", "jc"))} from c group by provider"""
)
def roundtrip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges heard of synthesised prompts: pooled over other families, with a column for each judge that the data has."""
    said = orders(spark, sf_dir).withColumns({"judge": F.concat(F.lit("j"), "provider"), "provider": F.concat(F.lit("tts"), (F.col("k") % 3).cast("string"))}).where("not (judge = 'jc' and k % 2 = 0)")
    runs = said.groupBy("provider", "language", "reference", "error", "k").agg(F.collect_list(F.struct(F.col("judge").alias("provider"), "text", F.lit(None).cast("string").alias("error"))).alias("roundtrip"))
    runs = runs.select("*", F.lit("batch").alias("mode"), (F.col("k") % 11 == 0).alias("cold"))
    families = spark.createDataFrame(list(_FAMILY.items()), "key string, family string")
    return rounded(judging.roundtrip_table(judging.judge_counts(runs), families))
