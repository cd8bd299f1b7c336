"""The library's operators over the given tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, labels, languages, pcm, similarity, tags
from ..functions import text as X
from ..operators import judging, lanes, quantiles, ranking, sessions
from ..sources import runs as R
from ..streaming import sessions as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

STT, TTS = R.STT_SQL.format(lineitem="lineitem"), R.TTS_SQL.format(lineitem="lineitem")
WITH_STT, WITH_TTS, PRICES = f"with s as ({STT})", f"with t as ({TTS})", f"prices as (select * from {R.PRICES_SQL})"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as they can be compared between engines whose sums run in another order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SUMMARY = f"""{WITH_STT}, summary as (select provider, mode, language, count(*) as clips, count(*) filter (where error is not null) as failures,
  sum(edits) filter (where error is null and gold_status <> 'unverified') / nullif(sum(reference_length) filter (where error is null and gold_status <> 'unverified'), 0) as error_rate,
  quantile_cont(ttft_s, 0.5) filter (where error is null) as ttft_s_p50, quantile_cont(ttft_s, 0.95) filter (where error is null) as ttft_s_p95,
  quantile_cont(finalize_s, 0.5) filter (where error is null) as finalize_s_p50, quantile_cont(finalize_s, 0.95) filter (where error is null) as finalize_s_p95,
  quantile_cont(total_s / audio_s, 0.5) filter (where error is null and audio_s > 0) as rtf_p50, coalesce(string_agg(distinct license, ',' order by license), '') as licenses
  from s group by all)"""


@query(
    f"""{SUMMARY} select provider, mode, language, clips, failures, round(error_rate, 6) as error_rate, round(ttft_s_p50, 6) as ttft_s_p50, round(ttft_s_p95, 6) as ttft_s_p95,
  round(finalize_s_p50, 6) as finalize_s_p50, round(finalize_s_p95, 6) as finalize_s_p95, round(rtf_p50, 6) as rtf_p50, licenses from summary"""
)
def lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.stt_summary(R.stt_runs(spark, sf_dir)))


@query(f"{WITH_STT} select provider, mode, file_ordinal, count(*) as clips, count(distinct language) as languages from (select *, max(file_ordinal) over (partition by provider, mode) as m from s) where file_ordinal = m group by all")
def lane_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lanes.supersede(R.stt_runs(spark, sf_dir))
    return kept.groupBy("provider", "mode", "file_ordinal").agg(F.count("*").alias("clips"), F.count_distinct("language").alias("languages"))


@query(f"{WITH_STT} select provider, mode, clip_id, seq, round(total_s, 6) as total_s from (select *, row_number() over (partition by provider, mode, clip_id order by seq desc, tie desc, total_s desc) as n from s where error is null) where n = 1")
def keep_last_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = R.stt_runs(spark, sf_dir).where("error is null")
    return rounded(lanes.keep_last(usable, ["provider", "mode", "clip_id"], ["seq", "tie", "total_s"]).select("provider", "mode", "clip_id", "seq", "total_s"))


@query(
    f"""{WITH_TTS}, {PRICES}, g as (select provider, case when load_n > 1 then concat(mode, ' x', cast(load_n as varchar)) else mode end as mode, count(*) as prompts, count(*) filter (where error is not null) as failures,
  cast(sum(chars) filter (where error is null) as bigint) as chars, sum(audio_s) filter (where error is null) as audio_s, quantile_cont(ttfb_s, 0.5) filter (where error is null and not cold) as ttfb_p50,
  quantile_cont(ttfb_s, 0.95) filter (where error is null and not cold) as ttfb_p95, quantile_cont(ttfa_s, 0.5) filter (where error is null and not cold) as ttfa_p50 from t group by all)
  select g.provider, mode, prompts, failures, chars, round(audio_s, 4) as audio_s, round(ttfb_p50, 4) as ttfb_p50, round(ttfb_p95, 4) as ttfb_p95, round(ttfa_p50, 4) as ttfa_p50, coalesce(family, g.provider) as family,
  round(coalesce(chars * usd_per_million_chars / 1e6, audio_s * usd_per_hour / 3600), 4) as cost_usd from g left join prices using (provider)"""
)
def tts_lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.tts_summary(R.tts_runs(spark, sf_dir), R.prices(spark)), 4)


@query(
    f"""{WITH_TTS}, one as (select * from t where load_n = 1 and not cold and error is null), b as (select provider, prompt_id from one group by all having count(distinct mode) = 2)
  select provider, count(distinct prompt_id) as prompts, round(quantile_cont(ttfb_s, 0.5) filter (where mode = 'batch'), 6) as ttfb_p50_batch, round(quantile_cont(ttfb_s, 0.5) filter (where mode = 'stream'), 6) as ttfb_p50_stream,
  round(quantile_cont(ttfb_s, 0.5) filter (where mode = 'stream') - quantile_cont(ttfb_s, 0.5) filter (where mode = 'batch'), 6) as delta_s from one semi join b using (provider, prompt_id) group by provider"""
)
def batch_stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.mode_delta(R.tts_runs(spark, sf_dir)))


@query(f"{WITH_STT}, {PRICES} select provider, count(*) as clips, round(sum(audio_s / 3600 * usd_per_hour), 4) as usd from s left join prices using (provider) group by rollup (provider)")
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.spend(R.stt_runs(spark, sf_dir), R.prices(spark)), 4)


@query(
    f"""{WITH_STT}, l as (select provider, mode, snr_level, sum(edits) filter (where error is null) / nullif(sum(reference_length) filter (where error is null), 0) as error_rate,
  quantile_cont(finalize_s, 0.5) filter (where error is null) as p50, count(*) filter (where error is not null) as failures from s group by all),
  a as (select *, (error_rate + lead(error_rate) over w) / 2 * (lead(snr_level) over w - snr_level) as area from l window w as (partition by provider, mode order by snr_level))
  select provider, mode, count(*) as levels, cast(sum(failures) as bigint) as failures, round(case when count(*) >= 2 then sum(area) / nullif(max(snr_level) - min(snr_level), 0) end, 6) as auc,
  round(arg_min_null(p50, snr_level) - arg_max_null(p50, snr_level), 6) as degradation_s from a group by all"""
)
def snr_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.snr_curve(R.stt_runs(spark, sf_dir)))


@query(
    f"""{WITH_STT}, n as (select language, count(distinct provider || mode) as lanes from s group by 1), h as (select language, clip_id, count(distinct provider || mode) as held from s group by all),
  c as (select language, clip_id, row_number() over (partition by language order by clip_id) as n from h join n using (language) where held = lanes)
  select provider, mode, language, count(*) as clips from s semi join (select * from c where n <= 25) using (language, clip_id) group by all"""
)
def common_clip_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.common_clips(R.stt_runs(spark, sf_dir), 25).groupBy("provider", "mode", "language").agg(F.count("*").alias("clips"))


@query(f"{WITH_STT} select provider, mode, lower(error) as reason, regexp_matches(lower(error), 'concurrent|concurrency|too many|rate limit|rate_limit|quota|429|503|temporarily unavailable') as transient, count(*) as clips from s where error is not null group by all")
def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = R.stt_runs(spark, sf_dir).where("error is not null").withColumn("reason", F.lower("error"))
    return bad.groupBy("provider", "mode", "reason", labels.transient(F.col("reason")).alias("transient")).agg(F.count("*").alias("clips"))


@query(
    f"""{WITH_TTS}, p as (select provider, concat(prompt_id, '-', chars) as prompt_id, mode from t), a as (select distinct provider, prompt_id from p where mode = 'batch'), b as (select distinct provider, prompt_id from p where mode = 'stream')
  select provider, prompt_id, case when a.provider is null then 'stream' else 'batch' end as only_in from a full join b using (provider, prompt_id) where a.provider is null or b.provider is null"""
)
def one_sided_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric difference of the two modes' prompts, a prompt being told by its length too."""
    rows = R.tts_runs(spark, sf_dir).withColumn("prompt_id", F.concat_ws("-", "prompt_id", "chars")).groupBy("provider", "prompt_id").agg(F.count_distinct("mode").alias("n"), F.min("mode").alias("only_in"))
    return rows.where("n = 1").drop("n")


# transcripts ---------------------------------------------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' '{g}), ' +', ' '{g}))"
TURNS_SQL = """select concat(cast(conv_id as string), '-', cast(turn as string)) as clip_id, case when conv_id % 2 = 0 then 'en' else 'und' end as language, {clean} as reference from {conversations} where role = 'user'"""
HYPOTHESES = {"a": (" th", " t"), "b": ("en", "in"), "c": (" the ", " "), "d": ("zz", "zz")}
TURNS = TURNS_SQL.format(clean=_CLEAN.format(g=", 'g'"), conversations="conversations")
HEARD = "with turns as (select distinct * from (" + TURNS + ")), heard as (" + " union all ".join(f"select *, '{k}' as lane, replace(reference, '{x}', '{y}') as text from turns" for k, (x, y) in HYPOTHESES.items()) + ")"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four simulated lanes heard of the users' turns."""
    turns = spark.sql(TURNS_SQL.format(clean=_CLEAN.format(g=""), conversations="{conversations}"), conversations=table(spark, sf_dir, "conversations")).distinct()
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.replace("reference", F.lit(x), F.lit(y)).alias("text")) for k, (x, y) in HYPOTHESES.items()]))
    return turns.withColumn("h", said).select("clip_id", "language", "reference", "h.lane", "h.text")


@query(f"{HEARD} select lane, language, count(*) as clips, cast(sum(levenshtein(reference, text)) as bigint) as errors, cast(sum(length(reference)) as bigint) as characters, round(sum(levenshtein(reference, text)) / nullif(sum(length(reference)), 0), 6) as error_rate from heard group by all")
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(spark, sf_dir).withColumn("e", F.when(F.col("reference") == F.col("text"), 0).otherwise(F.levenshtein("reference", "text")))
    return rounded(rows.groupBy("lane", "language").agg(F.count("*").alias("clips"), F.sum("e").alias("errors"), F.sum(F.length("reference")).alias("characters")).withColumn("error_rate", F.col("errors") / F.nullif(F.col("characters"), F.lit(0))))


@query()
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by kind; tests/ holds them against another alignment and against token_distance()."""
    rows = transcripts(spark, sf_dir).withColumn("e", X.edits(X.words(F.col("reference")), X.words(F.col("text")))).withColumn("distance", X.token_distance(X.words(F.col("reference")), X.words(F.col("text"))))
    total = rows.groupBy("lane", "language").agg(F.count("*").alias("clips"), *[F.sum(f"e.{c}").alias(c) for c in ("substitutions", "deletions", "insertions", "reference_length")], F.sum("distance").alias("distance"))
    return rounded(total.withColumn("error_rate", X.error_rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("reference_length"))))


@query(
    f"""{HEARD} select a.lane as lane_a, b.lane as lane_b, a.language, count(*) as clips, cast(sum(levenshtein(a.text, b.text)) as bigint) as edits, cast(sum(length(a.text) + length(b.text)) as bigint) as characters,
  round(2 * sum(levenshtein(a.text, b.text)) / nullif(sum(length(a.text) + length(b.text)), 0), 6) as disagreement from heard a join heard b on a.clip_id = b.clip_id and a.lane < b.lane
  where trim(a.text) <> '' and trim(b.text) <> '' group by grouping sets ((a.lane, b.lane), (a.lane, b.lane, a.language))"""
)
def lane_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement of each pair of lanes without a reference, overall (language null) and by language.

    A clip's lanes are gathered first, so the text is shuffled once and pairs are made within a clip, whose lanes are few.
    """
    rows = transcripts(spark, sf_dir).where("trim(text) != ''").groupBy("clip_id", "language").agg(F.array_sort(F.collect_list(F.struct("lane", "text"))).alias("h"))
    pairs = F.flatten(F.transform("h", lambda a: F.transform(F.filter("h", lambda b: a.lane < b.lane), lambda b: F.struct(a.lane.alias("lane_a"), b.lane.alias("lane_b"), F.when(a.text == b.text, 0).otherwise(F.levenshtein(a.text, b.text)).alias("e"), (F.length(a.text) + F.length(b.text)).alias("n")))))
    each = rows.select("language", F.explode(pairs).alias("p")).select("language", "p.*")
    sets = each.groupingSets([["lane_a", "lane_b"], ["lane_a", "lane_b", "language"]], "lane_a", "lane_b", "language")
    total = sets.agg(F.count("*").alias("clips"), F.sum("e").alias("edits"), F.sum("n").alias("characters"))
    return rounded(total.withColumn("disagreement", 2 * F.col("edits") / F.nullif(F.col("characters"), F.lit(0))))


@query(
    """select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[\\p{Pc}\\p{Pd}\\p{Pe}\\p{Pf}\\p{Pi}\\p{Po}\\p{Ps}\\p{Sm}\\p{Sk}]', '', 'g'), '\\s+', ' ', 'g'))) as normalized from documents"""
)
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.squash(X.strip_punctuation(F.lower("text")))).alias("normalized"))


@query(
    """with lines as (select doc_id, lang, trim(unnest(string_split(text, chr(10)))) as line from documents), kept as (select line, lang, len(list_filter(string_split(line, ' '), lambda w: w <> '')) as n, row_number() over (partition by line order by doc_id, lang) as r from lines)
  select lang, count(*) as sentences, cast(sum(n) as bigint) as words from kept where r = 1 and n between 4 and 40 group by lang"""
)
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences, the first of each kept, of 4 to 40 words."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "lang")).alias("f"))
    return first.select("f.lang", F.size(X.words(F.col("line"))).alias("n")).where("n between 4 and 40").groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("n").alias("words"))


# sessions ------------------------------------------------------------------------------------------------------------

EVENTS_SQL = """select user_id, event_id, event_type, value, {micros} / 1e6 as t_s from {events}"""
EVENTS = "with e as (" + EVENTS_SQL.format(micros="(epoch_us(ts) - 1704067200000000)", events="events") + ")"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_SQL.format(micros="(unix_micros(cast(ts as timestamp)) - 1704067200000000)", events="{events}"), events=table(spark, sf_dir, "events"))


@query(
    f"""{EVENTS}, said as (select user_id, t_s, event_id, cast(cast(floor(value) as int) as varchar) as text from e where event_type <> 'purchase'),
  p as (select *, lag(text) over (partition by user_id order by t_s, event_id) as b from said where text <> '')
  select user_id, count(*) as pairs, count(*) filter (where not starts_with(text, b)) as revised, round(count(*) filter (where not starts_with(text, b)) / count(*), 6) as churn from p where b is not null group by user_id"""
)
def partial_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = events(spark, sf_dir).select("user_id", "t_s", "event_id", F.floor("value").cast("int").cast("string").alias("text"), (F.col("event_type") == "purchase").alias("is_final"))
    return rounded(sessions.session_churn(said, "user_id", ["t_s", "event_id"]))


@query(
    f"""{EVENTS}, p as (select user_id, event_id as pause_id, t_s as start_s, t_s + value * 60 as end_s from e where event_type = 'error'), c as (select user_id, t_s from e where event_type in ('click', 'view'))
  select user_id, count(*) as pauses, count(*) filter (where hits > 0) as cut_off, cast(sum(hits) as bigint) as points from (select p.user_id, p.pause_id, count(c.t_s) as hits from p left join c on p.user_id = c.user_id and c.t_s >= start_s and c.t_s < end_s group by all) group by user_id"""
)
def pause_cut_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: pauses that an endpoint falls into; a pause counts once."""
    e = events(spark, sf_dir)
    pauses = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("pause_id"), F.col("t_s").alias("start_s"), (F.col("t_s") + F.col("value") * 60).alias("end_s"))
    hit = sessions.pauses_hit(pauses, e.where("event_type in ('click', 'view')").select("user_id", "t_s"), "user_id")
    return hit.groupBy("user_id").agg(F.count("*").alias("pauses"), F.count(F.when(F.col("hits") > 0, 1)).alias("cut_off"), F.sum("hits").alias("points"))


FIRST = f"""{EVENTS}, s as (select user_id, event_id as start_id, t_s from e where event_type = 'signup'), v as (select user_id, t_s from e where event_type = 'view'),
  f as (select s.user_id, s.start_id, s.t_s as start_s, v.t_s as first_s, v.t_s - s.t_s as latency_s from s asof left join v on s.user_id = v.user_id and s.t_s <= v.t_s)"""


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    starts = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("t_s").alias("start_s"))
    return sessions.first_after(starts, e.where("event_type = 'view'").select("user_id", "t_s"), "user_id")


@query(f"{FIRST} select user_id, start_id, round(latency_s, 3) as latency_s from f")
def first_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the first view at or after each signup."""
    return rounded(_first(spark, sf_dir).select("user_id", "start_id", "latency_s"), 3)


@query(f"{FIRST} select user_id % 10 as lane, count(latency_s) as found, round(avg(case when latency_s <= 86400 then 1.0 when latency_s is not null then 0.0 end), 6) as within_day, round(quantile_cont(latency_s, 0.5), 3) as latency_p50 from f group by all")
def endpoint_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first(spark, sf_dir).withColumn("lane", F.col("user_id") % 10)
    counts = f.groupBy("lane").agg(F.count("latency_s").alias("found"), F.round(sessions.within("latency_s", 86400.0), 6).alias("within_day"))
    return rounded(counts.join(quantiles.percentiles(f, ["lane"], "latency_s", {"latency_p50": 0.5}), "lane", "left").withColumn("latency_p50", F.round("latency_p50", 3)))


MERGED = f"""{EVENTS}, i as (select user_id, t_s as s, t_s + value * 3600 as e from e where event_type = 'view'),
  r as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as b from i),
  n as (select *, sum(case when b is null or s > b then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as k from r), m as (select user_id, k, min(s) as start_s, max(e) as end_s from n group by all)"""


def _silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("t_s").alias("s"), (F.col("t_s") + F.col("value") * 3600).alias("e"))
    return sessions.islands(views, "user_id", "s", "e")


@query(f"{MERGED} select user_id, count(*) as islands, round(sum(end_s - start_s), 2) as covered_s from m group by user_id")
def merged_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_silences(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("islands"), F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s")), 2)


@query(
    f"""{MERGED}, b as (select user_id, min(t_s) as from_s, max(t_s) as to_s from e group by 1),
  x as (select user_id, s, e from (select m.user_id, greatest(start_s, from_s) as s, least(end_s, to_s) as e from m join b using (user_id)) where s < e union all select user_id, to_s, to_s from b),
  g as (select user_id, coalesce(lag(e) over (partition by user_id order by s, e), from_s) as start_s, s as end_s from x join b using (user_id))
  select user_id, count(*) as segments, round(sum(end_s - start_s), 2) as speech_s from g where end_s - start_s > 0.5 group by user_id"""
)
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged silences of a session leave."""
    bounds = events(spark, sf_dir).groupBy("user_id").agg(F.min("t_s").alias("from_s"), F.max("t_s").alias("to_s"))
    gaps = sessions.complement(_silences(spark, sf_dir), bounds, "user_id", 0.5)
    return rounded(gaps.groupBy("user_id").agg(F.count("*").alias("segments"), F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s")), 2)


@query(
    f"""{EVENTS}, r as (select user_id, event_type in ('view', 'click') as f, row_number() over (partition by user_id order by t_s, event_id) - row_number() over (partition by user_id, event_type in ('view', 'click') order by t_s, event_id) as k from e),
  l as (select user_id, k, count(*) as length from r where f group by all) select user_id, count(*) as runs, count(*) filter (where length >= 3) as fabricated, max(length) as longest from l group by user_id"""
)
def insertion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of flagged events of a session, and those of three or more."""
    flagged = events(spark, sf_dir).withColumn("flag", F.col("event_type").isin("view", "click"))
    r = sessions.runs(flagged, "user_id", ["t_s", "event_id"], "flag")
    return r.groupBy("user_id").agg(F.count("*").alias("runs"), F.count(F.when(F.col("length") >= 3, 1)).alias("fabricated"), F.max("length").alias("longest"))


@query(f"{EVENTS} select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from e) where n = 1")
def largest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min_by(F.struct("event_id", "value"), F.struct((-F.col("value")).alias("v"), "event_id"))
    return events(spark, sf_dir).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.value")


# ranking -------------------------------------------------------------------------------------------------------------


@query(
    f"""{SUMMARY}, r as (select provider, rank() over (partition by language, mode order by error_rate nulls last) + (count(*) over (partition by language, mode, error_rate) - 1) / 2.0 as k from summary
  union all select provider, rank() over (partition by language, mode order by finalize_s_p50 nulls last) + (count(*) over (partition by language, mode, finalize_s_p50) - 1) / 2.0 from summary where mode = 'stream')
  select provider, round(avg(k), 6) as mean_rank, count(*) as cells from r group by provider"""
)
def composite_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank over languages, modes and two metrics; batch lanes have no finalisation, so those cells are left out."""
    s = lanes.stt_summary(R.stt_runs(spark, sf_dir))
    return rounded(ranking.composite(s, "provider", ["language", "mode"], {"error_rate": False, "finalize_s_p50": False}))


@query(
    f"""{SUMMARY} select a.language, a.provider, a.mode, round(a.rtf_p50, 6) as rtf_p50, round(a.error_rate, 6) as error_rate from summary a where a.rtf_p50 is not null and a.error_rate is not null and not exists
  (select 1 from summary b where b.language = a.language and b.rtf_p50 <= a.rtf_p50 and b.error_rate <= a.error_rate and (b.rtf_p50 < a.rtf_p50 or b.error_rate < a.error_rate))"""
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lanes.stt_summary(R.stt_runs(spark, sf_dir))
    return rounded(ranking.pareto(s, "rtf_p50", "error_rate", ["language"]).select("language", "provider", "mode", "rtf_p50", "error_rate"))


@query(
    f"""{SUMMARY} select language, provider, mode, row_number() over (partition by language order by error_rate nulls last, provider, mode) as position, round(case when max(error_rate) over w > min(error_rate) over w
  then (error_rate - min(error_rate) over w) / (max(error_rate) over w - min(error_rate) over w) when error_rate is not null then 0 end, 6) as shade from summary window w as (partition by language)"""
)
def overview_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lanes.stt_summary(R.stt_runs(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.asc_nulls_last("error_rate"), "provider", "mode"))
    return rounded(s.select("language", "provider", "mode", place.alias("position"), ranking.min_max("error_rate", ["language"]).alias("shade")))


@query("select doc_id, lang, source from documents order by md5('7:' || doc_id) limit 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sample(table(spark, sf_dir, "documents"), 100, 7, "doc_id").select("doc_id", "lang", "source")


@query("select doc_id, source from (select *, row_number() over (partition by source order by md5('11:' || source || ':' || doc_id), doc_id) as n from documents) where n <= 3 order by md5('11:' || source || ':' || doc_id), doc_id limit 40")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped_sample(table(spark, sf_dir, "documents"), 40, "source", "doc_id", 11).select("doc_id", "source")


@query(
    """with b as (select *, case when n_chars < 500 then 'short' when n_chars < 3000 then 'medium' else 'long' end as bucket from documents), g as (select *, row_number() over (partition by source order by md5('3:' || doc_id), doc_id) as k from b),
  t as (select *, row_number() over (partition by bucket, lang order by md5('4:' || doc_id), doc_id) as turn from g where k <= 5) select doc_id, bucket, lang, turn from t order by turn, bucket, lang, doc_id limit 48"""
)
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    docs = table(spark, sf_dir, "documents").withColumn("bucket", bucket)
    return ranking.round_robin(docs, 48, ["bucket", "lang"], "doc_id", 3, "source", 5).select("doc_id", "bucket", "lang", "turn")


# votes ---------------------------------------------------------------------------------------------------------------

VOTES_SQL = """select l_partkey as item, concat('r', cast(l_suppkey % 4 as string)) as rater, case l_returnflag when 'A' then 'entity' when 'N' then 'meaning' else 'harmless' end as label from {lineitem}"""
VERDICTS_SQL = """select l_linestatus as aspect, concat('p', cast(l_partkey % 60 as string)) as prompt_id, concat('sys', cast(l_suppkey % 4 as string)) as first, concat('sys', cast((l_suppkey % 4 + 1 + l_orderkey % 3) % 4 as string)) as second,
  case when l_linenumber = 7 then null when l_returnflag = 'N' then 'tie' when l_returnflag = 'A' then concat('sys', cast(l_suppkey % 4 as string)) else concat('sys', cast((l_suppkey % 4 + 1 + l_orderkey % 3) % 4 as string)) end as winner from {lineitem}"""
VOTES, VERDICTS = f"with v as ({VOTES_SQL.format(lineitem='lineitem')})", f"with v as ({VERDICTS_SQL.format(lineitem='lineitem')})"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOTES_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERDICTS_SQL, lineitem=table(spark, sf_dir, "lineitem"))


SEVERITY = ["entity", "meaning", "harmless"]


@query(
    f"""{VOTES}, c as (select item, label, count(*) as n, case label when 'entity' then 0 when 'meaning' then 1 else 2 end as s from v group by all)
  select item, arg_max(label, (n, -s)) as majority, cast(sum(n) as bigint) as votes, count(*) = 1 as unanimous from c group by item"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.majority(votes(spark, sf_dir), ["item"], "label", SEVERITY)


RATED = f"""{VOTES}, o as (select item, rater, min(label) as label from v group by all), p as (select a.rater as rater_a, b.rater as rater_b, a.label as la, b.label as lb from o a join o b using (item) where a.rater < b.rater),
  n as (select rater_a, rater_b, count(*) as n, avg(case when la = lb then 1.0 else 0.0 end) as observed from p group by all), x as (select rater_a, rater_b, la as l, count(*) as x from p group by all), y as (select rater_a, rater_b, lb as l, count(*) as y from p group by all),
  e as (select rater_a, rater_b, sum(x * y) as xy from x join y using (rater_a, rater_b, l) group by all)"""


@query(f"{RATED} select rater_a, rater_b, n, round(observed, 6) as observed, round(case when coalesce(xy, 0) / (n * n) >= 1 then cast(observed >= 1 as double) else (observed - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) end, 6) as kappa from n left join e using (rater_a, rater_b)")
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = votes(spark, sf_dir).groupBy("item", "rater").agg(F.min("label").alias("label"))
    return rounded(ranking.rater_agreement(one, ["item"], "rater", "label"))


@query(
    f"""{VERDICTS}, g as (select aspect, prompt_id, least(first, second) as a, greatest(first, second) as b, count(*) as n, count(distinct winner) as w from v where winner is not null group by all having count(*) >= 2)
  select aspect, count(*) as pairs, count(*) filter (where w > 1) as flips, round(count(*) filter (where w > 1) / count(*), 6) as flip_rate from g group by aspect"""
)
def order_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.order_flips(verdicts(spark, sf_dir)))


@query(
    f"""{VERDICTS}, u as (select first as system, second as other, case when winner = first then 1.0 when winner = 'tie' then 0.5 else 0.0 end as c from v where winner is not null
  union all select second, first, case when winner = second then 1.0 when winner = 'tie' then 0.5 else 0.0 end from v where winner is not null) select system, other, cast(sum(c) as double) as wins, count(*) as games from u group by all"""
)
def win_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.wins(verdicts(spark, sf_dir))


@query()
def bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths with intervals from a bootstrap over prompts."""
    return rounded(ranking.bradley_terry(verdicts(spark, sf_dir)))


@query(
    """with e as (select user_id, event_id, epoch_us(ts) as us, value, event_type = 'purchase' as f from events where user_id is not null and ts is not null), g as (select *, us - lag(us) over (partition by user_id order by us, event_id) as gap from e)
  select user_id, count(*) as events, count(*) filter (where f) as finals, coalesce(max(gap), 0) as longest_gap_us, round(sum(value), 4) as total_value from g group by user_id"""
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of events into session counters as a stream, state kept between micro-batches; tests/ holds it against the batch form."""
    return streaming.fold_stored(spark, f"{sf_dir}/events.parquet")


# more scalars over the tables -----------------------------------------------------------------------------------------

_LOOPS = " or ".join(
    f"regexp_matches(array_to_string(list_transform(range(1, greatest(len(w) - {n} + 1, 1)), lambda i: case when w[i] = w[i + {n}] then '1' else '0' end), ''), '1{{{n * (max(3, -(-6 // n)) - 1)}}}')" for n in range(1, 6)
)


@query(f"with d as (select doc_id, lang, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents) select lang, count(*) as texts, count(*) filter (where {_LOOPS}) as looping, cast(sum(len(w)) as bigint) as words from d group by lang")
def looping_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that say an n-gram again and again, as decoders do when they lose the audio."""
    w = table(spark, sf_dir, "documents").select("lang", X.words(F.col("text")).alias("w"))
    return w.groupBy("lang").agg(F.count("*").alias("texts"), F.count(F.when(tags.loops(F.col("w")), 1)).alias("looping"), F.sum(F.size("w")).alias("words"))


@query(
    """select page_id, len(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) as paragraphs, md5(array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), '|')) as texts, length(regexp_replace(html, '</?(?:p|b|li)>', '', 'g')) as stripped from pages"""
)
def tagged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    p = tags.tagged(html, "p")
    return table(spark, sf_dir, "pages").select("page_id", F.size(p).alias("paragraphs"), F.md5(F.array_join(p, "|")).alias("texts"), F.length(tags.strip_tags(html, ["p", "b", "li"])).alias("stripped"))


@query()
def spoken_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns brought to the written form that scoring compares; tests/ holds the rules against examples."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(languages.normalize(F.col("text"), F.lit("en-US"))).alias("normalized"))


@query()
def pcm_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech bounds and pauses of each document's bytes taken as samples; tests/ holds the measures against made signals."""
    found = table(spark, sf_dir, "documents").select("doc_id", pcm.speech_bounds(16_000)(F.col("text").cast("binary")).alias("b"))
    return rounded(found.select("doc_id", "b.*"))


@query(
    f"""{EVENTS}, g as (select user_id as lane, t_s, t_s - lag(t_s) over (partition by user_id order by t_s, event_id) as gap from e)
  select lane, count(*) as chunks, round(min(t_s), 3) as first_s, round(quantile_cont(gap, 0.99), 3) as gap_p99, round(max(gap), 3) as longest from g group by lane"""
)
def chunk_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrival and the 99th percentile of gaps between chunks of a lane."""
    e = events(spark, sf_dir).withColumnRenamed("user_id", "lane")
    gap = F.col("t_s") - F.lag("t_s").over(Window.partitionBy("lane").orderBy("t_s", "event_id"))
    g = e.withColumn("gap", gap)
    counts = g.groupBy("lane").agg(F.count("*").alias("chunks"), F.min("t_s").alias("first_s"), F.max("gap").alias("longest"))
    return rounded(counts.join(quantiles.percentiles(g, ["lane"], "gap", {"gap_p99": 0.99}), "lane", "left"), 3)


@query(
    """with x as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(cast(v as double)) as m from x group by all)
  select label, count(*) as vectors, round(avg(cos), 4) as mean_cosine, round(min(cos), 4) as least from (select vec_id, x.label, sum(v * m) / sqrt(sum(cast(v as double) * v) * sum(m * m)) as cos from x join c on x.label = c.label and x.i = c.i group by all) group by label"""
)
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the mean of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("c"))
    both = vectors.join(mean, "label").withColumn("cos", similarity.cosine(F.col("v"), F.col("c")))
    return rounded(both.groupBy("label").agg(F.count("*").alias("vectors"), F.avg("cos").alias("mean_cosine"), F.min("cos").alias("least")), 4)


@query(
    f"""{SUMMARY}, r as (select language, rank() over (partition by language order by error_rate) + (count(*) over (partition by language, error_rate) - 1) / 2.0 as a, rank() over (partition by language order by rtf_p50) + (count(*) over (partition by language, rtf_p50) - 1) / 2.0 as b
  from summary where error_rate is not null and rtf_p50 is not null) select language, count(*) as lanes, round(corr(a, b), 6) as rho from r group by language"""
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation of accuracy and speed over a language's lanes."""
    s = lanes.stt_summary(R.stt_runs(spark, sf_dir)).where("error_rate is not null and rtf_p50 is not null")
    return rounded(ranking.spearman(s, "error_rate", "rtf_p50", ["language"]).select("language", F.col("n").alias("lanes"), "rho"))


@query()
def ranking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the composite ranking orders providers as their share of unedited clips does, with an exact permutation test."""
    runs = R.stt_runs(spark, sf_dir)
    composite = ranking.composite(lanes.stt_summary(runs), "provider", ["language", "mode"], {"error_rate": False})
    success = runs.groupBy("provider").agg(F.avg((F.col("error").isNull() & (F.col("edits") == 0)).cast("double")).alias("success"))
    return rounded(ranking.gate(composite.join(success, "provider").withColumn("failure", 1 - F.col("success")), "provider", "mean_rank", "failure"))


@query("select cast(time_bucket(interval '1 hour', ts) as varchar) as window_start, event_type, count(*) as events from events where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events) group by all")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour as a stream with a watermark: a window is returned once it is closed."""
    return streaming.windows_stored(spark, f"{sf_dir}/events.parquet")


@query(
    """with g as (select user_id, ts, event_id, value, case when ts - lag(ts) over w <= interval '6 hours' then 0 else 1 end as new from events where ts is not null window w as (partition by user_id order by ts, event_id)),
  s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
  select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as began, count(*) as events, round(sum(value), 4) as total from s group by user_id, k having max(ts) + interval '6 hours' <= (select max(ts) - interval '10 minutes' from events)"""
)
def timed_out_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a stream: one ends when its user has been silent for six hours, is given out when the watermark is past that, and leaves the state."""
    return rounded(streaming.sessions_stored(spark, f"{sf_dir}/events.parquet"), 4)


@query(f"with u as (select doc_id, lang, text from documents), a as ({TURNS}) select language, count(*) as texts, cast(sum(length(text)) as bigint) as characters from (select lang as language, text from u union all select language, reference from a) group by language")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources as one corpus, each with its own language."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "text")
    turns = spark.sql(TURNS_SQL.format(clean=_CLEAN.format(g=""), conversations="{conversations}"), conversations=table(spark, sf_dir, "conversations")).select("language", F.col("reference").alias("text"))
    return docs.unionByName(turns).groupBy("language").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"))


# judges --------------------------------------------------------------------------------------------------------------

JUDGED_SQL = """select concat('tts', cast(l_suppkey % 5 as string)) as provider, concat('stt', cast(l_partkey % 4 as string)) as judge, concat('clip', cast(l_orderkey % 500 as string)) as clip_id, case when l_linestatus = 'O' then 'stream' else 'batch' end as mode,
  l_linenumber - 1 + l_suppkey % 3 as edits, cast(l_quantity as int) as reference_length, case l_returnflag when 'A' then 'entity' when 'N' then 'meaning' else 'harmless' end as label, 3.0 + l_discount * 10 - l_tax * (l_suppkey % 5) * 3 as score from {lineitem}"""
JUDGED = f"with j as ({JUDGED_SQL.format(lineitem='lineitem')})"
FAMILIES = [("tts0", "vendor0"), ("tts1", "vendor1"), ("stt0", "vendor0"), ("stt1", "vendor1"), ("stt2", "vendor0")]
FAMILIES_SQL = "families as (select * from (values " + ", ".join(f"('{k}', '{f}')" for k, f in FAMILIES) + ") as f(key, family))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JUDGED_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "key string, family string")


@query(
    f"""{JUDGED}, {FAMILIES_SQL}, s as (select provider, judge, sum(edits) as e, sum(reference_length) as n from j group by all),
  b as (select s.*, coalesce(f.family, provider) <> coalesce(g.family, judge) as other from s left join families f on f.key = provider left join families g on g.key = judge)
  select provider, count(*) as judges, round(sum(e) filter (where other) / nullif(sum(n) filter (where other), 0), 6) as pooled_rate, count(*) >= 2 and max(e / n) - min(e / n) > 0.02 as diverges from b group by provider"""
)
def cross_family_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judging.cross_family_rate(judged(spark, sf_dir), families(spark)))


@query(f"{JUDGED}, {FAMILIES_SQL}, c as (select distinct provider as key, coalesce(family, provider) as f from j left join families on key = provider), g as (select distinct coalesce(family, judge) as f from j left join families on key = judge where judge in ('stt0', 'stt2')) select key from c where not exists (select 1 from g where g.f <> c.f)")
def unjudged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that two judges of one family leave without a judge of another."""
    j = judged(spark, sf_dir)
    return judging.unjudged(j.select(F.col("provider").alias("key")).distinct(), j.where("judge in ('stt0', 'stt2')").select(F.col("judge").alias("key")).distinct(), families(spark))


@query(
    f"""{JUDGED}, c as (select provider, mode, clip_id, label, count(*) as n, case label when 'entity' then 0 when 'meaning' then 1 else 2 end as s from j group by all),
  m as (select provider, mode, clip_id, arg_max(label, (n, -s)) as majority, count(*) = 1 as unanimous from c group by all)
  select provider, mode, count(*) as items, count(*) filter (where majority = 'entity') as n_entity, count(*) filter (where majority = 'meaning') as n_meaning, count(*) filter (where majority = 'harmless') as n_harmless, round(avg(cast(unanimous as int)), 6) as unanimity from m group by all"""
)
def semantic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judging.label_summary(judged(spark, sf_dir), ["provider", "mode"], ["clip_id"], SEVERITY))


_CONSENSUS = """select aspect, prompt_id, least(first, second) as a, greatest(first, second) as b, count(winner) as usable, case when count(winner) >= 2 and count(distinct winner) = 1 then max(winner) end as outcome from {v} group by all"""


@query(f"{VERDICTS} {_CONSENSUS.format(v='v')}")
def consensus_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.consensus(verdicts(spark, sf_dir))


@query(
    f"""{VERDICTS}, x as ({_CONSENSUS.format(v="(select * from v where aspect = 'F')")}), y as ({_CONSENSUS.format(v="(select * from v where aspect = 'O')")})
  select count(*) as keys, count(*) filter (where x.a is null or y.a is null) as one_sided, count(*) filter (where x.outcome is not null and y.outcome is not null) as compared, count(*) filter (where x.outcome = y.outcome) as agree from x full join y on x.prompt_id = y.prompt_id and x.a = y.a and x.b = y.b"""
)
def cross_family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of two judge panels over the same pairs."""
    c = judging.consensus(verdicts(spark, sf_dir))
    return judging.compare(c.where("aspect = 'F'"), c.where("aspect = 'O'"), ["prompt_id", "a", "b"], "outcome")


@query(
    f"""{JUDGED}, h as (select provider, clip_id, max(label) as human from j where clip_id like 'clip1%' group by all), f as (select * from (select *, row_number() over (partition by provider, clip_id order by case when mode = 'stream' then 0 else 1 end, label) as n from j) where n = 1)
  select provider, label, human, count(*) as clips from f join h using (provider, clip_id) group by all"""
)
def human_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    anchor = j.where("clip_id like 'clip1%'").groupBy("provider", "clip_id").agg(F.max("label").alias("human"))
    return judging.against_anchor(j.select("provider", "clip_id", "mode", "label"), anchor).groupBy("provider", "label", "human").agg(F.count("*").alias("clips"))


@query(
    f"""{JUDGED}, n as (select provider, count(*) as clips, avg(score) as mean from j where mode = 'stream' group by all), b as (select provider, avg(score) + 0.25 * cast(substr(provider, 4) as int) as mean from j where mode = 'batch' and provider <> 'tts1' group by provider)
  select provider, clips, round(n.mean, 4) as mean, round(b.mean, 4) as baseline, round(n.mean - b.mean, 4) as delta, coalesce(n.mean - b.mean < -0.3, false) as alert from n left join b using (provider)"""
)
def quality_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    before = j.where("mode = 'batch' and provider != 'tts1'").groupBy("provider").agg((F.avg("score") + 0.25 * F.substring("provider", 4, 9).cast("int")).alias("mean"))
    return rounded(judging.mean_score_alerts(j.where("mode = 'stream'"), before), 4)


# selection -----------------------------------------------------------------------------------------------------------

_ENTITY = (("currency", r"[$€£]\s?[0-9]+"), ("date", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"), ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("year", r"\b(?:19|20)[0-9]{2}\b"), ("digits", r"[0-9]{3,}"))


def _entity_sql() -> str:
    left, columns = "text", []
    for name, p in _ENTITY:
        columns.append(f"cast(sum(len(regexp_extract_all({left}, '{p}'))) as bigint) as n_{name}")
        left = f"regexp_replace({left}, '{p}', ' ', 'g')"
    return f"select lang, count(*) as texts, {', '.join(columns)} from documents group by lang"


@query(_entity_sql())
def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by class; a class takes its spans before the ones after it, so none is counted twice."""
    left, columns = F.col("text"), []
    for name, p in _ENTITY:
        columns.append(F.sum(F.regexp_count(left, F.lit(p))).alias(f"n_{name}"))
        left = F.regexp_replace(left, p, " ")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("texts"), *columns)


@query(
    f"""{MERGED}, b as (select user_id, min(t_s) as from_s, max(t_s) as to_s from e group by 1), c as (select user_id, sum(least(end_s, to_s) - greatest(start_s, from_s)) / (to_s - from_s) as share from m join b using (user_id) where greatest(start_s, from_s) < least(end_s, to_s) and to_s > from_s group by user_id, from_s, to_s)
  select user_id, round(least(share, 1.0), 6) as share, case when share < 0.45 then 'agent' when share > 0.55 then 'user' else 'mixed' end as class from c"""
)
def session_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered share of a session's time, in three classes."""
    b = events(spark, sf_dir).groupBy("user_id").agg(F.min("t_s").alias("from_s"), F.max("t_s").alias("to_s")).where("to_s > from_s")
    inside = _silences(spark, sf_dir).join(b, "user_id").withColumn("s", F.greatest("start_s", "from_s")).withColumn("e", F.least("end_s", "to_s")).where("s < e")
    c = inside.groupBy("user_id", "from_s", "to_s").agg(F.sum(F.col("e") - F.col("s")).alias("d")).withColumn("share", F.col("d") / (F.col("to_s") - F.col("from_s")))
    return c.select("user_id", F.round(F.least("share", F.lit(1.0)), 6).alias("share"), F.when(F.col("share") < 0.45, "agent").when(F.col("share") > 0.55, "user").otherwise("mixed").alias("class"))


@query(
    """with s as (select distinct user_id from events where event_type = 'purchase' and value > 45), m as (select event_type, user_id in (select user_id from s) as video from events) select event_type, video, count(*) as events from m group by all"""
)
def session_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of sessions that a set of sessions holds, and the others."""
    e = table(spark, sf_dir, "events")
    chosen = e.where("event_type = 'purchase' and value > 45").select("user_id")
    inside = e.join(chosen, "user_id", "left_semi").withColumn("video", F.lit(True))
    outside = e.join(chosen, "user_id", "left_anti").withColumn("video", F.lit(False))
    return inside.union(outside).groupBy("event_type", "video").agg(F.count("*").alias("events"))


@query(
    f"""{WITH_STT}, c as (select provider, mode, case snr_level when 0 then 'silence' when 1 then 'noise' when 2 then 'low_snr' else 'speech' end as condition, edits, reference_length, error from s)
  select provider, mode, condition, count(*) as clips, count(*) filter (where error is not null) as failures, count(*) filter (where error is null and edits >= 3) as fabricated, cast(coalesce(sum(edits) filter (where error is null), 0) as bigint) as inserted from c group by all"""
)
def hallucination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fabricated clips by lane and condition; the condition is read from the clip id's prefix."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("silence-", "noise-", "lowsnr-", "tel8k-", "", "")]), F.col("snr_level").cast("int") + 1)
    runs = R.stt_runs(spark, sf_dir).withColumn("condition", F.coalesce(labels.condition(F.concat(prefix, "clip_id")), F.lit("speech")))
    ok = F.col("error").isNull()
    return runs.groupBy("provider", "mode", "condition").agg(
        F.count("*").alias("clips"), F.count(F.when(~ok, 1)).alias("failures"), F.count(F.when(ok & (F.col("edits") >= 3), 1)).alias("fabricated"), F.coalesce(F.sum(F.when(ok, F.col("edits"))), F.lit(0)).cast("long").alias("inserted")
    )


@query(f"{WITH_STT} select provider, mode, count(*) as clips, count(distinct language) as languages, count(distinct clip_id) as distinct_clips from s group by all")
def lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stt_runs(spark, sf_dir).groupBy("provider", "mode").agg(F.count("*").alias("clips"), F.count_distinct("language").alias("languages"), F.count_distinct("clip_id").alias("distinct_clips"))


# alignments ----------------------------------------------------------------------------------------------------------


def _long_words(tokens: list[str]) -> list[tuple[str, int, int]]:
    """Marks of the query: names of one long word, and of two together."""
    long = [len(t) >= 9 for t in tokens]
    return [("pair", i, i + 2) if long[i] and i + 1 < len(tokens) and long[i + 1] else ("single", i, i + 1) for i in range(len(tokens)) if long[i] and not (i and long[i - 1])]


@query()
def marked_span_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within marked spans of the references, by lane and class; tests/ holds the alignment against word distances."""
    rows = transcripts(spark, sf_dir).select("lane", F.explode(align.marked_errors(_long_words)(X.words(F.col("reference")), X.words(F.col("text")))).alias("s"))
    return rows.groupBy("lane", "s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in align.SCORE.names[1:]])


@query()
def inserted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that lane d has and lane c doesn't, by length."""
    said = transcripts(spark, sf_dir).where("lane in ('c', 'd')").groupBy("clip_id").agg(F.max(F.when(F.col("lane") == "c", F.col("text"))).alias("c"), F.max(F.when(F.col("lane") == "d", F.col("text"))).alias("d"))
    runs = said.select(F.explode(align.alignment(X.words(F.col("c")), X.words(F.col("d")))).alias("s")).where("s.kind = 'insert'")
    return runs.groupBy((F.col("s.hyp_to") - F.col("s.hyp_from")).alias("length")).agg(F.count("*").alias("runs"))


@query()
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments of sessions, short ones merged and long ones split; in hours where recordings have seconds."""
    bounds = events(spark, sf_dir).groupBy("user_id").agg(F.min("t_s").alias("from_s"), F.max("t_s").alias("to_s"))
    gaps = sessions.complement(_silences(spark, sf_dir), bounds, "user_id").select("user_id", (F.col("start_s") / 3600).alias("start_s"), (F.col("end_s") / 3600).alias("end_s"))
    clips = sessions.split_long(sessions.merge_short(gaps, "user_id"))
    return rounded(clips.groupBy("user_id").agg(F.count("*").alias("clips"), F.sum(F.col("end_s") - F.col("start_s")).alias("hours")), 4)
