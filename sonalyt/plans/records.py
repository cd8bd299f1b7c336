"""Queries that choose, parse and join records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import by_character
from ..operators import lanes, ranking, records
from ..sources import runs as R
from .queries import JUDGED, SUMMARY, WITH_STT, WITH_TTS, judged, query, rounded, table

# utterances ------------------------------------------------------------------------------------------------------------

SAID_SQL = """select doc_id, lang, posexplode(split(text, '\\\\.\\\\s')) as (i, said) from {documents}"""
SAID = """with l as (select doc_id, lang, regexp_split_to_array(text, '\\.\\s') as parts from documents), u as (select doc_id, lang, unnest(parts) as said, generate_subscripts(parts, 1) - 1 as i from l)"""
_FIT = "length(trim(said)) >= 12 and not regexp_matches(trim(said), '[\\[\\]♪♫]|https?://')"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents, said at 15 characters a second."""
    return spark.sql(SAID_SQL, documents=table(spark, sf_dir, "documents"))


@query(f"{SAID} select lang, count(*) as sentences, count(*) filter (where length(said) / 15.0 between 3 and 30 and {_FIT}) as kept from u group by lang")
def kept_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    return u.groupBy("lang").agg(F.count("*").alias("sentences"), F.count(F.when(records.kept_utterance(F.col("said"), F.length("said") / 15.0), 1)).alias("kept"))


@query(f"{SAID}, p as (select distinct said from u where length(said) between 60 and 120) select said from p order by md5('5:' || said), said limit 60")
def prompt_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a band of lengths, sampled by a seeded hash."""
    return ranking.sample(utterances(spark, sf_dir).where(F.length("said").between(60, 120)).select("said").distinct(), 60, 5, "said")


@query(
    f"""{SAID}, n as (select *, count(*) over (partition by doc_id) as n from u), k as (select concat('v', doc_id, case when i % 50 = 49 then '-x-' else '-' end, lpad(cast(i as varchar), 5, '0'), '-', lpad(cast(i * 3000 as varchar), 8, '0'), '-', lpad(cast(i * 3000 + length(said) * 7 as varchar), 8, '0')) as utt_id, * from n where n >= 30)
  select concat('v', doc_id) as video, count(*) as candidates, round(sum(length(said) * 7 / 100.0), 2) as seconds, md5(string_agg(utt_id, ',' order by utt_id)) as ids from k where length(said) * 7 / 100.0 between 3 and 30 and {_FIT} group by doc_id"""
)
def shard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of timed keys to text, as subtitle shards hold them, parsed and filtered."""
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    key = F.concat(F.lit("v"), "doc_id", F.when(F.col("i") % 50 == 49, "-x-").otherwise("-"), digits(F.col("i"), 5), F.lit("-"), digits(F.col("i") * 3000, 8), F.lit("-"), digits(F.col("i") * 3000 + F.length("said") * 7, 8))
    shard = utterances(spark, sf_dir).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "said"))).alias("texts")).withColumn("video", F.concat(F.lit("v"), "doc_id"))
    found = records.shard_candidates(shard)
    return rounded(found.groupBy("video").agg(F.count("*").alias("candidates"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"), F.md5(F.array_join(F.array_sort(F.collect_list("utt_id")), ",")).alias("ids")), 2)


@query(
    """with l as (select doc_id, left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 200) as said from documents where doc_id % 7 <> 0 and doc_id % 9 <> 0)
  select concat('u', doc_id) as utt_id, case when doc_id % 4 = 0 then 'ytc' else concat('src', doc_id % 4) end as shard, round(length(said) / 15.0, 4) as end_s, 'CC-BY' as license, round(round(length(said) / 15.0, 4), 2) as duration_s, trim(said) as text
  from l where round(length(said) / 15.0, 4) between 3 and 30 and length(trim(said)) >= 12"""
)
def tolerant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are cut off and some lack a duration; what is left as rows of a manifest."""
    d = table(spark, sf_dir, "documents").withColumn("said", F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 200))
    seconds = F.when(F.col("doc_id") % 9 != 0, F.round(F.length("said") / 15.0, 4))
    line = F.to_json(F.struct(F.concat(F.lit("u"), "doc_id").alias("utt_id"), F.col("said").alias("text"), seconds.alias("duration"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("src"), F.col("doc_id") % 4)).alias("dataset_source")))
    lines = d.select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    rows = records.manifest_rows(records.tolerant_candidates(lines, "ytc").withColumn("source", F.lit("granary")), {"granary": "CC-BY"})
    return rows.select("utt_id", "shard", "end_s", "license", "duration_s", "text")


@query(
    """select concat('clips/', doc_id, '.wav') as clip_path, source as session_id, lang as language, n_chars / 100.0 as duration, case doc_id % 5 when 0 then 'user' when 1 then 'agent' when 2 then 'video' else 'merged' end as source,
  case when doc_id % 3 = 0 then cast(doc_id as double) / 4 else 0.0 end as start_offset from documents where lang in ('en', 'ja') and n_chars / 100.0 between 2 and 30"""
)
def clip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("user"), F.lit("agent"), F.lit("video"), F.lit(None), F.lit("merged")), (F.col("doc_id") % 5 + 1).cast("int"))
    clips = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("clips/"), "doc_id", F.lit(".wav")).alias("clip_path"), F.col("source").alias("session_id"), F.col("lang").alias("language"), (F.col("n_chars") / 100.0).alias("duration"), kind.alias("source"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") / 4).cast("string")).otherwise("unknown").alias("start_offset"),
    )
    return records.clip_candidates(clips)


@query(f"{SUMMARY} select language, provider, round(finalize_s_p50 * 1000, 4) as latency_ms, round(coalesce(nullif(finalize_s_p95, 0), finalize_s_p50) * 1000, 4) as latency_p95_ms, round(error_rate * 100, 4) as error_pct from summary where mode = 'stream' and finalize_s_p50 is not null and error_rate is not null")
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.plot_points(lanes.stt_summary(R.stt_runs(spark, sf_dir)), "stream", "finalize_s"), 4)


@query(f"{WITH_STT} select provider, mode, lower(error) as reason, regexp_matches(lower(error), 'concurren(t|cy)|too many|rate.limit|quota|429|503|temporarily unavailable') as transient, count(*) as clips from (select * replace (case when error is not null and seq % 3 = 0 then 'Too many sessions' else error end as error) from s) where error is not null group by all")
def capacity_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by reason, those that are refusals for lack of capacity told from real ones."""
    runs = R.stt_runs(spark, sf_dir).where("error is not null").withColumn("error", F.when(F.col("seq") % 3 == 0, "Too many sessions").otherwise(F.col("error")))
    return runs.groupBy("provider", "mode", F.lower("error").alias("reason"), L.transient(F.col("error")).alias("transient")).agg(F.count("*").alias("clips"))


@query(
    f"""{WITH_TTS}, p as (select distinct prompt_id, concat('say ', prompt_id) as said from t where chars % 2 = 0), r as (select *, case chars % 3 when 0 then [{{'j': 'stt0', 'h': concat('say ', prompt_id)}}, {{'j': 'stt1', 'h': 'noise'}}] when 1 then [{{'j': 'old', 'h': concat('say ', prompt_id)}}] else [null] end as x from t where error is null and not cold),
  e as (select provider, prompt_id, unnest(x) as e from r) select provider, e.j as judge, count(*) as rows, count(*) filter (where e.h = said) as exact from e join p using (prompt_id) group by all"""
)
def roundtrip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' transcripts of synthesised prompts, in the present form and in that of older records."""
    t = R.tts_runs(spark, sf_dir)
    said = F.concat(F.lit("say "), "prompt_id")
    prompts = t.where("chars % 2 = 0").select("prompt_id", said.alias("text")).distinct()
    entry = lambda judge, heard: F.struct(F.lit(judge).alias("provider"), heard.alias("text"))
    k = F.col("chars") % 3
    runs = t.withColumns({"roundtrip": F.when(k == 0, F.array(entry("stt0", said), entry("stt1", F.lit("noise")))), "roundtrip_provider": F.when(k == 1, "old"), "roundtrip_text": F.when(k == 1, said)})
    rows = records.roundtrip_entries(records.eligible(runs, prompts))
    return rows.groupBy("provider", "judge").agg(F.count("*").alias("rows"), F.count(F.when(F.col("heard") == F.col("said"), 1)).alias("exact"))


# names and replies -------------------------------------------------------------------------------------------------------

_UUID = "concat(substr(md5(cast(doc_id as varchar)), 1, 8), '-', substr(md5(cast(doc_id as varchar)), 9, 4), '-', substr(md5(cast(doc_id as varchar)), 13, 4), '-', substr(md5(cast(doc_id as varchar)), 17, 4), '-', substr(md5(cast(doc_id as varchar)), 21, 12))"


@query(
    f"""with d as (select *, {_UUID} as u from documents) select case when doc_id % 3 = 0 then u else concat('call-', doc_id) end as session_id, concat(case when doc_id % 3 = 0 then concat(u, '-take2') else concat('call-', doc_id, '_merged') end, '.mp4') as filename,
  concat('s3://b/', lang, '/', filename) as uri, n_chars as size from d where doc_id % 10 <> 0"""
)
def listed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storage listing as text: lines without a size or a video are skipped, sessions are read from names."""
    h = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(uuid, F.lit("-take2"))).otherwise(F.concat(F.lit("call-"), "doc_id", F.lit("_merged"))), F.lit(".mp4"))
    line = F.concat_ws("  ", F.when(F.col("doc_id") % 20 == 0, F.lit("TOTAL:")).otherwise(F.col("n_chars").cast("string")), F.lit("2026-01-01T00:00:00Z"), F.concat(F.lit("s3://b/"), "lang", F.lit("/"), F.when(F.col("doc_id") % 20 == 10, "notes.txt").otherwise(name)))
    return records.listed_videos(table(spark, sf_dir, "documents").select(line.alias("value"))).withColumn("size", F.col("size").cast("int"))


@query(
    f"""with d as (select *, {_UUID} as u from documents), f as (select source, concat(source, '-', mode, '-p', doc_id, '-stream-x.wav') as name from d, (values ('batch'), ('stream'), ('other')) as m(mode))
  select case when name like '%-batch-%' or name like '%-stream-%' then case when name like '%-batch-%' then split_part(name, '-batch-', 1) else split_part(name, '-stream-', 1) end else '' end as provider, count(*) as files from f group by all"""
)
def recording_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings counted by the provider that their name begins with."""
    files = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.concat("source", F.lit(f"-{m}-p"), "doc_id", F.lit("-stream-x.wav")) for m in ("batch", "stream", "other")])).alias("name"))
    return files.groupBy(L.provider_of_file(F.col("name")).alias("provider")).agg(F.count("*").alias("files"))


_REPLIES = """case l_orderkey % 6 when 0 then 'The SECOND clip, not the first' when 1 then 'first' when 2 then 'it is a tie.' when 3 then 'neither' when 4 then 'Firstly, second' else 'tied, so first' end"""
_LABELLED = """case l_partkey % 4 when 0 then '{"label": "harmless"}' when 1 then 'Harmless? No: ENTITY damage' when 2 then '{"label": "meaning-changing", "why": "entity"}' else 'clearly meaning-changing, harmless to none' end"""


@query(
    f"""with r as (select {_REPLIES} as reply, {_LABELLED} as told, case when l_suppkey % 2 = 0 then 'gemini-2' else 'gpt-5' end as model from lineitem)
  select nullif(regexp_extract(lower(reply), '\\b(first|second|tie)\\b', 1), '') as verdict, coalesce(case when told like '{{%' then json_extract_string(told, '$.label') end, case when lower(told) like '%entity%' then 'entity' when lower(told) like '%meaning-changing%' then 'meaning-changing' else 'harmless' end) as label,
  case when model like 'gemini%' then 'gemini' else 'openai' end as family, count(*) as replies from r group by all"""
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and labels read from what judges wrote, and the judges' families."""
    r = table(spark, sf_dir, "lineitem").select(F.expr(_REPLIES).alias("reply"), F.expr(_LABELLED).alias("told"), F.when(F.col("l_suppkey") % 2 == 0, "gemini-2").otherwise("gpt-5").alias("model"))
    return r.groupBy(L.verdict(F.col("reply")).alias("verdict"), L.label(F.col("told")).alias("label"), L.family(F.col("model")).alias("family")).agg(F.count("*").alias("replies"))


@query(
    f"""{WITH_STT}, c as (select concat(case snr_level when 0 then 'silence-' when 1 then 'noise-' when 2 then 'trailsil-' when 3 then 'lowsnr-' when 4 then 'tel8k-' else 'snr-05-' end, clip_id) as id from s)
  select case when id like 'silence-%' then 'silence' when id like 'noise-%' then 'noise' when id like 'trailsil-%' then 'trailing_silence' when id like 'lowsnr-%' then 'low_snr' end as condition, id like 'tel8k-%' as telephony, case when id like 'snr%' then -5 end as level, count(*) as clips from c group by all"""
)
def clip_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions, telephony and noise levels that clip ids encode."""
    from ..functions.tags import snr_level

    prefix = F.element_at(F.array(*[F.lit(x) for x in ("silence-", "noise-", "trailsil-", "lowsnr-", "tel8k-", "snr-05-")]), F.col("snr_level").cast("int") + 1)
    ids = R.stt_runs(spark, sf_dir).select(F.concat(prefix, "clip_id").alias("id"))
    return ids.groupBy(L.condition(F.col("id")).alias("condition"), L.telephony(F.col("id")).alias("telephony"), snr_level(F.col("id")).alias("level")).agg(F.count("*").alias("clips"))


@query("select lang, count(*) as texts, cast(sum(case when lang in ('ja', 'zh', 'fr') then length(regexp_replace(text, '\\s', '', 'g')) else len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) end) as bigint) as units from documents group by lang")
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of texts as they are: words, or characters for languages counted so (French among them here)."""
    by = by_character(F.col("lang")) | (F.col("lang") == "fr")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("texts"), F.sum(L.unit_count(F.col("text"), by)).alias("units"))


@query(f"{SUMMARY} select provider, mode, language, coalesce(printf('%.3f', round(error_rate, 9)), '—') as error_rate, coalesce(printf('%.1fs', round(finalize_s_p95, 9)), '—') as finalize from summary")
def display_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lanes.stt_summary(R.stt_runs(spark, sf_dir))
    return s.select("provider", "mode", "language", L.cell(F.round("error_rate", 9)).alias("error_rate"), L.cell(F.round("finalize_s_p95", 9), 1, "s").alias("finalize"))


# joins and caches ----------------------------------------------------------------------------------------------------------

_ANNOTATED = """select provider, clip_id, language, seq, concat('ref ', cast(cast(substr(clip_id, 5) as int) % 7 as string), case when seq % 5 = 0 then '  x' when seq % 5 = 1 then ' y' else ' x' end) as reference,
  case when seq % 4 = 0 then concat('ref <number>', cast(cast(substr(clip_id, 5) as int) % 7 as string), '</number> ', case when seq % 5 = 1 then 'y' else 'x' end) else '' end as annotated from s"""


@query(
    f"""{WITH_STT}, a as ({_ANNOTATED}), k as (select language, clip_id, arg_max(reference, seq) as r, arg_max(annotated, seq) as t from a where annotated <> '' group by all)
  select provider, count(*) as rows, count(*) filter (where annotated <> '') as own, count(*) filter (where annotated = '' and regexp_replace(trim(r), '\\s+', ' ', 'g') = regexp_replace(trim(reference), '\\s+', ' ', 'g')) as shared from a left join k using (language, clip_id) group by provider"""
)
def propagated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that a lane lacks, taken from the last lane that has them for the clip and the same text."""
    a = spark.sql(_ANNOTATED.replace("from s", "from {s}"), s=R.stt_runs(spark, sf_dir))
    both = records.propagated(a.withColumn("own", F.col("annotated") != ""))
    return both.groupBy("provider").agg(F.count("*").alias("rows"), F.count(F.when(F.col("own"), 1)).alias("own"), F.count(F.when(~F.col("own") & F.col("annotated").isNotNull(), 1)).alias("shared"))


@query(
    f"""{WITH_STT}, a as ({_ANNOTATED}), g as (select distinct language, clip_id, concat('ref  ', cast(substr(clip_id, 5) as int) % 7, ' x') as t from a where language <> 'ja-JP')
  select a.language, count(*) as rows, count(*) filter (where regexp_replace(t, '\\s+', ' ', 'g') = regexp_replace(trim(reference), '\\s+', ' ', 'g')) as gold from a left join g using (language, clip_id) group by all"""
)
def gold_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations by hand, joined where they are of the same text."""
    a = spark.sql(_ANNOTATED.replace("from s", "from {s}"), s=R.stt_runs(spark, sf_dir))
    text = F.concat(F.lit("ref  "), F.substring("clip_id", 5, 9).cast("int") % 7, F.lit(" x"))
    gold = a.where("language != 'ja-JP'").select("language", "clip_id", text.alias("text")).distinct().withColumn("annotated", F.lit("<number>"))
    return records.with_gold(a, gold).groupBy("language").agg(F.count("*").alias("rows"), F.count("gold").alias("gold"))


@query(
    f"""{WITH_STT}, t as (select clip_id, min(case cast(substr(clip_id, 5) as int) % 3 when 0 then 'number' when 1 then 'name' else 'date' end) as entity from s where cast(substr(clip_id, 5) as int) % 5 <> 0 group by 1)
  select provider, entity, count(*) as scorable, count(*) filter (where error is null and edits = 0) as correct, count(error) as failures, round(avg(case when error is null and edits = 0 then 1.0 else 0.0 end), 6) as success from s join t using (clip_id) group by all"""
)
def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a dialogue's turns of which a lane got the slot right; failures count as wrong."""
    runs = R.stt_runs(spark, sf_dir)
    n = F.substring("clip_id", 5, 9).cast("int")
    turns = runs.select("clip_id", F.element_at(F.array(F.lit("number"), F.lit("name"), F.lit("date")), n % 3 + 1).alias("entity")).where(n % 5 != 0).distinct()
    return rounded(records.task_success(turns, runs.select("provider", "clip_id", "error", "edits"), F.col("edits") == 0))


@query(
    f"""{WITH_TTS}, p as (select distinct prompt_id from t), y as (select distinct provider as system from t), m as (select distinct prompt_id, provider as system from t where load_n = 1), a as (select p.prompt_id, x.system as first, z.system as second, k.aspect from p, y x, y z, (values ('clear'), ('natural')) k(aspect) where x.system <> z.system)
  select prompt_id, aspect, first, second from a where not exists (select 1 from m where m.prompt_id = a.prompt_id and m.system = a.first and right(m.prompt_id, 1) = '7') and not exists (select 1 from m where m.prompt_id = a.prompt_id and m.system = a.second and right(m.prompt_id, 1) = '7')"""
)
def arena_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a panel of judges is asked of each prompt; systems without a recording are left out of it."""
    t = R.tts_runs(spark, sf_dir)
    missing = t.where("load_n = 1 and prompt_id like '%7'").select("prompt_id", F.col("provider").alias("system")).distinct()
    return records.arena_pairs(t.select("prompt_id").distinct(), t.select(F.col("provider").alias("system")), ["clear", "natural"], missing)


@query(
    f"""{JUDGED}, i as (select provider, clip_id, mode, max(label) as label, min(edits) as edits from j group by all), k as (select sha256(concat('["', provider, '","', clip_id, '","', mode, '"]')) as key, * from i), c as (select key from k where edits % 3 = 0)
  select provider, count(*) as wanted, count(*) filter (where key not in (select key from c)) as misses, min(key) as least from k group by provider"""
)
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements that a cache by content lacks."""
    items = judged(spark, sf_dir).groupBy("provider", "clip_id", "mode").agg(F.max("label").alias("label"), F.min("edits").alias("edits"))
    wanted = items.withColumn("key", L.cache_key(F.col("provider"), F.col("clip_id"), F.col("mode")))
    entries = wanted.where("edits % 3 = 0").select("key", "label", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    missed = records.cache_misses(wanted, records.cached(entries, "key", "at"), "key").groupBy("provider").agg(F.count("*").alias("misses"))
    return wanted.groupBy("provider").agg(F.count("*").alias("wanted"), F.min("key").alias("least")).join(missed, "provider", "left").withColumn("misses", F.coalesce("misses", F.lit(0)))


@query(f"{SAID}, g as (select concat(doc_id, '-', i) as utt_id, lang as subset, concat('shard', doc_id % 20) as shard, i * 30.0 as start_s, i * 30.0 + length(said) / 15.0 as end_s, i from u) select subset, shard, count(*) as segments, min(start_s) as from_s, round(max(end_s), 4) as to_s from g where i % 3 <> 0 group by all")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards to read for segments that a cache lacks."""
    u = utterances(spark, sf_dir)
    g = u.select(F.concat_ws("-", "doc_id", "i").alias("utt_id"), F.col("lang").alias("subset"), F.concat(F.lit("shard"), F.col("doc_id") % 20).alias("shard"), (F.col("i") * 30.0).alias("start_s"), (F.col("i") * 30.0 + F.length("said") / 15.0).alias("end_s"), "i")
    return rounded(records.fetch_plan(g, g.where("i % 3 = 0").select("utt_id")), 4)


# spend, panels, rates --------------------------------------------------------------------------------------------------------


@query(
    f"""{JUDGED} select provider, mode, judge as language, count(*) as clips, cast(sum(edits // 3 + edits % 3 + edits // 4) as bigint) as semantic_errors, cast(sum(reference_length) as bigint) as semantic_units, round(sum(edits) / nullif(sum(reference_length), 0), 6) as plain_rate,
  round(sum(edits // 3 + edits % 3 + edits // 4) / nullif(sum(reference_length), 0), 6) as semantic_rate, 'WER' as metric from j group by all"""
)
def semantic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that change the meaning beside plain ones, over the same clips."""
    v = judged(spark, sf_dir).select("provider", "mode", F.col("judge").alias("language"), F.expr("edits div 3").alias("substitutions"), F.expr("edits % 3").alias("deletions"), F.expr("edits div 4").alias("insertions"), F.col("reference_length").alias("reference_units"), "edits", "reference_length")
    return rounded(records.semantic_rates(v, by_character(F.col("language"))))


@query()
def kappa_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of judges' labels with people's, with an interval; tests/ holds kappa against rater_kappa and the interval against plain resampling."""
    j = judged(spark, sf_dir).groupBy("provider", "clip_id").agg(F.min("label").alias("judge"), F.max("label").alias("human"))
    return rounded(ranking.kappa_interval(j, "human", "judge"), 4)


@query("with v as (select concat('r', l_suppkey % 4) as rater from lineitem), p as (select rater, count(*) as n from v group by 1) select count(*) as raters, min(n) as fewest, count(*) >= 2 and min(n) >= 100 as ok from p")
def panel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.panel_ok(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey") % 4).alias("rater")))


_CALLS = """select case when l_suppkey % 2 = 0 then 'gemini-2' else 'gpt-5' end as model, case when l_linenumber = 1 then 'cached' when l_linenumber = 7 then 'error' else 'live' end as kind, cast(l_quantity * 10 as bigint) as prompt_tokens, cast(l_quantity as bigint) as output_tokens from lineitem"""


@query(
    f"""with c as ({_CALLS}) select model, count(*) filter (where kind = 'live') as live_calls, count(*) filter (where kind = 'cached') as cached_calls, count(*) filter (where kind = 'error') as error_calls,
  round(coalesce(sum(prompt_tokens * case when model = 'gpt-5' then 10.0 else 1.0 end + output_tokens * case when model = 'gpt-5' then 20.0 else 2.5 end) filter (where kind = 'live'), 0) / 1e6, 6) as est_usd from c group by model"""
)
def token_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.sql(_CALLS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return rounded(records.spent(calls, {"gemini": (1.0, 2.5), "openai": (10.0, 20.0)}, L.family(F.col("model"))))


@query(f"{WITH_STT}, l as (select provider, count(distinct clip_id) as clips, avg(audio_s) as mean_s from s group by 1) select provider, clips, round(clips * 6 * mean_s / 3600 * 0.5, 6) as usd from l")
def matrix_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lane costs over all noise levels, held to a cap."""
    lane = R.stt_runs(spark, sf_dir).groupBy("provider").agg(F.count_distinct("clip_id").alias("clips"), F.avg("audio_s").alias("mean_s"))
    return rounded(records.within_cap(lane.select("provider", "clips", records.matrix_cost(F.col("clips"), F.col("mean_s"), F.lit(0.5)).alias("usd")), 1e6))


@query(
    """with d as (select source as session, concat('room', doc_id % 3) as room, list(concat('/in/', source, '/call-', doc_id, '_merged.wav') order by doc_id) as files from documents group by all), f as (select session, room, unnest(files) as path from d)
  select session, room, split_part(path, '/', 4) as filename, regexp_replace(regexp_replace(split_part(path, '/', 4), '\\.wav$', ''), '_merged$', '') as session_id from f"""
)
def join_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested manifests of rooms as a row a file."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.concat(F.lit("room"), F.col("doc_id") % 3).alias("room"), F.concat(F.lit("/in/"), "source", F.lit("/call-"), "doc_id", F.lit("_merged.wav")).alias("path"))
    return records.join_file(d.groupBy("session", "room").agg(F.collect_list("path").alias("files")))
