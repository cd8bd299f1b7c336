"""Queries that keep what can be judged, and summaries by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judging, lanes, ranking, recordings, transcripts
from ..sources import runs as R
from .queries import ORACLE_SQL, QUERIES, VERDICTS, WITH_STT, query, rounded, table, verdicts

_REFERENCE = "case l_n when 0 then null when 1 then '  ' else concat('ref ', clip_id) end"


@query(f"{WITH_STT}, r as (select *, {_REFERENCE.replace('l_n', 'cast(substr(clip_id, 5) as int) % 6')} as reference from s), k as (select *, row_number() over (partition by provider, mode, clip_id order by seq desc) as n from r where error is null and gold_status <> 'unverified' and trim(coalesce(reference, '')) <> '') select provider, mode, clip_id, seq from k where n = 1")
def judgeable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each lane's clip that has a checked reference and no error."""
    runs = R.stt_runs(spark, sf_dir).withColumn("l_n", F.substring("clip_id", 5, 9).cast("int") % 6).withColumn("reference", F.expr(_REFERENCE))
    return lanes.judgeable(runs, ["seq"]).select("provider", "mode", "clip_id", "seq")


_LEVELS = "case when snr_level = 5 then concat('tel8k-', clip_id) when snr_level = 4 then clip_id else concat('snr', case when snr_level = 0 then '-' else '+' end, lpad(cast(5 * abs(snr_level - 1) as string), 2, '0'), '-', clip_id) end"


@query(
    f"""{WITH_STT}, c as (select *, {_LEVELS.replace("as string", "as varchar")} as id, edits % 3 as sub, edits % 2 as del, edits // 2 as ins from s), r as (select provider, mode, language, error, finalize_s, sub + del + ins as e, reference_length as n, starts_with(id, 'tel8k-') as line, case when starts_with(id, 'snr') then cast(substr(id, 4, 3) as int) end as level from c),
  l as (select provider, mode, language, level, sum(e) filter (where error is null) / nullif(sum(n) filter (where error is null), 0) as rate, quantile_cont(finalize_s, 0.5) filter (where error is null) as p50, count(error) as failures from r where level is not null group by all),
  a as (select *, (rate + lead(rate) over w) / 2 * (lead(level) over w - level) as area from l where rate is not null window w as (partition by provider, mode, language order by level)),
  t as (select provider, mode, language, count(*) as line_clips, sum(e) filter (where error is null) / nullif(sum(n) filter (where error is null), 0) as line_rate from r where line group by all),
  x as (select provider, mode, language, sum(failures) as failures, arg_min(p50, level) - arg_max(p50, level) as change from l group by all), y as (select provider, mode, language, count(*) as levels, case when count(*) >= 2 then sum(area) / (max(level) - min(level)) end as auc from a group by all),
  k as (select distinct provider, mode, language from r where line or level is not null)
  select provider, mode, language, cast(coalesce(failures, 0) as bigint) as failures, round(change, 6) as finalize_change_s, coalesce(levels, 0) as levels, round(auc, 6) as auc, coalesce(line_clips, 0) as line_clips, round(line_rate, 6) as line_error_rate from k left join x using (provider, mode, language) left join y using (provider, mode, language) left join t using (provider, mode, language)"""
)
def snr_and_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise levels and the telephone line, told by clip ids, from edits by kind."""
    runs = R.stt_runs(spark, sf_dir).withColumns({"substitutions": F.col("edits") % 3, "deletions": F.col("edits") % 2, "insertions": F.floor(F.col("edits") / 2), "clip_id": F.expr(_LEVELS)})
    return rounded(lanes.snr_summary(runs))


@query(
    """with l as (select doc_id, case when doc_id % 4 = 0 then 'ja-JP' else lang end as language, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents), t as (select language, doc_id, place, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from l),
  k as (select *, row_number() over (partition by language, line order by doc_id, place) as n from t where case when language = 'ja-JP' then length(replace(line, ' ', '')) between 8 and 100 else len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) between 4 and 40 end)
  select language, count(*) as sentences, cast(sum(doc_id) as bigint) as first_docs from k where n = 1 group by language"""
)
def kept_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of fitting length in words or characters, each from the first document that has it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.expr("case when doc_id % 4 = 0 then 'ja-JP' else lang end").alias("language"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kept = transcripts.kept_sentences(lines, "line", ["doc_id", "at"])
    return kept.groupBy("language").agg(F.count("*").alias("sentences"), F.sum("doc_id").alias("first_docs"))


@query(f"select count(*) as pairs, round(avg(observed), 5) as observed, round(avg(kappa), 5) as kappa from ({ORACLE_SQL['rater_kappa']})")
def mean_rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over pairs of raters."""
    return rounded(ranking.mean_agreement(QUERIES["rater_kappa"](spark, sf_dir)), 5)


@query(f"{VERDICTS}, c as (select aspect, prompt_id, least(first, second) as a, greatest(first, second) as b, case when count(winner) >= 2 and count(distinct winner) = 1 then max(winner) end as outcome from v group by 1, 2, 3, 4) select count(*) as keys, cast(0 as bigint) as one_sided, count(outcome) as compared, count(outcome) filter (where aspect = 'O' or outcome <> 'tie') as agree from c")
def gate_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes against another panel's of the same pairs; pairs that only one panel has would fail the job."""
    own = judging.consensus(verdicts(spark, sf_dir))
    other = own.withColumn("outcome", F.when((F.col("outcome") == "tie") & (F.col("aspect") != "O"), F.lit("sys0")).otherwise(F.col("outcome")))
    return judging.compared_in_full(own, other, ["aspect", "prompt_id", "a", "b"], "outcome")


@query("select doc_id, 2 * strlen(text) + 25600 as bytes, md5(hex(encode(text)) || repeat('0000', 12800) || hex(encode(text))) as digest from documents")
def paired_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings with a pause between, as judges hear them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm")).withColumn("both", recordings.pair_audio("pcm", "pcm", 16_000))
    return docs.select("doc_id", F.octet_length("both").cast("long").alias("bytes"), F.md5(F.hex("both").cast("binary")).alias("digest"))
