"""Queries from texts to lane tables: normal forms, tokens, edits, fabrications, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..operators import transcripts as T
from .queries import query, rounded, table

#: users' turns as clips in three languages and without one; lanes drop, change and swap words, and write numbers that the references say in words
_TURNS = """select concat(cast(conv_id as string), '-', cast(turn as string)) as clip_id, conv_id, turn, case conv_id % 4 when 0 then 'nl-NL' when 1 then 'ja-JP' when 2 then 'en-US' end as language,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' '{g}), ' +', ' '{g})) as core from {conversations} where role = 'user'"""
_WORDS = "concat(' ', regexp_replace(core, ' ', '  '{g}), ' ')"
_TIDY = "trim(regexp_replace({x}, ' +', ' '{g}))"
_DROPPED = "regexp_replace({x}, ' (the|de|les|la|der) ', ' '{g})"
_CHANGED = "regexp_replace({x}, ' (and|et|und|y|in) ', ' zz '{g})"
_SWAPPED = "regexp_replace({x}, ' ([a-z])([a-z]+)  ([a-z]+) ', ' {three} {one}{two} '{g})"
_DIGITS, _SPOKEN = "case when language = 'en-US' then '21 ' else '' end", "case when language = 'en-US' then 'twenty one ' else '' end"


def _lanes(g: str, conversations: str, groups: tuple[str, str, str], spoken: str) -> str:
    """g: the flag that replaces all, for engines that need it; groups: how a replacement names groups; spoken: how references say a number."""
    one, two, three = groups

    def lane(*changes: str) -> str:
        x = _WORDS
        for change in changes:
            x = change.replace("{x}", x)
        return _TIDY.replace("{x}", x).format(g=g, one=one, two=two, three=three)

    turns = _TURNS.format(g=g, conversations=conversations)
    return f"""with u as (select distinct * from ({turns})), t as (select *, trim(concat({spoken}, core)) as reference from u), h as (select 'a' as lane, t.*, reference as text from t
  union all select 'b', t.*, trim(concat({_DIGITS}, {lane(_DROPPED, _CHANGED)})) from t union all select 'c', t.*, trim(concat({_DIGITS}, {lane(_CHANGED, _SWAPPED)})) from t
  union all select 'd', t.*, trim(concat(reference, case when turn % 3 = 0 then ' 707 707 707 707 707 707' else ' 707' end)) from t)"""


#: in SQL the references have their normal form
HEARD = _lanes(", 'g'", "conversations", ("\\1", "\\2", "\\3"), _DIGITS)


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _lanes("", "{conversations}", ("$1", "$2", "$3"), _SPOKEN)
    return spark.sql(f"{sql} select *, 'stream' as mode, lane as provider, case when (conv_id + turn) % 5 = 1 then 'server error' end as error, cast(4 as double) as audio_s, turn as seq from h", conversations=table(spark, sf_dir, "conversations"))


def _list(column: str) -> str:
    return f"case when language = 'ja-JP' then list_filter(string_split({column}, ''), lambda w: trim(w) <> '') else list_filter(string_split({column}, ' '), lambda w: w <> '') end"


def _coded(r: str, h: str) -> str:
    """A list of words as a text of ASCII signs, one for each different word of the pair; DuckDB's levenshtein compares bytes. Up to 94 words differ."""
    return f"array_to_string(list_transform({r}, lambda w: chr(cast(32 + list_position(list_distinct(list_concat({r}, {h})), w) as integer))), '')"


def distance(r: str, h: str) -> str:
    return f"case when {r} = {h} then 0 else levenshtein({_coded(r, h)}, {_coded(h, r).replace(f'list_concat({h}, {r})', f'list_concat({r}, {h})')}) end"


#: parts of a number: cost, order of preference (0 match or substitution, 1 deletion, 2 insertion), substitutions, deletions, insertions
_COST, _ORDER, _S, _D, _N = 2**45, 2**43, 2**28, 2**14, 1


def kinds(r: str, h: str) -> str:
    """The last cell of the table of least-cost alignments, worked out row by row: cost, then order, choose; counts go along."""
    start = f"list_transform(range(0, len({h}) + 1), lambda q: cast(q * {_COST + _N} as bigint))"
    diagonal = f"acc[j[1]] + case when {h}[j[1]] = {r}[i[1]] then 0 else {_COST + _S} end"
    cell = f"least({diagonal}, acc[j[1] + 1] + {_COST + _ORDER + _D}, row[j[1]] + {_COST + 2 * _ORDER + _N})"
    chosen = f"({cell}) - (({cell} // {_ORDER}) % 4) * {_ORDER}"
    places = f"list_transform(range(1, len({h}) + 1), lambda q: [cast(q as bigint)])"
    row = f"list_reduce(list_prepend([cast(i[1] * {_COST + _D} as bigint)], {places}), lambda row, j: list_append(row, {chosen}))"
    return f"list_extract(list_reduce(list_prepend({start}, list_transform(range(1, len({r}) + 1), lambda q: [cast(q as bigint)])), lambda acc, i: {row}), len({h}) + 1)"


def _size(column: str) -> str:
    """Tokens of cleaned text: letters for ja-JP, else words."""
    return f"case when language = 'ja-JP' then length(replace({column}, ' ', '')) else len(list_filter(string_split({column}, ' '), lambda w: w <> '')) end"


_FAILED = "(conv_id + turn) % 5 = 1"


@query(
    f"""{HEARD}, w as (select *, {_list("reference")} as r, {_list("text")} as s from h where language is not null),
  x as (select lane as provider, 'stream' as mode, language, case when not {_FAILED} then {distance("r", "s")} end as e, case when not {_FAILED} then len(r) end as n, {_FAILED} as failed from w)
  select provider, mode, language, count(*) as clips, count(*) filter (where failed) as failures, cast(coalesce(sum(e), 0) as bigint) as errors, cast(coalesce(sum(n), 0) as bigint) as reference_length, round(sum(e) / nullif(sum(n), 0), 6) as error_rate, case when language = 'ja-JP' then 'CER' else 'WER' end as metric from x group by all"""
)
def text_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates from texts: normal forms, words or characters, edits, pooled by lane and language."""
    return rounded(T.accuracy(heard(spark, sf_dir).where("language is not null")))


@query(
    f"""{HEARD}, w as (select lane as provider, 'stream' as mode, language, {_list("reference")} as r, {_list("text")} as s from h where not {_FAILED} and language in ('nl-NL', 'en-US')), k as (select provider, mode, language, len(r) as n, {kinds("r", "s")} as c from w)
  select provider, mode, language, count(*) as clips, cast(sum((c // {_S}) % 16384) as bigint) as substitutions, cast(sum((c // {_D}) % 16384) as bigint) as deletions, cast(sum(c % 16384) as bigint) as insertions, cast(sum(n) as bigint) as reference_length from k group by all"""
)
def edit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions of least-cost alignments, by lane and language."""
    return T.edit_kinds(heard(spark, sf_dir).where("error is null and language in ('nl-NL', 'en-US')"))


@query(
    f"""{HEARD}, x as (select *, turn % 7 = 2 as silent, concat(case turn % 4 when 1 then 'noise-' when 3 then 'lowsnr-' else '' end, clip_id) as id, {_FAILED} as failed from h where language is not null and lane in ('a', 'd')),
  y as (select *, case when silent then {_size("text")} when lane = 'd' then {_size("text")} - {_size("reference")} else 0 end as added from x),
  z as (select lane as provider, 'stream' as mode, language, case when id like 'noise-%' then 'noise' when id like 'lowsnr-%' then 'low_snr' when silent or reference = '' then 'no_speech' else 'speech' end as condition, failed, added, lane, turn, silent, text, reference from y)
  select provider, mode, language, condition, count(*) as clips, count(*) filter (where failed) as failures, count(*) filter (where not failed and added >= 3) as fabricated_clips, cast(coalesce(sum(added) filter (where not failed), 0) as bigint) as inserted_words,
  count(*) filter (where not failed and (silent or reference = '') and text <> '') as phantom_finals, count(*) filter (where not failed and (silent or reference = '') and text <> '') as phantom_final_clips, round(sum(4.0) filter (where not failed), 4) as audio_s,
  round(count(*) filter (where not failed and added >= 3) / nullif(count(*) filter (where not failed), 0), 6) as fabrication_rate, round(coalesce(sum(added) filter (where not failed), 0) / nullif(sum(4.0) filter (where not failed) / 60, 0), 4) as inserted_a_minute from z group by all"""
)
def text_hallucinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted phrases and finals on clips without speech, by condition; loops are looped_texts' own."""
    rows = heard(spark, sf_dir).where("language is not null and lane in ('a', 'd')")
    event = F.struct(F.lit(1.0).alias("t_s"), F.col("text"), F.lit(True).alias("is_final"), F.lit("text").alias("kind"))
    prefix = F.when(F.col("turn") % 4 == 1, "noise-").when(F.col("turn") % 4 == 3, "lowsnr-").otherwise("")
    rows = rows.withColumns({"reference": F.when(F.col("turn") % 7 != 2, F.col("reference")), "clip_id": F.concat(prefix, "clip_id"), "events": F.array(event)})
    told = T.hallucinations(rows).withColumns({"fabrication_rate": F.round("fabrication_rate", 6), "inserted_a_minute": F.round("inserted_a_minute", 4)})
    return told.drop("looped_clips", "loop_rate")


_REPEATS = " or ".join(
    f"regexp_matches(array_to_string(list_transform(range(1, greatest(len(w) - {n} + 1, 1)), lambda i: case when w[i] = w[i + {n}] then '1' else '0' end), ''), '1{{{n * (max(3, -(-6 // n)) - 1)}}}')" for n in range(1, 6)
)


@query(f"{HEARD}, x as (select lane, turn % 3 = 0 as long, list_filter(string_split(text, ' '), lambda w: w <> '') as w from h where language = 'nl-NL') select lane, long, count(*) as clips, count(*) filter (where {_REPEATS}) as looped from x group by all")
def looped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that say the same again and again."""
    rows = heard(spark, sf_dir).where("language = 'nl-NL'")
    tokens = languages.tokens(languages.normalize(F.col("text"), F.col("language")), F.col("language"))
    return rows.groupBy("lane", (F.col("turn") % 3 == 0).alias("long")).agg(F.count("*").alias("clips"), F.count(F.when(T.looping(tokens, F.col("language")), 1)).alias("looped"))


@query(
    f"""{HEARD}, v as (select *, {_list("text")} as w, coalesce(language, 'und') as l from h where not {_FAILED} and text <> '' and lane in ('a', 'b', 'c')),
  p as (select x.lane as lane_a, y.lane as lane_b, x.l as language, count(*) as clips, cast(sum({distance("x.w", "y.w")}) as bigint) as edits, cast(sum(len(x.w) + len(y.w)) as bigint) as tokens from v x join v y on x.clip_id = y.clip_id and x.lane < y.lane
    group by grouping sets ((x.lane, y.lane, x.l), (x.lane, y.lane)))
  select * replace (coalesce(language, 'all') as language), round(2 * edits / nullif(tokens, 0), 6) as disagreement from p"""
)
def text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement of lanes by language and over all, in words or characters, without a reference."""
    return rounded(T.agreement(heard(spark, sf_dir).where("lane in ('a', 'b', 'c')").drop("provider", "mode")))


@query(
    """with n as (select distinct cast(l_quantity as int) + k as n from lineitem, (values (-1), (49)) as v(k)) select n, l as language, cast(n as varchar) as normal from n, (values ('en'), ('de'), ('fr'), ('es')) as w(l) where n < 100"""
)
def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in words of four languages, brought to digits."""
    words = F.create_map(*[x for k in languages.RULES for n in range(100) for x in (F.lit(f"{k}{n}"), F.lit(languages.spell(n, k)))])
    n = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.col("l_quantity").cast("int") - 1, F.col("l_quantity").cast("int") + 49)).alias("n")).distinct().where("n < 100")
    told = n.select("n", F.explode(F.array(*map(F.lit, languages.RULES))).alias("language")).withColumn("said", F.element_at(words, F.concat("language", "n")))
    return told.select("n", "language", languages.normalize(F.col("said"), F.col("language")).alias("normal"))
