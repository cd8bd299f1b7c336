"""Queries that write what a tool would leave, and read it back as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus as C
from ..sources.folders import new_path
from .queries import query, rounded, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("select doc_id as clip_id, text as reference, 'xx-XX' as language from documents order by md5('9:' || doc_id), doc_id limit 50")
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet corpus read by its columns, and a seeded sample of it."""
    return C.select_rows(C.read_corpus(spark, f"{sf_dir}/documents.parquet", {"clip_id": "doc_id", "reference": "text"}, "xx-XX"), "clip_id", 50, 9)


@query(
    """select case when doc_id % 2 = 0 then concat('id', doc_id) else concat('clip.', doc_id) end as clip_id, case when doc_id % 3 = 0 then concat('/abs/clip.', doc_id, '.wav') else concat('/base/sub/clip.', doc_id, '.wav') end as audio,
  left(text, 40) as reference, coalesce(case when doc_id % 5 <> 0 then lang end, 'en-US') as language from documents"""
)
def manifest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of JSON lines: ids from file names, relative paths."""
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "/abs/clip.").otherwise("sub/clip."), "doc_id", F.lit(".wav"))
    path = new_path(spark, "manifest")
    C.write_lines(documents(spark, sf_dir).select(name.alias("audio"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("id"), "doc_id")).alias("id"), F.substring("text", 1, 40).alias("text"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("language")), path)
    if C.manifest_shape(spark, path) != "plain":
        raise ValueError(f"{path} isn't what was written")
    return C.read_manifest(spark, path, "/base")


@query(
    """with d as (select *, doc_id % 4 <> 0 as fetchable, doc_id * 2.0 as s, doc_id * 2.0 + 5 as e from documents) select fetchable, lang as subset, count(*) as rows, round(sum(s), 2) as from_s, round(sum(e), 2) as to_s from d group by all"""
)
def curated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated manifest, of which some sources can't be fetched and some rows have their times in the id alone."""
    start = F.col("doc_id") * 2.0
    coded = F.concat(F.lit("v"), "doc_id", F.lit("-00000-"), F.format_string("%08d", (start * 100).cast("long")), F.lit("-"), F.format_string("%08d", ((start + 5) * 100).cast("long")))  # longer times keep all their digits
    rows = documents(spark, sf_dir).select(
        F.when(F.col("doc_id") % 4 == 0, "elsewhere").otherwise("yodas2").alias("source"), F.col("lang").alias("subset"), F.lit("00000000").alias("shard"), coded.alias("utt_id"), F.substring("text", 1, 20).alias("text"),
        F.when(F.col("doc_id") % 3 == 0, start).alias("start_s"), F.when(F.col("doc_id") % 3 == 0, start + 5).alias("end_s"),
    )
    path = new_path(spark, "curated")
    C.write_lines(rows, path)
    kept, skipped = C.read_curated(spark, path, ("yodas2",))
    both = kept.withColumn("fetchable", F.lit(True)).unionByName(skipped.withColumn("fetchable", F.lit(False)))
    return rounded(both.groupBy("fetchable", "subset").agg(F.count("*").alias("rows"), F.sum("start_s").alias("from_s"), F.sum("end_s").alias("to_s")), 2)


@query("select concat('c', doc_id) as clip_id, concat('/in/c', doc_id, '.wav') as clip, source as session_id, lang as language, n_chars / 15.0 as duration_s, cast(null as varchar) as reference from documents")
def real_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of real sessions' clips, whose measured lengths are within its tolerance."""
    path = new_path(spark, "realdata")
    length = F.col("n_chars") / 15.0
    C.write_lines(documents(spark, sf_dir).select(F.concat(F.lit("/in/c"), "doc_id", F.lit(".wav")).alias("clip"), F.col("source").alias("session_id"), F.col("lang").alias("language"), length.alias("duration_s"), (length * 1.015).alias("measured_s")), path)
    return C.read_realdata(spark, path)


@query("with x as (select source, unnest(string_split(text, chr(10))) as line from documents) select source, count(*) as prompts, cast(sum(length(trim(line))) as bigint) as characters, true as told_apart from x where trim(line) <> '' group by source")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of text files, told apart by file and number of the line; documents are written as the files of their source."""
    path = new_path(spark, "prompts")
    documents(spark, sf_dir).select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    prompts = C.read_prompts(spark, f"{path}/*").groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("prompt_id").alias("ids"), F.sum(F.length("text")).alias("characters"))
    return prompts.groupBy(F.regexp_extract("file", "source=([^/]*)/", 1).alias("source")).agg(F.sum("n").alias("prompts"), F.sum("characters").alias("characters"), F.bool_and(F.col("n") == F.col("ids")).alias("told_apart"))


_VOTE = """select concat('r', l_suppkey % 4) as rater, concat('p', l_partkey % 60) as prompt_id, 'sys0' as first, 'sys1' as second, case l_returnflag when 'A' then 'first' when 'N' then 'second' else 'tie' end as winner from lineitem"""


@query(f"with v as ({_VOTE}) select rater, winner, count(*) as votes, count(distinct prompt_id) as prompts from v group by all")
def panel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "votes")
    C.write_lines(spark.sql(_VOTE.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem")), path)
    return C.read_votes(spark, path).groupBy("rater", "winner").agg(F.count("*").alias("votes"), F.count_distinct("prompt_id").alias("prompts"))


@query("select label, source as provider, count(*) as clips from (select *, case doc_id % 3 when 0 then 'entity' when 1 then 'meaning-changing' else 'harmless' end as label from documents) group by all")
def anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by people as CSV, by label and provider."""
    labels = ("entity", "meaning-changing", "harmless")
    path = new_path(spark, "anchor")
    rows = documents(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("clip_id"), F.col("source").alias("provider"), F.element_at(F.array(*map(F.lit, labels)), (F.col("doc_id") % 3 + 1).cast("int")).alias("label"))
    rows.write.option("header", True).csv(path)
    return C.read_anchor(spark, path, labels).groupBy("label", "provider").agg(F.count("*").alias("clips"))


@query("select lang, count(*) as rows, count(*) as open from documents where n_chars between 100 and 2000 group by lang")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for people: rows whose transcripts are still to be written."""
    path = new_path(spark, "sheet")
    C.write_review_sheet(documents(spark, sf_dir).where("n_chars between 100 and 2000").select("doc_id", "lang"), path)
    sheet = spark.read.option("header", True).csv(path)
    return sheet.groupBy("lang").agg(F.count("*").alias("rows"), F.count(F.when(F.coalesce("transcript", F.lit("")) == "", 1)).alias("open"))


@query("with n as (select concat('tts', l_suppkey % 5) as provider, avg(l_discount * 10) as mean from lineitem group by 1) select provider, round(mean, 6) as mean from n")
def stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores kept as the baseline of the next run."""
    path = new_path(spark, "baseline")
    C.write_lines(table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("tts"), F.col("l_suppkey") % 5).alias("provider")).agg(F.avg(F.col("l_discount") * 10).alias("mean")), path)
    return rounded(C.read_baseline(spark, path))


@query(
    """with v as (select distinct concat('p', l_partkey % 60) as prompt_id, concat('sys', l_suppkey % 3) as first, concat('sys', (l_suppkey + 1) % 3) as second, case l_linestatus when 'O' then 'first' else 'second' end as winner from lineitem)
  select 'gemini-2' as model, first, second, winner, count(*) as pairs from v group by all"""
)
def stored_arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel run's pairs, written a file of parts of the run and read with checks."""
    li = table(spark, sf_dir, "lineitem")
    pair = F.struct(F.concat(F.lit("p"), F.col("l_partkey") % 60).alias("prompt_id"), F.concat(F.lit("sys"), F.col("l_suppkey") % 3).alias("first"), F.concat(F.lit("sys"), (F.col("l_suppkey") + 1) % 3).alias("second"), F.when(F.col("l_linestatus") == "O", "first").otherwise("second").alias("winner"))
    parts = li.select(pair.alias("p")).distinct().groupBy("p.prompt_id").agg(F.collect_list("p").alias("pairs"))  # at most a few pairs for each prompt
    path = new_path(spark, "arena")
    C.write_lines(parts.select(F.array(F.lit("sys0"), F.lit("sys1"), F.lit("sys2")).alias("systems"), F.lit("gemini-2").alias("model"), "pairs"), path)
    return C.read_arena(spark, path, ["sys2", "sys1", "sys0"]).groupBy("model", "first", "second", "winner").agg(F.count("*").alias("pairs"))


@query("select concat(source, '.', lang) as stem, 1 as channels, 16000 as sample_rate, 16 as bits, cast(sum(n_chars) * 2 as bigint) as data_bytes, round(sum(n_chars) / 16000.0, 6) as seconds from documents where n_chars > 0 group by source, lang")
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of recordings say: a table of files' bytes, a file for each source and language."""
    size = F.sum("n_chars").alias("n")
    d = documents(spark, sf_dir).where("n_chars > 0").groupBy("source", "lang").agg(size)

    def little(value, width):
        return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(value), 8, "0"), 7 - 2 * i, 2) for i in range(width)]))

    data = (F.col("n") * 2).cast("long")
    parts = [F.lit(bytearray(b"RIFF")), little(data + 36, 4), F.lit(bytearray(b"WAVEfmt ")), *[little(F.lit(v).cast("long"), w) for v, w in ((16, 4), (1, 2), (1, 2), (16000, 4), (32000, 4), (2, 2), (16, 2))], F.lit(bytearray(b"data")), little(data, 4)]
    files = d.select(F.concat(F.lit("/in/"), "source", F.lit("."), "lang", F.lit(".wav")).alias("path"), F.concat(*parts).alias("content"))
    from ..functions.labels import stem

    return rounded(C.wav_headers(files).select(stem(F.col("path")).alias("stem"), *[F.col(c).cast("int").alias(c) for c in ("channels", "sample_rate", "bits")], "data_bytes", "seconds"))
