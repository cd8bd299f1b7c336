"""Queries over recordings; documents' bytes stand for samples at 16,000 a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resample
from ..operators import recordings
from .queries import query, table

RATE, CHUNK_MS = 16_000, 50
STEP = RATE * CHUNK_MS // 1000 * 2
_HALF = len(resample.taps(1, 2)) // 2
_TAPS = "[" + ", ".join(repr(float(x)) for x in resample.taps(1, 2)) + "]"


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return recordings.chunks(docs, "pcm", RATE, CHUNK_MS)


@query(f"with h as (select doc_id, hex(encode(text)) as h, unnest(range(0, strlen(text), {STEP})) as o from documents) select doc_id, o as offset, least({STEP}, len(h) // 2 - o) as bytes, md5(h[2 * o + 1:2 * o + {2 * STEP}]) as digest from h")
def recording_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in chunks of 50 ms, the last one short."""
    return cut(spark, sf_dir).select("doc_id", "offset", F.octet_length("chunk").cast("long").alias("bytes"), F.md5(F.hex("chunk").cast("binary")).alias("digest"))


TURN_MS = 7  # so that a turn's bytes are several chunks


@query(
    f"""with h as (select concat(conv_id, '-', turn, '-', role) as clip, hex(encode(string_agg(text, '' order by text))) as h from conversations where text <> '' group by 1), v as (select clip, list_transform(range(0, len(h) // 4), lambda i: cast('0x' || h[4 * i + 3:4 * i + 4] || h[4 * i + 1:4 * i + 2] as integer)) as v from h),
  x as (select clip, list_concat(list_transform(range(0, {_HALF}), lambda i: 0.0::double), list_transform(v, lambda s: (case when s >= 32768 then s - 65536 else s end)::double), list_transform(range(0, {_HALF}), lambda i: 0.0::double)) as x, len(v) as n from v),
  y as (select clip, list_transform(range(0, (n + 1) // 2), lambda k: floor(list_dot_product(x[2 * k + 1:2 * k + {2 * _HALF + 1}], {_TAPS}::double[]) + 0.5)) as y from x where n > 0)
  select clip, cast(len(y) as bigint) as samples, round(sqrt(list_sum(list_transform(y, lambda s: greatest(-32768, least(32767, s)) ** 2)) / len(y)), 1) as level from y"""
)
def halved_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings at half their rate, filtered chunk by chunk: samples and level. What was said in turns stands for recordings."""
    said = table(spark, sf_dir, "conversations").where("text != ''").groupBy(F.concat_ws("-", "conv_id", "turn", "role").alias("clip")).agg(F.array_join(F.array_sort(F.collect_list("text")), "").cast("binary").alias("pcm"))
    told = recordings.rate_changed(recordings.chunks(said, "pcm", RATE, TURN_MS), ["clip"], RATE, RATE // 2)
    value = F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("chunk"), F.lit(2)), lambda at: F.conv(F.hex(F.concat(F.substring(F.col("chunk"), at + 1, F.lit(1)), F.substring(F.col("chunk"), at, F.lit(1)))), 16, 10).cast("int")))
    each = told.where(F.octet_length("chunk") > 0).select("clip", value.alias("v")).withColumn("v", F.when(F.col("v") >= 32768, F.col("v") - 65536).otherwise(F.col("v")).cast("double"))
    return each.groupBy("clip").agg(F.count("*").alias("samples"), F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 1).alias("level"))
