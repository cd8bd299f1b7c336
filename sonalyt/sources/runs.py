"""Fact tables of evaluation runs.

read_stt / read_tts scan the JSON-lines files that runs leave, with explicit schemas and the readers' defaults. The *_SQL
templates derive the same tables from the synthetic tables at hand; they hold only what Spark and DuckDB share, so a query and its check start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTIAL = "array<struct<t_s: double, text: string, is_final: boolean, kind: string>>"
STT_SCHEMA = (
    "provider string, clip_id string, mode string, text string, reference string, reference_annotated string, license string, gold_status string, language string, audio_s double, total_s double, "
    f"ttft_s double, finalize_s double, chunk_ms double, speech_end_s double, pauses array<array<double>>, ws_rtt_s double, eou_source string, endpoint_config map<string, string>, model string, error string, partials {PARTIAL}"
)
TTS_SCHEMA = (
    "provider string, prompt_id string, mode string, chars long, audio_s double, ttfb_s double, ttfa_s double, gap_p99_s double, cold boolean, chunk_t_s array<double>, total_s double, load int, input_streaming boolean, "
    "error string, text string, roundtrip array<struct<provider: string, text: string, error: string>>, roundtrip_text string, roundtrip_provider string, audio_path string"
)


def _lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON-lines files with the ordinal of their file in paths; a malformed line fails the scan."""
    kind = T.StructType.fromDDL(schema)
    parts = [spark.read.schema(kind).option("mode", "FAILFAST").json(p).withColumn("file_ordinal", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_stt(spark: SparkSession, *paths: str) -> DataFrame:
    """Missing durations are 0; the real-time factor is computed, not read; a partial without kind gets it from is_final."""
    rows = _lines(spark, list(paths), STT_SCHEMA)
    kind = F.transform("partials", lambda p: p.withField("kind", F.coalesce(F.nullif(p.kind, F.lit("")), F.when(p.is_final, "segment_final").otherwise("interim"))))
    audio, total = F.coalesce("audio_s", F.lit(0.0)), F.coalesce("total_s", F.lit(0.0))
    return rows.withColumns({"audio_s": audio, "total_s": total, "partials": F.coalesce(kind, F.from_json(F.lit("[]"), PARTIAL)), "rtf": F.when(audio > 0, total / audio), "ok": F.col("error").isNull()})


def read_tts(spark: SparkSession, *paths: str) -> DataFrame:
    """A scalar judge of older files becomes an array of one."""
    rows = _lines(spark, list(paths), TTS_SCHEMA)
    single = F.array(F.struct(F.col("roundtrip_provider").alias("provider"), F.col("roundtrip_text").alias("text"), F.lit(None).cast("string").alias("error")))
    judged = F.when(F.col("roundtrip").isNotNull(), F.col("roundtrip")).when(F.col("roundtrip_text").isNotNull(), single)
    audio = F.coalesce("audio_s", F.lit(0.0))
    return rows.withColumns({"roundtrip": judged, "audio_s": audio, "cold": F.coalesce("cold", F.lit(False)), "load": F.coalesce("load", F.lit(1)), "ok": F.col("error").isNull() & (audio > 0)}).drop("roundtrip_text", "roundtrip_provider")


def write_lines(rows: DataFrame, path: str, *lane: str) -> None:
    """JSON lines, by lane if columns are given; a lane written again replaces its own files alone."""
    writer = rows.write.mode("overwrite")
    if lane:
        writer = writer.partitionBy(*lane).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def kind_of(spark: SparkSession, path: str) -> str:
    """'tts' if the first record has a prompt_id, else 'stt'."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.get_json_object("value", "$.prompt_id").isNotNull().alias("tts")).first()
    return "tts" if first and first["tts"] else "stt"


#: one row for each (provider, mode, clip) result; {lineitem} is a table name or a DataFrame
STT_SQL = """select concat('stt', cast(l_suppkey % 6 as string)) as provider, case when l_linestatus = 'O' then 'stream' else 'batch' end as mode,
  concat('clip', cast(l_partkey % 400 as string)) as clip_id, case l_partkey % 4 when 0 then 'en-US' when 1 then 'ja-JP' when 2 then 'de-DE' else 'fr-FR' end as language,
  case l_partkey % 3 when 0 then 'CC-BY' when 1 then 'CC0' else null end as license, case when l_partkey % 17 = 0 then 'unverified' else 'gold' end as gold_status,
  l_quantity / 4 as audio_s, l_quantity * (l_discount + 0.02) as total_s, case when l_returnflag = 'N' then null else l_tax * 8 + 0.25 end as ttft_s,
  case when l_linestatus = 'O' then l_discount * 10 + 0.125 else null end as finalize_s,
  case when l_returnflag = 'R' and l_linenumber >= 6 then case when l_partkey % 2 = 0 then 'Timeout while reading' else 'bad request' end else null end as error,
  l_linenumber - 1 as edits, cast(l_quantity as int) as reference_length, cast(l_orderkey % 3 as int) as file_ordinal,
  l_orderkey * 10 + l_linenumber as seq, l_extendedprice as tie, l_partkey % 6 as snr_level from {lineitem}"""

TTS_SQL = """select concat('tts', cast(l_suppkey % 5 as string)) as provider, case when l_linestatus = 'O' then 'stream' else 'batch' end as mode, case when l_linenumber = 7 then 4 else 1 end as load_n,
  concat('p', cast(l_partkey % 300 as string)) as prompt_id, cast(l_quantity * 3 as int) as chars, l_quantity / 5 as audio_s, l_tax * 5 + 0.125 as ttfb_s,
  case when l_returnflag = 'N' then null else l_tax * 6 + 0.25 end as ttfa_s, l_linenumber = 1 as cold, case when l_returnflag = 'R' and l_linenumber = 6 then 'server error' else null end as error from {lineitem}"""

#: prices by provider: per hour of audio, per million characters; null is unknown, 0 is free
PRICES = [("stt0", "vendor0", 0.25, None), ("stt1", "vendor1", 0.5, None), ("stt2", "vendor0", 0.0, None), ("stt3", "vendor2", None, None), ("tts0", "vendor0", None, 16.0), ("tts1", "vendor1", 3.0, None), ("tts2", None, 0.5, 8.0)]
PRICES_SQL = "(values " + ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in row) + ")" for row in PRICES) + ") as prices(provider, family, usd_per_hour, usd_per_million_chars)"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, family string, usd_per_hour double, usd_per_million_chars double")


def stt_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STT_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def tts_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TTS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
