"""Corpora and what belongs to them: Parquet, manifests, prompts, votes, anchors, baselines, recordings.

Readers check what they read: a missing column or a repeated key is an error when the reader is called, a value out of its domain fails the job at
its row. Writers leave plain JSON lines, CSV or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import stem
from ..operators.ranking import sample

WINNERS = ("first", "second", "tie")


def _named(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def _within(c: Column, domain: tuple[str, ...], what: str) -> Column:
    return F.when(c.isin(*domain), c).otherwise(F.raise_error(F.concat(F.lit(f"{what} out of its domain: "), F.coalesce(c, F.lit("null")))))


def read_corpus(spark: SparkSession, path: str, columns: dict[str, str], language: str | None = None) -> DataFrame:
    """Parquet (a path or pattern) with only the columns asked for: columns maps a name in the result to one in the files."""
    df = _named(spark.read.parquet(path), list(columns.values()), path).select(*[F.col(c).alias(name) for name, c in columns.items()])
    return df if language is None else df.withColumn("language", F.lit(language))


def select_rows(df: DataFrame, key: str, limit: int | None, seed: int | None = None) -> DataFrame:
    """All rows, the first `limit` by key, or a seeded sample of so many, in the order of the key."""
    if limit is None:
        return df
    return (df.orderBy(key).limit(limit) if seed is None else sample(df, limit, seed, key)).orderBy(key)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Corpora of several languages as one; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


MANIFEST = "audio string, id string, text string, language string, duration double"


def read_manifest(spark: SparkSession, path: str, base: str, limit: int | None = None, language: str = "en-US") -> DataFrame:
    """JSON lines with audio; relative paths are below base, an id that is missing is the file's stem."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    audio = F.coalesce("audio", F.raise_error(F.lit(f"{path}: a row without audio")))
    full = F.when(audio.rlike(r"^(/|[a-z0-9]+://)"), audio).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), audio))
    out = rows.select(F.coalesce("id", stem(audio)).alias("clip_id"), full.alias("audio"), F.col("text").alias("reference"), F.coalesce("language", F.lit(language)).alias("language"))
    return out if limit is None else out.orderBy("clip_id").limit(limit)


SHAPES = {"curated": {"source", "subset", "shard", "utt_id"}, "realdata": {"clip", "session_id", "duration_s"}, "plain": {"audio"}}


def manifest_shape(spark: SparkSession, path: str) -> str:
    """The kind of a manifest by the keys of its first row."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.json_object_keys("value").alias("k")).first()
    keys = set(first["k"] or []) if first else set()
    for name, wanted in SHAPES.items():
        if wanted <= keys:
            return name
    raise ValueError(f"{path}: no known kind of manifest has the keys {sorted(keys)}")


CURATED = "source string, subset string, shard string, utt_id string, text string, start_s double, end_s double, duration_s double, license string, gold_status string"


def read_curated(spark: SparkSession, path: str, fetchable: tuple[str, ...], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows of sources that can't be fetched are skipped, not an error; limit counts kept rows only. Times that a row lacks are read from its id (hundredths of a second, eight digits or, from a million seconds on, more)."""
    rows = spark.read.schema(CURATED).option("mode", "FAILFAST").json(path)
    coded = [(F.regexp_extract("utt_id", r"-(\d{8,})-(\d{8,})$", i).try_cast("double") / 100) for i in (1, 2)]
    timed = rows.withColumns({"start_s": F.coalesce("start_s", coded[0]), "end_s": F.coalesce("end_s", coded[1])})
    known = F.col("source").isin(*fetchable) & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    kept = timed.where(F.coalesce(known, F.lit(False)))
    return kept if limit is None else kept.orderBy("utt_id").limit(limit), timed.where(~F.coalesce(known, F.lit(False)))


REALDATA = "clip string, session_id string, language string, duration_s double, measured_s double"


def read_realdata(spark: SparkSession, path: str) -> DataFrame:
    """Clips of real sessions, which have no reference; a recording whose length is off by more than the larger of 0.1 s and 2 % fails the job."""
    rows = spark.read.schema(REALDATA).option("mode", "FAILFAST").json(path)
    off = F.abs(F.col("measured_s") - F.col("duration_s")) > F.greatest(F.lit(0.1), F.col("duration_s") * 0.02)
    length = F.when(off, F.raise_error(F.concat(F.lit("another length than its manifest has: "), "clip")).cast("double")).otherwise(F.col("duration_s"))
    return rows.select(stem(F.col("clip")).alias("clip_id"), "clip", "session_id", "language", length.alias("duration_s"), F.lit(None).cast("string").alias("reference"))


def read_prompts(spark: SparkSession, path: str, prefix: str = "p", digits: int = 4) -> DataFrame:
    """Prompts of text files, one on each line that isn't blank; ids count the lines of the file, so blank ones leave gaps. A file of prompts is read as one row."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "text"))
    return lines.select(F.format_string(f"{prefix}%0{digits}d", "n").alias("prompt_id"), F.trim("text").alias("text"), "file").where("text != ''")


def read_arena_prompts(spark: SparkSession, specs: list[tuple[str, int | None]], seed: int) -> DataFrame:
    """Prompts of several files, of each all or a seeded sample; ids are the file's stem and the line. Two files of one stem are an error."""
    names = [p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for p, _ in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"two files of one name among {names}")
    parts = [select_rows(read_prompts(spark, p, f"{name}-", 3), "prompt_id", n, seed) for name, (p, n) in zip(names, specs, strict=True)]
    return union_sources(parts)


VOTE = "rater string, prompt_id string, first string, second string, winner string"


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes of a panel; another winner than first, second or tie fails the job."""
    rows = spark.read.schema(VOTE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("winner", _within(F.col("winner"), WINNERS, "winner"))


def read_anchor(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """Labels by people (CSV: clip_id, provider, label); a key that comes twice is an error."""
    rows = _named(spark.read.option("header", True).csv(path), ["clip_id", "provider", "label"], path).select("clip_id", "provider", "label")
    twice = rows.groupBy("clip_id", "provider").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: {twice[0].clip_id}, {twice[0].provider} comes {twice[0]['count']} times")
    return rows.withColumn("label", _within(F.trim("label"), labels, "label"))


def write_review_sheet(rows: DataFrame, path: str) -> None:
    """Rows for people to fill in: a column transcript, empty."""
    rows.withColumn("transcript", F.lit("")).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; mode append adds to what is there."""
    rows.write.mode(mode).json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("provider string, mean double").option("mode", "FAILFAST").json(path)


ARENA = "systems array<string>, model string, pairs array<struct<prompt_id: string, first: string, second: string, winner: string>>"


def read_arena(spark: SparkSession, path: str, systems: list[str]) -> DataFrame:
    """Pairs of a stored panel run; a run without a model, with a system twice or with other systems than expected fails the job."""
    rows = spark.read.schema(ARENA).option("mode", "FAILFAST").json(path)
    odd = F.col("model").isNull() | (F.size(F.array_distinct("systems")) < F.size("systems")) | (F.array_sort("systems") != F.array(*map(F.lit, sorted(systems))))
    checked = rows.withColumn("model", F.when(F.coalesce(odd, F.lit(True)), F.raise_error(F.lit(f"{path}: not a run of {sorted(systems)}"))).otherwise(F.col("model")))
    return checked.select("model", F.explode("pairs").alias("p")).select("model", "p.*")


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """Recordings below a folder, in order of their paths; their bytes aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")


def _number(content: str, at: int, size: int) -> Column:
    """A little-endian number of a file's bytes, from 0."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in range(size, 0, -1)]), 16, 10).cast("long")


def wav_headers(files: DataFrame) -> DataFrame:
    """Channels, rate, bits and seconds of recordings (path, content), from the 44 bytes of a plain header; others have nulls."""
    plain = (F.substring("content", 1, 4) == F.lit(bytearray(b"RIFF"))) & (F.substring("content", 37, 4) == F.lit(bytearray(b"data")))
    kept = {name: F.when(plain, _number("content", at, size)) for name, at, size in (("channels", 22, 2), ("sample_rate", 24, 4), ("bits", 34, 2), ("data_bytes", 40, 4))}
    return files.withColumns(kept).withColumn("seconds", F.col("data_bytes") / (F.col("sample_rate") * F.col("channels") * F.col("bits") / 8)).drop("content")




SUITE = "prompt_id string, text string, language string, category string, license string, source string, annotated string, entity_class string"


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a suite with their origin (JSON lines); a line that isn't JSON or lacks one of the first six fields fails the job."""
    rows = spark.read.schema(SUITE).option("mode", "FAILFAST").json(path)
    for name in SUITE.split(", ")[:6]:
        name = name.split()[0]
        rows = rows.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"{path}: a prompt without {name}")).cast("string")))
    return rows


def write_suite(rows: DataFrame, path: str) -> None:
    """Lines with every field, nulls too."""
    rows.select(*[x.split()[0] for x in SUITE.split(", ")]).write.option("ignoreNullFields", False).json(path)


def write_prompt_text(rows: DataFrame, path: str, order: str = "prompt_id") -> None:
    """The texts alone, one on each line in order, blank ones left out; in parts that follow each other by name."""
    rows.where(F.trim("text") != "").repartitionByRange(order).sortWithinPartitions(order).select(F.trim(F.regexp_replace("text", r"\s*\R\s*", " ")).alias("value")).write.text(path)


#: kinds of slots and the class that each has unless it names another (fixed values)
SLOT_KINDS = {"person": "name", "company": "name", "phone": "number", "small_count": "number", "amount": "currency", "date": "date", "code": "id"}
SCENARIO = "id string, language string, description string, slots array<struct<name: string, kind: string, entity: string, question: string>>"


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios (JSON documents) as a row for each slot: scenario_id, language, description, place, name, kind, entity, question.

    A scenario without id or slots, a slot without name or question, an unknown kind or class fails the job."""
    rows = spark.read.schema(SCENARIO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    said = F.coalesce("id", F.lit("?"))
    named = F.when((F.coalesce("id", F.lit("")) == "") | (F.coalesce(F.size("slots"), F.lit(0)) < 1), F.raise_error(F.concat(F.lit("a scenario needs an id and slots: "), said)).cast("string")).otherwise(F.col("id"))
    each = rows.select(named.alias("scenario_id"), F.coalesce("language", F.lit("en-US")).alias("language"), F.coalesce("description", F.lit("")).alias("description"), F.posexplode_outer("slots").alias("place", "s"))
    default = F.element_at(F.create_map(*[F.lit(x) for pair in SLOT_KINDS.items() for x in pair]), F.col("s.kind"))
    entity = F.coalesce(F.nullif("s.entity", F.lit("")), default)
    bad = default.isNull() | ~F.coalesce(entity.isin(*dict.fromkeys(SLOT_KINDS.values())), F.lit(False)) | (F.coalesce("s.name", F.lit("")) == "") | (F.coalesce("s.question", F.lit("")) == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a slot: "), F.to_json("s"))).cast("string")).otherwise(entity)
    return each.select("scenario_id", "language", "description", "place", "s.name", "s.kind", checked.alias("entity"), "s.question")
