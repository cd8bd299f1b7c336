"""Choosing, parsing and joining records: utterances, shards of subtitles, candidates, plot points, annotations, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.slots import extracted
from .lanes import LANE, keep_last


def kept_utterance(text: Column, duration_s: Column) -> Column:
    """3 to 30 seconds, at least 12 characters, no stage directions, notes or addresses."""
    said = F.trim(text)
    return F.coalesce(duration_s.between(3.0, 30.0) & (F.length(said) >= 12) & ~said.rlike(r"[\[\]♪♫]|https?://"), F.lit(False))


def shard_candidates(shard: DataFrame, least: int = 30) -> DataFrame:
    """Utterances of subtitle shards: (video, texts: map of <video>-<index>-<start>-<end>, of 5, 8 and 8 digits, in hundredths of a second, to text). Videos with fewer than
    `least` entries go before anything else is looked at; keys of another form are skipped."""
    whole = shard.where(F.col("video").isNotNull() & (F.col("video") != "") & (F.size("texts") >= least))
    each = whole.select("video", F.explode("texts").alias("utt_id", "text"))
    offset = [(F.regexp_extract("utt_id", r"^.+-\d{5}-(\d{8})-(\d{8})$", i).try_cast("double") / 100).alias(c) for i, c in ((1, "start_s"), (2, "end_s"))]
    timed = each.select("video", "utt_id", F.trim("text").alias("text"), *offset).where("start_s is not null and end_s is not null")
    return timed.where(kept_utterance(F.col("text"), F.col("end_s") - F.col("start_s")))


GRANARY = "text string, duration double, utt_id string, original_source_id string, dataset_source string"


def tolerant_candidates(lines: DataFrame, subset: str) -> DataFrame:
    """Utterances of JSON lines (column value); lines that are broken, or lack a text, a duration or an id, are skipped.

    A line is parsed once: conditions on what a generator gives aren't moved before it, where each would parse the line again."""
    parsed = lines.select(F.inline(F.array(F.from_json("value", GRANARY, {"mode": "PERMISSIVE"})))).where("text is not null and duration is not null and utt_id is not null")
    kept = parsed.where(kept_utterance(F.col("text"), F.col("duration")))
    return kept.select("utt_id", F.coalesce("original_source_id", F.lit("")).alias("video"), F.coalesce(F.nullif("dataset_source", F.lit("")), F.lit(subset)).alias("shard"), F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"), F.trim("text").alias("text"))


def manifest_rows(candidates: DataFrame, licenses: dict[str, str]) -> DataFrame:
    """Candidates (source, start_s, end_s ...) with duration, the source's license and an unchecked reference."""
    named = F.create_map(*[F.lit(x) for kv in licenses.items() for x in kv])
    return candidates.withColumns({"duration_s": F.round(F.col("end_s") - F.col("start_s"), 2), "license": F.element_at(named, F.col("source")), "gold_status": F.lit("unverified")})


def plot_points(summary: DataFrame, mode: str, metric: str) -> DataFrame:
    """Points of lanes that have both coordinates; the upper percentile falls back to the median where it is null or zero."""
    p50, p95 = F.col(f"{metric}_p50"), F.col(f"{metric}_p95")
    rows = summary.where((F.col("mode") == mode) & p50.isNotNull() & F.col("error_rate").isNotNull())
    return rows.select("language", "provider", (p50 * 1000).alias("latency_ms"), (F.coalesce(F.nullif(p95, F.lit(0.0)), p50) * 1000).alias("latency_p95_ms"), (F.col("error_rate") * 100).alias("error_pct"))


def required(column: str) -> Column:
    """A field that must be there; a row without it fails the job."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.raise_error(F.lit(f"{column} is missing")))


def clip_candidates(clips: DataFrame) -> DataFrame:
    """Clips of 2 to 30 seconds in English or Japanese; an unknown source fails the job, an offset that isn't a number is 0."""
    source = F.coalesce("source", F.lit("merged"))
    known = F.when(source.isin("user", "agent", "merged", "video"), source).otherwise(F.raise_error(F.concat(F.lit("invalid source "), source)))
    rows = clips.where(F.col("language").isin("en", "ja") & F.col("duration").between(2.0, 30.0))
    return rows.select(required("clip_path").alias("clip_path"), required("session_id").alias("session_id"), "language", "duration", known.alias("source"), F.coalesce(F.col("start_offset").try_cast("double"), F.lit(0.0)).alias("start_offset"))


def roundtrip_entries(runs: DataFrame) -> DataFrame:
    """A row for each judge's transcript of a run: those of its array, or the one of older records (roundtrip_provider, roundtrip_text)."""
    old = F.when(F.col("roundtrip_text").isNotNull(), F.array(F.struct(F.col("roundtrip_provider").alias("provider"), F.col("roundtrip_text").alias("text"))))
    rows = runs.withColumn("entry", F.explode_outer(F.coalesce("roundtrip", old)))
    return rows.select(*[c for c in runs.columns if not c.startswith("roundtrip")], F.col("entry.provider").alias("judge"), F.col("entry.text").alias("heard"))


def eligible(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Runs that a round trip can score: no error, not cold, of a known prompt."""
    return runs.where("error is null and not cold").join(prompts.select("prompt_id", F.col("text").alias("said")), "prompt_id")


def propagated(rows: DataFrame, tagger: Column | None = None) -> DataFrame:
    """Rows with annotations that any lane has for their clip: the last one of (language, clip_id), if its reference is the same but for white
    space; else what tagger says of the row. rows: language, clip_id, seq, reference, annotated."""
    some = rows.where("annotated != '' and reference is not null").groupBy("language", "clip_id").agg(F.max_by(F.struct("reference", "annotated"), "seq").alias("known"))
    both = rows.join(some, ["language", "clip_id"], "left")
    shared = F.when(tags.same_text(F.col("known.reference"), F.col("reference")), F.col("known.annotated"))
    told = F.coalesce(F.nullif("annotated", F.lit("")), shared) if tagger is None else F.coalesce(F.nullif("annotated", F.lit("")), shared, F.nullif(tagger, F.col("reference")))
    return both.withColumn("annotated", F.when(F.coalesce(F.col("reference"), F.lit("")) != "", told).otherwise(F.col("annotated"))).drop("known")


def with_gold(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Left join to annotations by hand (language, clip_id, text, annotated), taken only where the text is the row's reference."""
    g = gold.select("language", "clip_id", F.col("text").alias("gold_text"), F.col("annotated").alias("gold"))
    both = rows.join(g, ["language", "clip_id"], "left")
    return both.withColumn("gold", F.when(tags.same_text(F.col("gold_text"), F.col("reference")), F.col("gold"))).drop("gold_text")


def task_success(turns: DataFrame, results: DataFrame, correct: Column) -> DataFrame:
    """By provider and class of slot: turns that were scored, correct and failed. A failed run is an incorrect one; a turn without a run isn't counted."""
    both = turns.join(results, "clip_id")
    good = F.col("error").isNull() & F.coalesce(correct, F.lit(False))
    return both.groupBy("provider", "entity").agg(F.count("*").alias("scorable"), F.count(F.when(good, 1)).alias("correct"), F.count("error").alias("failures"), F.avg(good.cast("double")).alias("success"))


def slot_success(turns: DataFrame, results: DataFrame) -> DataFrame:
    """task_success() of slots: turns (clip_id, entity, written, language) whose value a lane's text (provider, clip_id, text, error) has."""
    both = results.join(turns.select("clip_id", "written", "language", F.col("entity").alias("class")), "clip_id")
    found = both.withColumn("value", extracted(F.col("class"), F.col("written"), F.col("text"), F.col("language"))).select("provider", "clip_id", "error", "value")
    return task_success(turns.select("clip_id", "entity"), found, F.col("value").isNotNull())


def arena_pairs(prompts: DataFrame, systems: DataFrame, aspects: list[str], missing: DataFrame) -> DataFrame:
    """What judges are asked: each pair of systems for each prompt and aspect, in both orders, unless a recording is missing (prompt_id, system).

    The pairs of the few systems are made first, so a prompt's row is repeated, never joined with the other prompts."""
    names = sorted(r["system"] for r in systems.select("system").distinct().collect())  # the systems under test, a handful
    orders = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(x).alias("aspect")) for a in names for b in names if a != b for x in aspects])
    asked = prompts.select("prompt_id", F.explode(orders).alias("o")).select("prompt_id", "o.*")
    for side in ("first", "second"):
        asked = asked.join(missing.select("prompt_id", F.col("system").alias(side)), ["prompt_id", side], "left_anti")
    return asked.select("prompt_id", "aspect", "first", "second")


def cached(entries: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only cache as a table: the last entry of each key."""
    return keep_last(entries, [key], [order])


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def fetch_plan(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Shards to read for the segments that aren't cached, each once, with how many segments it gives."""
    return cache_misses(segments, cache, "utt_id").groupBy("subset", "shard").agg(F.count("*").alias("segments"), F.min("start_s").alias("from_s"), F.max("end_s").alias("to_s"))


def semantic_rates(verdicts: DataFrame, by_character: Column) -> DataFrame:
    """Pooled semantic errors beside the plain ones over the same clips, by lane and language; report order: language, rate, provider.

    verdicts: provider, mode, language, substitutions, deletions, insertions, reference_units, edits, reference_length."""
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    total = verdicts.groupBy(*LANE, "language").agg(F.count("*").alias("clips"), F.sum(errors).alias("semantic_errors"), F.sum("reference_units").alias("semantic_units"), (F.sum("edits") / F.nullif(F.sum("reference_length"), F.lit(0))).alias("plain_rate"))
    out = total.withColumn("semantic_rate", F.col("semantic_errors") / F.nullif(F.col("semantic_units"), F.lit(0))).withColumn("metric", F.when(by_character, "CER").otherwise("WER"))
    return out.orderBy("language", F.asc_nulls_last("semantic_rate"), "provider", "mode")


def finished_rate(errors: Column, units: Column) -> Column:
    """An item's rate: 0 of nothing with nothing, null of nothing with errors."""
    return F.when(units > 0, errors / units).when(errors == 0, F.lit(0.0))


def panel_ok(votes: DataFrame, raters: int = 2, pairs: int = 100) -> DataFrame:
    """One row: raters, the fewest votes of one, and whether the panel is large enough."""
    per = votes.groupBy("rater").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("raters"), F.min("n").alias("fewest")).withColumn("ok", F.coalesce((F.col("raters") >= raters) & (F.col("fewest") >= pairs), F.lit(False)))


def spent(calls: DataFrame, rates: dict[str, tuple[float, float]], family: Column) -> DataFrame:
    """Estimated spend by model: tokens of live calls at their family's rates for a million (input, output); cached calls are free. calls: model, kind, prompt_tokens, output_tokens."""
    price = [F.element_at(F.create_map(*[F.lit(x) for f, r in rates.items() for x in (f, r[i])]), family) for i in (0, 1)]
    live = F.col("kind") == "live"
    usd = F.when(live, F.col("prompt_tokens") * price[0] + F.col("output_tokens") * price[1]).otherwise(0.0) / 1e6
    return calls.withColumn("usd", usd).groupBy("model").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_calls") for k in ("live", "cached", "error")], F.sum("usd").alias("est_usd"))


def within_cap(estimates: DataFrame, cap: float) -> DataFrame:
    """The estimates (column usd), which fail the job if their total is above the cap."""
    total = F.sum("usd").over(Window.partitionBy(F.lit(0)))  # a row for each kind of spend
    return estimates.withColumn("usd", F.when(total > cap, F.raise_error(F.format_string("expected spend %.2f is above the cap", total)).cast("double")).otherwise(F.col("usd")))


def matrix_cost(clips: Column, mean_clip_s: Column, usd_per_hour: Column, levels: int = 5) -> Column:
    """Spend of a lane over all noise levels and the telephony pass."""
    return clips * (levels + 1) * mean_clip_s / 3600 * usd_per_hour


def join_file(manifests: DataFrame) -> DataFrame:
    """Rows of a nested manifest (session, room, files: array of paths), a row a file, in order."""
    from ..functions.labels import session_id

    rows = manifests.select("session", "room", F.explode("files").alias("path"))
    return rows.select("session", "room", F.element_at(F.split("path", "/"), -1).alias("filename"), session_id(F.col("path")).alias("session_id")).orderBy("session_id", "filename")


def listed_videos(lines: DataFrame) -> DataFrame:
    """Videos of a storage listing (column value: size, time, address); other lines are skipped."""
    from ..functions.labels import session_id

    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.col("p")[0].rlike("^[0-9]+$"))
    rows = rows.select(F.get(F.filter("p", lambda x: x.rlike(r"^[a-z0-9]+://.*\.mp4$")), 0).alias("uri"), F.col("p")[0].cast("long").alias("size")).where("uri is not null")
    return rows.select(session_id(F.col("uri")).alias("session_id"), F.element_at(F.split("uri", "/"), -1).alias("filename"), "uri", "size").orderBy("session_id", "filename", "uri")


def pilot_rows(chosen: DataFrame, folder: str, stem: Column | None = None) -> DataFrame:
    """Lines of a pilot manifest, in the order of `place`: id of session and file, as files of several sessions share names; the clip by its path from `folder` where it lies within it.

    chosen: session_id, clip_path, language, duration, source, place. stem: what names a file, else its name without ending."""
    name = F.regexp_extract("clip_path", r"([^/]*?)(\.[^./]*)?$", 1) if stem is None else stem
    prefix = F.lit(folder.rstrip("/") + "/")
    clip = F.when(F.startswith(F.col("clip_path"), prefix), F.substr("clip_path", F.length(prefix) + 1)).otherwise(F.col("clip_path"))
    return chosen.orderBy("place").select(F.concat_ws("-", "session_id", name).alias("id"), clip.alias("clip"), F.col("session_id").alias("session"), "language", F.col("duration").alias("duration_s"), "source")
