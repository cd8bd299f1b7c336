"""From transcripts to what is counted: tokens of normal forms, edits, insertion runs, loops, fabrications, agreement of lanes.

Rows hold provider, mode, language, reference, text. Equal pairs of texts are aligned once: runs of the same clips repeat them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import languages, tags
from ..functions.align import spans
from ..functions.labels import condition
from ..functions.text import by_character, edits, token_distance
from .lanes import LANE, rate

FABRICATED, WORD_LOOP, CHARACTER_LOOP = 3, 5, 20  # inserted tokens in a row that are a fabrication; longest n-grams of loops


def _tokens(text: Column, language: Column) -> Column:
    return languages.tokens(languages.normalize(text, language), language)


def _different(rows: DataFrame) -> DataFrame:
    """Each different pair of texts once, with a key (pair) and their tokens (r, h)."""
    keys = ["language", "reference", "text"]
    pairs = rows.select(F.sha2(F.to_json(F.struct(*keys)), 256).alias("pair"), *keys).dropDuplicates(["pair"])
    return pairs.select("pair", _tokens(F.col("reference"), F.col("language")).alias("r"), _tokens(F.col("text"), F.col("language")).alias("h"))


def _with_pairs(rows: DataFrame, counted: DataFrame) -> DataFrame:
    return rows.withColumn("pair", F.sha2(F.to_json(F.struct("language", "reference", "text")), 256)).join(counted.hint("merge"), "pair", "left").drop("pair")  # grows with the rows, so it never goes to the driver to be broadcast


def with_edits(rows: DataFrame) -> DataFrame:
    """rows with errors and reference_length, in the unit of the language: words, or characters. Each different pair of texts is compared once and found by its SHA-256."""
    errors = F.when(F.col("r") == F.col("h"), F.lit(0)).otherwise(token_distance(F.col("r"), F.col("h")))
    return _with_pairs(rows, _different(rows).select("pair", errors.cast("long").alias("errors"), F.size("r").cast("long").alias("reference_length")))


def with_edit_kinds(rows: DataFrame) -> DataFrame:
    """rows with substitutions, deletions, insertions and reference_length of a least-cost alignment."""
    return _with_pairs(rows, _different(rows).select("pair", edits("r", "h").alias("e")).select("pair", "e.*"))


KINDS = ("substitutions", "deletions", "insertions", "reference_length")


def edit_kinds(rows: DataFrame) -> DataFrame:
    """Pooled counts by lane and language."""
    return with_edit_kinds(rows).groupBy(*LANE, "language").agg(F.count("*").alias("clips"), *[F.sum(k).alias(k) for k in KINDS])


def accuracy(rows: DataFrame, fallback: str = "en-US") -> DataFrame:
    """Pooled error rate by lane and language with the name of its unit; rows that failed count as failures only."""
    own = rows.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(fallback)))
    ok = F.col("error").isNull()
    scored = with_edits(own.where(ok)).select(*LANE, "language", "errors", "reference_length", F.lit(0).alias("failed"))
    failed = own.where(~ok).select(*LANE, "language", F.lit(None).cast("long").alias("errors"), F.lit(None).cast("long").alias("reference_length"), F.lit(1).alias("failed"))
    out = scored.unionByName(failed).groupBy(*LANE, "language").agg(
        F.count("*").alias("clips"), F.sum("failed").alias("failures"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("reference_length"), F.lit(0)).alias("reference_length"), rate(F.col("errors"), F.col("reference_length")).alias("error_rate")
    )
    return out.withColumn("metric", F.when(by_character(F.col("language")), "CER").otherwise("WER")).orderBy("language", F.asc_nulls_last("error_rate"), *LANE)


@F.pandas_udf(ArrayType(IntegerType()))
def insertion_runs(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Lengths of maximal runs of inserted tokens, in order."""
    out = []
    for r, h in zip(reference, hypothesis, strict=True):
        r, h = list(r if r is not None else ()), list(h if h is not None else ())
        out.append([len(h)] if h and not r else [b - a for kind, _, _, a, b in spans(r, h) if kind == "insert"] if r != h else [])
    return pd.Series(out)


def looping(tokens: Column, language: Column) -> Column:
    return F.when(by_character(language), tags.loops(tokens, CHARACTER_LOOP)).otherwise(tags.loops(tokens, WORD_LOOP))


def hallucinations(rows: DataFrame) -> DataFrame:
    """By lane, language and condition: clips with a fabricated phrase, inserted tokens and those a minute, finals on clips without speech, loops.

    The condition is what the clip id begins with, else speech or no_speech by the reference. events: what a session left, may be null."""
    spoken = F.trim(F.coalesce("reference", F.lit(""))) != ""
    named = F.coalesce(condition(F.col("clip_id")), F.when(spoken, "speech").otherwise("no_speech"))
    r, h = _tokens(F.coalesce("reference", F.lit("")), F.col("language")), _tokens(F.coalesce("text", F.lit("")), F.col("language"))
    told = rows.withColumn("condition", named).withColumn("ok", F.col("error").isNull()).withColumn("h", h).withColumn("runs", insertion_runs(r, F.col("h")))
    phantom = F.when(F.col("ok") & ~spoken, F.size(F.filter(F.coalesce("events", F.array()), lambda e: e.is_final & (F.trim(e.text) != "")))).otherwise(0)
    ok = F.col("ok")
    each = told.select(
        *LANE, "language", "condition", ok, F.when(ok, F.col("audio_s")).alias("audio_s"), F.when(ok, F.aggregate("runs", F.lit(0), lambda a, x: a + x)).alias("inserted"),
        (ok & F.exists("runs", lambda x: x >= FABRICATED)).alias("fabricated"), (ok & looping(F.col("h"), F.col("language"))).alias("looped"), phantom.alias("phantom"),
    )
    out = each.groupBy(*LANE, "language", "condition").agg(
        F.count("*").alias("clips"), F.count(F.when(~ok, 1)).alias("failures"), F.count(F.when(F.col("fabricated"), 1)).alias("fabricated_clips"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted_words"),
        F.sum("phantom").cast("long").alias("phantom_finals"), F.count(F.when(F.col("phantom") > 0, 1)).alias("phantom_final_clips"), F.count(F.when(F.col("looped"), 1)).alias("looped_clips"), F.sum("audio_s").alias("audio_s"),
    )
    scored = F.nullif(F.col("clips") - F.col("failures"), F.lit(0))
    return out.select("*", (F.col("fabricated_clips") / scored).alias("fabrication_rate"), (F.col("inserted_words") / F.nullif(F.col("audio_s") / 60, F.lit(0.0))).alias("inserted_a_minute"), (F.col("looped_clips") / scored).alias("loop_rate"))


def agreement(rows: DataFrame) -> DataFrame:
    """Pairs of lanes over the clips that both have, by language and over all languages ("all"): edits between their tokens over the mean length. rows: lane, clip_id, language, text, error.

    A clip's lanes are gathered, so texts are shuffled once; the last usable row of a lane counts. Pairs of one text count without being compared. Lanes that disagree on a
    clip's language fail the job; a clip without one is und. Pairs without a clip in common are in the result with null."""
    usable = rows.where("error is null and trim(text) != ''").groupBy("clip_id", "lane").agg(F.max_by(F.struct("language", "text"), "seq").alias("u"))
    languages_ = F.array_compact(F.collect_set("u.language"))
    clips = usable.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("lane", F.col("u.text").alias("text")))).alias("said"), languages_.alias("named"))
    one = F.when(F.size("named") > 1, F.raise_error(F.concat(F.lit("lanes disagree on the language of "), "clip_id"))).otherwise(F.coalesce(F.get("named", F.lit(0)), F.lit("und")))
    texts = F.array_distinct(F.col("said.text"))
    told = clips.withColumn("language", one).select("clip_id", "language", "said", F.posexplode(texts).alias("at", "text")).select("clip_id", "language", "said", "text", _tokens(F.col("text"), F.col("language")).alias("tokens"))
    both = told.groupBy("clip_id", "language").agg(F.first("said").alias("said"), F.map_from_entries(F.collect_list(F.struct("text", "tokens"))).alias("t"))
    pairs = F.flatten(F.transform("said", lambda a: F.transform(F.filter("said", lambda b: a.lane < b.lane), lambda b: F.struct(a.lane.alias("lane_a"), b.lane.alias("lane_b"), (a.text == b.text).alias("same"), F.element_at("t", a.text).alias("x"), F.element_at("t", b.text).alias("y")))))
    each = both.select("language", F.explode(pairs).alias("p")).select("language", "p.*")
    distance = F.when(F.col("same") | (F.col("x") == F.col("y")), F.lit(0)).otherwise(token_distance(F.col("x"), F.col("y")))
    counted = each.select("language", "lane_a", "lane_b", distance.alias("e"), (F.size("x") + F.size("y")).alias("n"))
    sums = F.count("*").alias("clips"), F.sum("e").alias("edits"), F.sum("n").alias("tokens")
    found = counted.groupingSets([["lane_a", "lane_b", "language"], ["lane_a", "lane_b"]], "lane_a", "lane_b", "language").agg(*sums, F.grouping("language").alias("pooled"))
    found = found.withColumn("language", F.when(F.col("pooled") == 1, "all").otherwise(F.col("language"))).drop("pooled")
    lanes = rows.select("lane").distinct()
    skeleton = lanes.select(F.col("lane").alias("lane_a")).join(lanes.select(F.col("lane").alias("lane_b")), F.col("lane_a") < F.col("lane_b"))
    return skeleton.join(found, ["lane_a", "lane_b"], "left").withColumn("disagreement", 2 * F.col("edits") / F.nullif(F.col("tokens"), F.lit(0)))


def agreement_matrix(cells: DataFrame, language: str = "all") -> DataFrame:
    """The disagreements of one language as a symmetric matrix: a row and a column for each lane, null on the diagonal and where lanes share no clip."""
    chosen = cells.where((F.col("language") == language) | F.col("language").isNull()).select("lane_a", "lane_b", "disagreement")
    both = chosen.union(chosen.select("lane_b", "lane_a", "disagreement"))
    return both.groupBy(F.col("lane_a").alias("lane")).pivot("lane_b").agg(F.first("disagreement"))


def kept_sentences(lines: DataFrame, text: str, order: list[str], words: tuple[int, int] = (4, 40), letters: tuple[int, int] = (8, 100)) -> DataFrame:
    """Distinct trimmed lines of fitting length, the first of each language by `order`: in words, or without spaces in characters where the language is scored so."""
    said = lines.withColumn(text, F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    size = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    bare = F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    known = F.coalesce(by_character(F.col("language")), F.lit(False))
    fits = F.when(known, bare.between(*letters)).otherwise(size.between(*words))
    return said.where(fits).groupBy("language", text).agg(F.min(F.struct(*order)).alias("__first")).select("language", text, "__first.*")


def write_agreement(cells: DataFrame, path: str) -> None:
    """The cells as JSON lines, and below matrix/ a symmetric matrix for each language, as JSON lines with nulls."""
    cells.write.option("ignoreNullFields", False).json(f"{path}/pairs")
    named = cells.where("language is not null").select("language", "lane_a", "lane_b", "disagreement")
    lanes = cells.select(F.col("lane_a").alias("lane")).union(cells.select("lane_b")).distinct()
    both = named.union(named.select("language", "lane_b", "lane_a", "disagreement"))
    full = named.select("language").distinct().join(lanes).select("language", F.col("lane").alias("lane_a"))  # a row for each lane, shared clips or not
    wide = full.join(both, ["language", "lane_a"], "left").groupBy("language", F.col("lane_a").alias("lane")).pivot("lane_b", [r[0] for r in lanes.orderBy("lane").collect()]).agg(F.first("disagreement"))
    wide.write.partitionBy("language").option("ignoreNullFields", False).json(f"{path}/matrix")
