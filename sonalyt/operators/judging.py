"""Tables over verdicts that judges left: pooled rates, summaries, consensus, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages
from ..functions.align import alignment
from ..functions.similarity import cosine
from ..sources.folders import kept
from .ranking import majority
from .transcripts import KINDS, with_edit_kinds


def cross_family_rate(rows: DataFrame, families: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Error rate of each provider pooled over judges of other families, and whether all its judges' rates lie further apart than threshold.

    rows: provider, judge, edits, reference_length; families: key, family (one row a key). A key without family is its own.
    """
    own, other = (families.select(F.col("key").alias(k), F.col("family").alias(f"{k}_family")) for k in ("provider", "judge"))
    sums = rows.groupBy("provider", "judge").agg(F.sum("edits").alias("e"), F.sum("reference_length").alias("n"))
    both = sums.join(own, "provider", "left").join(other, "judge", "left")
    foreign = F.coalesce("provider_family", "provider") != F.coalesce("judge_family", "judge")
    rate = F.col("e") / F.nullif(F.col("n"), F.lit(0))
    return both.groupBy("provider").agg(
        F.count("*").alias("judges"), (F.sum(F.when(foreign, F.col("e"))) / F.nullif(F.sum(F.when(foreign, F.col("n"))), F.lit(0))).alias("pooled_rate"),
        F.coalesce((F.count("*") >= 2) & (F.max(rate) - F.min(rate) > threshold), F.lit(False)).alias("diverges"),
    )


def unjudged(candidates: DataFrame, judges: DataFrame, families: DataFrame) -> DataFrame:
    """Candidates (key) without a judge of another family."""
    named = lambda df, k: df.select(F.col("key").alias(k)).join(families.select(F.col("key").alias(k), F.col("family").alias(f"{k}_family")), k, "left").withColumn(f"{k}_family", F.coalesce(f"{k}_family", k))
    a, b = named(candidates, "key"), named(judges, "judge").select("judge_family").distinct()
    return a.join(b, F.col("key_family") != F.col("judge_family"), "left_anti").select("key")


def label_summary(votes: DataFrame, lane: list[str], item: list[str], labels: list[str]) -> DataFrame:
    """By lane: items by the label most votes gave (ties: the first in labels), and the share on which all votes agree."""
    each = majority(votes, [*lane, *item], "label", labels)
    return each.groupBy(*lane).agg(F.count("*").alias("items"), *[F.count(F.when(F.col("majority") == x, 1)).alias(f"n_{x}") for x in labels], F.avg(F.col("unanimous").cast("double")).alias("unanimity"))


def consensus(verdicts: DataFrame) -> DataFrame:
    """Outcome of each unordered pair by aspect and prompt: the winner if at least two usable verdicts all agree, else null."""
    pair = F.array_sort(F.array("first", "second"))
    g = verdicts.groupBy("aspect", "prompt_id", pair[0].alias("a"), pair[1].alias("b"))
    return g.agg(F.count("winner").alias("usable"), F.when((F.count("winner") >= 2) & (F.count_distinct("winner") == 1), F.max("winner")).alias("outcome"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two outcome tables over the same keys: pairs with an outcome in both, how many agree, and keys that only one has."""
    both = left.select(*keys, F.col(value).alias("x"), F.lit(1).alias("in_left")).join(right.select(*keys, F.col(value).alias("y"), F.lit(1).alias("in_right")), keys, "full")
    return both.agg(F.count("*").alias("keys"), F.count(F.when(F.col("in_left").isNull() | F.col("in_right").isNull(), 1)).alias("one_sided"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("compared"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("agree"))


def against_anchor(judged: DataFrame, anchor: DataFrame) -> DataFrame:
    """Judgements that have a human label, streaming before batch where a clip has both; judged: provider, clip_id, mode, label; anchor: provider, clip_id, human."""
    first = F.row_number().over(Window.partitionBy("provider", "clip_id").orderBy(F.when(F.col("mode") == "stream", 0).otherwise(1), "label"))
    return judged.withColumn("__n", first).where("__n = 1").drop("__n").join(anchor, ["provider", "clip_id"])


def mean_score_alerts(scores: DataFrame, baseline: DataFrame, drop: float = 0.3) -> DataFrame:
    """Mean by provider beside the baseline's; an alert where it fell by more than drop. A provider without baseline has none."""
    now = scores.groupBy("provider").agg(F.count("*").alias("clips"), F.avg("score").alias("mean"))
    both = now.join(baseline.select("provider", F.col("mean").alias("baseline")), "provider", "left").withColumn("delta", F.col("mean") - F.col("baseline"))
    return both.withColumn("alert", F.coalesce(F.col("delta") < -drop, F.lit(False)))


def segment_similarity(rows: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """key and similarity in [0, 1]: segments of the alignment weighted by their longer side; equal ones count 1, deleted and inserted ones 0, substituted ones the cosine of their two texts' vectors.

    rows: key, reference, text, language; vectors: text (tokens joined by a space), vector. Two empty texts are alike (1), an empty one and another aren't (0). A segment whose vector is missing, null or
    zero counts 0, and so does a negative cosine. Vectors are joined by text, so encoders stay outside."""
    tokens = [languages.tokens(languages.normalize(F.coalesce(c, F.lit("")), F.col("language")), F.col("language")) for c in ("reference", "text")]
    told = rows.select(*key, tokens[0].alias("r"), tokens[1].alias("h"))
    each = told.select(*key, "r", "h", F.explode_outer(alignment("r", "h")).alias("s"))
    side = lambda t, a, b: F.array_join(F.slice(t, F.col(f"s.{a}") + 1, F.col(f"s.{b}") - F.col(f"s.{a}")), " ")
    weight = F.greatest(F.col("s.ref_to") - F.col("s.ref_from"), F.col("s.hyp_to") - F.col("s.hyp_from"))
    swapped = F.col("s.kind") == "substitute"
    parts = each.select(*key, F.col("s.kind").alias("kind"), weight.alias("weight"), F.when(swapped, side("r", "ref_from", "ref_to")).alias("left_text"), F.when(swapped, side("h", "hyp_from", "hyp_to")).alias("right_text"))
    known = vectors.dropDuplicates(["text"])
    both = parts.join(known.select(F.col("text").alias("left_text"), F.col("vector").alias("x")), "left_text", "left").join(known.select(F.col("text").alias("right_text"), F.col("vector").alias("y")), "right_text", "left")
    score = F.when(F.col("kind") == "equal", 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("x"), F.col("y")))), F.lit(0.0)))
    return both.groupBy(*key).agg(F.coalesce(F.sum(F.col("weight") * score) / F.sum("weight"), F.lit(1.0)).alias("similarity"))


def judge_counts(rows: DataFrame) -> DataFrame:
    """provider, mode, judge and edits by kind of what judges heard, over warm runs without an error that a judge answered.

    rows: provider, mode, language, reference, error, cold, roundtrip (array of provider, text, error). A null roundtrip is none; a null text of a judge without an error is an empty one."""
    warm = rows.where("error is null and not coalesce(cold, false)").select("provider", "mode", "language", "reference", F.explode("roundtrip").alias("j"))
    heard = warm.where("j.error is null and j.provider is not null").select("provider", "mode", "language", "reference", F.col("j.provider").alias("judge"), F.coalesce("j.text", F.lit("")).alias("text"))
    return with_edit_kinds(heard).groupBy("provider", "mode", "judge").agg(F.count("*").alias("clips"), *[F.sum(k).alias(k) for k in KINDS])


def roundtrip_table(counts: DataFrame, families: DataFrame, threshold: float = 0.02) -> DataFrame:
    """One row per provider and mode: the rate pooled over judges of other families, whether judges' rates lie further apart than threshold, and for each judge in the data its
    rate and whether it is of the provider's own family. families: key, family; a key without one is its own."""
    counts = kept(counts, "judge-counts")
    own = families.select(F.col("key").alias("provider"), F.col("family").alias("of"))
    theirs = families.select(F.col("key").alias("judge"), F.col("family").alias("judge_of"))
    told = counts.join(own, "provider", "left").join(theirs, "judge", "left").withColumn("same", F.coalesce("of", "provider") == F.coalesce("judge_of", "judge"))
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    told = told.withColumn("errors", errors).withColumn("rate", F.col("errors") / F.nullif(F.col("reference_length"), F.lit(0)))
    pooled = F.sum(F.when(~F.col("same"), F.col("errors"))) / F.nullif(F.sum(F.when(~F.col("same"), F.col("reference_length"))), F.lit(0))
    apart = (F.count("rate") >= 2) & (F.max("rate") - F.min("rate") > threshold)
    ranked = told.groupBy("provider", "mode").agg(pooled.alias("roundtrip_error_rate"), apart.alias("diverged"))
    judges = [r[0] for r in counts.select("judge").distinct().orderBy("judge").limit(1001).collect()]
    if len(judges) > 1000:
        raise ValueError("more than 1000 judges can't be columns")
    cells = told.groupBy("provider", "mode").pivot("judge", judges).agg(F.first("rate").alias("rate"), F.first("same").alias("same"))
    return ranked.join(cells.select("provider", "mode", *[F.col(f"`{j}_{k}`").alias(f"rt[{j}]" if k == "rate" else f"rt_own[{j}]") for j in judges for k in ("rate", "same")]), ["provider", "mode"])


def compared_in_full(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """compare() of two tables that have to hold the same keys; a key that only one has fails the job."""
    told = compare(left, right, keys, value)
    off = F.when(F.col("one_sided") > 0, F.raise_error(F.concat(F.lit("keys that only one of the two tables has: "), F.col("one_sided").cast("string"))).cast("long")).otherwise(F.col("one_sided"))
    return told.withColumn("one_sided", off)
