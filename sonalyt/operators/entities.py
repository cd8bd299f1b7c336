"""What lanes make of entities: tagged references aligned with transcripts, scores by class summed by lane, and tables of them.

Rows hold provider, mode, language, reference, annotated (the reference with inline tags, null where rules are to tag it), text, error. Each different combination of
annotation and transcript is aligned once. Failed rows have no scores. A null reference or one without anything to tag has none either; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import SCORE
from ..functions.entities import entity_scores, tagged_by_rule
from ..functions.text import subtag
from ..sources.folders import kept
from .lanes import LANE

COUNTS = SCORE.names[1:]


def with_scores(rows: DataFrame) -> DataFrame:
    """rows with `entities`: an array of class, occurrences, exact, substitutions, deletions, insertions, tokens; null for failed rows."""
    key = F.when(F.col("error").isNull(), F.sha2(F.to_json(F.struct("language", "reference", "annotated", "text")), 256))
    keyed = rows.withColumn("entity_key", key)
    once = keyed.where("entity_key is not null").select("entity_key", "language", "reference", "annotated", "text").dropDuplicates(["entity_key"])
    once = once.withColumn("said_key", F.when(F.col("annotated").isNull(), F.sha2(F.to_json(F.struct("language", "reference")), 256)))
    said = once.where("said_key is not null").dropDuplicates(["said_key"]).select("said_key", tagged_by_rule(F.col("reference"), F.col("language")).alias("tagged"))  # lanes share references
    told = once.join(said.hint("merge"), "said_key", "left").select("entity_key", entity_scores(F.coalesce("annotated", "tagged"), F.col("text"), F.coalesce(subtag(F.col("language")), F.lit(""))).alias("entities"))
    return keyed.join(told.hint("merge"), "entity_key", "left").drop("entity_key")  # grows with the rows, so it never goes to the driver to be broadcast


def damaged(entities: Column) -> Column:
    """Whether any entity has an error; null where nothing is tagged."""
    return F.when(F.size(entities) > 0, F.exists(entities, lambda e: e.substitutions + e.deletions + e.insertions > 0))


def by_class(scored: DataFrame) -> DataFrame:
    """provider, mode, language, class: sums of the scores, the error rate over all tokens of the class, and the share of entities said without error."""
    each = scored.select(*LANE, "language", F.explode("entities").alias("e")).select(*LANE, "language", "e.*")
    total = each.groupBy(*LANE, "language", "class").agg(*[F.sum(c).alias(c) for c in COUNTS])
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return total.withColumn("error_rate", errors / F.nullif(F.col("tokens"), F.lit(0))).withColumn("exact_rate", F.col("exact") / F.nullif(F.col("occurrences"), F.lit(0)))


def as_map(classes: DataFrame) -> DataFrame:
    """One row per lane and language with its scores as a map by class: sums of such maps are sums of the rows they come from."""
    fields = F.struct(*[F.col(c) for c in (*COUNTS, "error_rate", "exact_rate")])
    return classes.groupBy(*LANE, "language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class"), fields.alias("score"))))).alias("entities"))


def wide(classes: DataFrame) -> DataFrame:
    """One row per lane and language with columns ent_err[class] and ent_exact[class] for the classes that occur (at most a few, found from the data)."""
    classes = kept(classes, "classes")
    found = [r[0] for r in classes.select("class").distinct().orderBy("class").collect()]
    pivoted = classes.groupBy(*LANE, "language").pivot("class", found).agg(F.first("error_rate").alias("err"), F.first("exact_rate").alias("exact"))
    return pivoted.select(*LANE, "language", *[F.col(f"{c}_{k}").alias(f"ent_{k}[{c}]") for c in found for k in ("err", "exact")])
