"""Soft-membership mixing of documents to target weights of domains, with DataFrame functions alone.

A naive Bayes classifier, counted on a bounded sample of labelled rows, gives each document a posterior over the domains.
Nonnegative document rates are fitted so that the domains' expected token totals, sums of rate x tokens x posterior,
come as near as they can, in least squares, to the targets: each projected-gradient step is one aggregation of a small table to as many
sums as there are domains, and a document's rate is replayed from the few residuals so far. Scaled by tokens and by domain
totals the problem's largest eigenvalue is at most 1, so a step of 1 converges.

Nulls: a null text has no tokens and gets the classifier's prior. A row without doc_id forms one document with the others
without. Repeated rows of one doc_id are one document with the tokens of all. A domain without labelled rows keeps a prior near
zero; one that holds less than LEAST of all tokens can't be brought to a target by any sane rate, so the others share its weight.
No labelled rows: posteriors are equal. Ties in the choice of words go by the word. Very long texts count all their words; tokens are words
here, told by white space. Empty table: empty result. Other columns aren't read, and clash with nothing.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

TARGETS = {"en": 0.50, "fr": 0.20, "de": 0.18, "es": 0.12}
LABELLED = 4000  # labelled documents that the classifier counts at most, the first by a hash of doc_id
VOCABULARY = 2000  # words that it knows, the most frequent in that sample; this bounds what is broadcast
EVIDENCE = 30  # a document's words weigh together as so many at most, so that posteriors stay soft
STEPS, CLOSE = 40, 1e-7
LEAST, FAR = 1e-4, 0.01  # share of tokens below which a domain is out of reach; share by which a target may be missed without a warning
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word; a document without words has one row with an empty word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), _SPACE)).alias("word"))


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = LABELLED, vocabulary: int = VOCABULARY) -> tuple[DataFrame, list[float]]:
    """(word, w: log P(word | domain) by domain) and the log priors; labelled: doc_id, domain."""
    some = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain").dropDuplicates(["doc_id"])
    some = cut(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` rows, so the broadcast below is bounded
    have = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    priors = [math.log((have.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    counts = words_of(told, "domain").where("word != ''")
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    counts = cut(counts.orderBy(F.desc("n"), "word").limit(vocabulary))
    sums = counts.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(domains))]).first()
    weights = F.array(*[F.log((F.col(f"n{i}") + 0.5) / F.lit(sums[f"n{i}"] + 0.5 * sums["v"] + 0.5)) for i in range(len(domains))])
    return counts.select("word", weights.alias("w")), priors


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], evidence: int = EVIDENCE) -> DataFrame:
    """doc_id, n_tokens, p: the posterior by domain."""
    each = words_of(docs).join(F.broadcast(weights), "word", "left").groupBy("doc_id").agg(
        F.count(F.when(F.col("word") != "", 1)).alias("n_tokens"), F.count("w").alias("hits"), *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"l{i}") for i in range(len(priors))]
    )
    scale = F.lit(float(evidence)) / F.greatest(F.col("hits"), F.lit(evidence))
    logs = each.withColumn("l", F.array(*[F.col(f"l{i}") * scale + p for i, p in enumerate(priors)]))
    raised = logs.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.withColumn("t", total).select("doc_id", "n_tokens", F.transform("e", lambda x: x / F.col("t")).alias("p"))


def rate(history: list[list[float]]):
    """A document's rate after the steps whose scaled residuals are given."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(x) for x in e]) for e in history])
    return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r + F.aggregate(F.zip_with("p", e, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)))


def fit(members: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> list[list[float]]:
    """Scaled residuals of the steps taken; members: n_tokens, p. Only sums by domain come to the driver."""

    def totals(r):
        row = members.select("n_tokens", "p", r.alias("r")).agg(*[F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[k]).alias(str(k)) for k in range(len(targets))]).first()
        return [x or 0.0 for x in row]

    start = totals(F.lit(1.0))
    whole = sum(start)
    within = [s > LEAST * whole for s in start]
    sought = sum(t for t, w in zip(targets, within, strict=True) if w)
    aims = [t / sought * whole if w and sought else s for t, w, s in zip(targets, within, start, strict=True)]
    history: list[list[float]] = []
    now = start
    for _ in range(steps):
        if whole == 0 or max(abs(a - g) for a, g, w in zip(aims, now, within, strict=True) if w) <= close * whole:
            break
        history.append([(a - g) / s if w else 0.0 for a, g, s, w in zip(aims, now, start, within, strict=True)])
        now = totals(rate(history))
    off = max((abs(a - g) for a, g, w in zip(aims, now, within, strict=True) if w), default=0.0)
    if whole and off > FAR * whole:
        warnings.warn(f"after {len(history)} steps a domain is {off / whole:.1%} of all tokens away from its target", stacklevel=2)
    return history


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, keep_all: bool = False, **how) -> DataFrame:
    """doc_id, n_tokens, p (by domain, in the order of targets), rate, copies.

    copies is the rate's whole part, plus one with the chance of its fraction, decided by a hash of doc_id. With keep_all
    rates are scaled so that a document that is wholly of the least wanted domain is kept just once, and none is below 1, so none goes.
    """
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets need nonnegative weights, one of them positive")
    domains = list(targets)
    weights, priors = word_weights(docs, labelled, domains, **how)
    members = cut(posteriors(docs, weights, priors))
    history = fit(members, list(targets.values()))
    scale = 1.0
    if keep_all:
        pure = []
        for k in range(len(domains)):
            r = 1.0
            for e in history:
                r = max(0.0, r + e[k])
            pure.append(r)
        scale = 1.0 / min((r for r in pure if r > 0), default=1.0)
    fitted = rate(history) * scale
    rates = members.withColumn("rate", F.greatest(fitted, F.lit(1.0)) if keep_all else fitted)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    return rates.select("doc_id", "n_tokens", "p", "rate", (whole + (chance < F.col("rate") - whole).cast("long")).alias("copies"))


def remix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, **how) -> DataFrame:
    """The rows of docs, each as often as mix() says."""
    key, times, copy = (fresh(docs, x) for x in ("mixed_doc", "mixed_times", "mixed_copy"))
    often = mix(docs, labelled, targets, **how).select(F.col("doc_id").alias(key), F.col("copies").alias(times))
    both = docs.join(often, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query: documents that labels covers, with their language as the domain."""
    covered = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, languages(docs, table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "n_tokens", *[F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(TARGETS)], F.round("rate", 6).alias("rate"), "copies")
