"""Ranks, skylines, samples and votes."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def average_rank(rows: DataFrame, groups: list[str], score: str, *, descending: bool = False, name: str = "rank") -> DataFrame:
    """Ties share their mean rank; missing scores come last and share the mean of the places left."""
    by = Window.partitionBy(*groups)
    order = F.desc_nulls_last(score) if descending else F.asc_nulls_last(score)
    first = F.rank().over(by.orderBy(order))
    same = F.count(F.lit(1)).over(Window.partitionBy(*groups, score))
    return rows.withColumn(name, first + (same - 1) / F.lit(2.0))


def composite(rows: DataFrame, system: str, cell: list[str], metrics: dict[str, bool]) -> DataFrame:
    """Mean rank of a system over cells and metrics (True: higher is better); a cell where all of a metric is missing is left out."""
    parts = []
    for metric, descending in metrics.items():
        any_there = F.count(metric).over(Window.partitionBy(*cell))
        there = rows.withColumn("__any", any_there).where("__any > 0")
        parts.append(average_rank(there, cell, metric, descending=descending, name="__rank").select(system, "__rank"))
    ranks = reduce(DataFrame.union, parts)
    return ranks.groupBy(system).agg(F.avg("__rank").alias("mean_rank"), F.count("*").alias("cells")).orderBy("mean_rank", system)


def pareto(rows: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """Rows that no other beats in one of x and y while being no worse in the other; lower is better, exact ties all stay."""
    own = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(x)
    before = F.min("__y").over(own.rowsBetween(Window.unboundedPreceding, -1))
    at_x = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(groups or []), x).agg(F.min(y).alias("__y"))
    best = at_x.withColumn("__before", before).where("__before is null or __y < __before").drop("__before")
    return rows.join(best, [*(groups or []), x]).where(F.col(y) == F.col("__y")).drop("__y")


def min_max(column: str, groups: list[str]) -> Column:
    """(value - least) / span within the group, 0 where the span is 0."""
    w = Window.partitionBy(*groups)
    span = F.max(column).over(w) - F.min(column).over(w)
    return F.when(span > 0, (F.col(column) - F.min(column).over(w)) / span).when(F.col(column).isNotNull(), 0.0)


def draw(seed: int, *columns: str) -> Column:
    """A reproducible random order by key: the same rows for a seed whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample(rows: DataFrame, count: int, seed: int, *key: str) -> DataFrame:
    return rows.withColumn("__d", draw(seed, *key)).orderBy("__d").limit(count).drop("__d")


def capped_sample(rows: DataFrame, count: int, group: str, key: str, seed: int, per_group: int = 3) -> DataFrame:
    """At most per_group rows of each group, then count rows, in random order by seed."""
    d = draw(seed, group, key)
    few = rows.withColumn("__d", d).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("__d", key))).where(F.col("__n") <= per_group)
    return few.orderBy("__d", key).limit(count).drop("__d", "__n")


def round_robin(rows: DataFrame, count: int, strata: list[str], key: str, seed: int, group: str | None = None, per_group: int = 3) -> DataFrame:
    """count rows, one from each stratum in turn, in random order within it; at most per_group of a group."""
    if group:
        rows = rows.withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, key), key))).where(F.col("__g") <= per_group).drop("__g")
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(draw(seed + 1, key), key))
    return rows.withColumn("turn", turn).orderBy("turn", *strata, key).limit(count)


def quota_take(rows: DataFrame, count: int, strata: list[str], key: str, session: str, seed: int, cap: int = 2, quota: str | None = None, quotas: dict[str, int] | None = None, tier: str | None = None, most: int = 1_000_000) -> DataFrame:
    """rows chosen in turn, with `place` from 1: one from each stratum, in random order within it, until there are `count` or none is left.

    At most `cap` rows of a session over all strata, and of each value of `quota` as many as `quotas` says (values it doesn't name: none). With `tier`, lower tiers are used up first;
    sessions and quotas count across tiers. Strata take turns in the order of their values, nulls first; rows of one draw go by key.

    The rule is sequential, but few rows can matter. Of a session's rows in one stratum only the first `cap` can be taken: after those it is full. The chosen rows fill at
    most count / cap sessions, so a stratum passes over at most `count` rows for full sessions and takes at most `count`. The first 2 x count rows of each stratum after that cut are all
    the rule can reach, and Spark brings those together; more than `most` fail the job. Null sessions are one session.
    """
    if count < 0 or cap < 1:
        raise ValueError("count can't be negative, cap has to be positive")
    if quota and quota not in strata:
        raise ValueError("a quota's column has to be one of the strata")
    tiers = [F.col(tier)] if tier else [F.lit(0)]
    drawn = rows.select(*[c.alias(f"__t{k}") for k, c in enumerate(tiers)], *[F.col(c).alias(f"__s{k}") for k, c in enumerate(strata)], F.col(key).alias("__key"), F.col(session).alias("__session"), (F.col(quota) if quota else F.lit(None)).alias("__quota"), draw(seed, session, key).alias("__d"))
    stratum = ["__t0", *[f"__s{k}" for k in range(len(strata))]]
    few = drawn.withColumn("__n", F.row_number().over(Window.partitionBy(*stratum, "__session").orderBy("__d", "__key"))).where(F.col("__n") <= cap)
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy(*stratum).orderBy("__d", "__key"))).where(F.col("__n") <= 2 * count).limit(most + 1)
    waiting: dict[tuple, list] = {}
    for k, r in enumerate(few.orderBy(*stratum, "__n").collect()):
        if k == most:
            raise ValueError(f"more than {most} rows can be reached")
        waiting.setdefault((r["__t0"], *[r[c] for c in stratum[1:]]), []).append(r)
    chosen, of_session, of_quota = [], Counter(), Counter()
    for level in dict.fromkeys(t for t, *_ in waiting):
        open_ = [iter(v) for (t, *_), v in waiting.items() if t == level]
        while open_ and len(chosen) < count:
            taken = []
            for stream in open_:
                if len(chosen) == count:
                    break
                found = next((r for r in stream if of_session[r["__session"]] < cap and (quotas is None or of_quota[r["__quota"]] < quotas.get(r["__quota"], 0))), None)
                if found is not None:
                    chosen.append(found["__key"])
                    of_session[found["__session"]] += 1
                    of_quota[found["__quota"]] += 1
                    taken.append(stream)
            open_ = taken
    places = rows.sparkSession.createDataFrame([(k, n) for n, k in enumerate(chosen, 1)], T.StructType([T.StructField("__key", rows.schema[key].dataType), T.StructField("place", T.IntegerType())]))
    return rows.join(F.broadcast(places), F.col(key) == F.col("__key")).drop("__key")


def majority(votes: DataFrame, item: list[str], label: str, severity: list[str]) -> DataFrame:
    """The most frequent label; of equals the one first in severity."""
    place = F.coalesce(reduce(lambda a, x: a.when(F.col(label) == x[1], x[0]), enumerate(severity), F.when(F.lit(False), -1)), F.lit(len(severity)))
    counted = votes.groupBy(*item, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.col(label), F.struct("n", (-place).alias("s")))
    return counted.groupBy(*item).agg(best.alias("majority"), F.sum("n").alias("votes"), (F.count("*") == 1).alias("unanimous"))


def kappa(pairs: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """Cohen's kappa: agreement beyond what the marginals give; 1 or 0 where chance alone explains all."""
    groups = groups or []
    n = pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    left = pairs.groupBy(*groups, F.col(a).alias("__label")).agg(F.count("*").alias("x"))
    right = pairs.groupBy(*groups, F.col(b).alias("__label")).agg(F.count("*").alias("y"))
    both = left.join(right, [*groups, "__label"]).groupBy(*groups).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    joined = n.join(both, groups, "left") if groups else n.crossJoin(both)  # one row each
    expected = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(expected >= 1, (F.col("observed") >= 1).cast("double")).otherwise((F.col("observed") - expected) / (1 - expected))
    return joined.select(*groups, "n", "observed", value.alias("kappa"))


def kappa_interval(pairs: DataFrame, a: str, b: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """n, kappa, low, high: the 95 % interval of a bootstrap over items. An item counts only by its pair of labels, so resampling items is a multinomial draw
    over the pairs' counts, which are as many as there are labels, squared."""

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["x"], *pdf["y"]})
        cells = np.zeros((len(names), len(names)))
        cells[pdf["x"].map(names.index), pdf["y"].map(names.index)] = pdf["n"]
        n = int(cells.sum())

        def value(c: np.ndarray) -> np.ndarray:
            seen, chance = np.trace(c, axis1=-2, axis2=-1) / n, (c.sum(-1) * c.sum(-2)).sum(-1) / n**2
            return np.where(chance >= 1, (seen >= 1) * 1.0, (seen - chance) / np.where(chance >= 1, 1, 1 - chance))

        draws = value(np.random.default_rng(seed).multinomial(n, cells.ravel() / n, replicates).reshape(replicates, *cells.shape))
        return pd.DataFrame({"n": [n], "kappa": [float(value(cells))], "low": [np.percentile(draws, 2.5)], "high": [np.percentile(draws, 97.5)]})

    counted = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n")).where("x is not null and y is not null")
    return counted.groupBy(F.lit(0).alias("all")).applyInPandas(drawn, "n long, kappa double, low double, high double")


def rater_agreement(votes: DataFrame, item: list[str], rater: str, label: str) -> DataFrame:
    """Percent agreement and kappa for each pair of raters over the items that both judged."""
    left = votes.select(*item, F.col(rater).alias("rater_a"), F.col(label).alias("label_a"))
    right = votes.select(*item, F.col(rater).alias("rater_b"), F.col(label).alias("label_b"))
    pairs = left.join(right, item).where("rater_a < rater_b")
    return kappa(pairs, "label_a", "label_b", ["rater_a", "rater_b"]).orderBy("rater_a", "rater_b")


def order_flips(verdicts: DataFrame) -> DataFrame:
    """Of pairs judged in both orders, how many have more than one winner, a tie being one of its own; verdicts: aspect, prompt_id, first, second, winner."""
    pair = F.array_sort(F.array("first", "second"))
    seen = verdicts.where("winner is not null").groupBy("aspect", "prompt_id", pair.alias("pair")).agg(F.count("*").alias("n"), F.count_distinct("winner").alias("winners")).where("n >= 2")
    return seen.groupBy("aspect").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("winners") > 1, 1)).alias("flips")).withColumn("flip_rate", F.col("flips") / F.col("pairs")).orderBy("aspect")


def wins_by(usable: DataFrame, groups: list[str]) -> DataFrame:
    """Credit of each ordered pair of systems within groups: 1 for a win, a half for a tie."""
    sides = [usable.select(*groups, F.col(x).alias("system"), F.col(y).alias("other"), F.when(F.col("winner") == F.col(x), 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("credit")) for x, y in (("first", "second"), ("second", "first"))]
    return sides[0].union(sides[1]).groupBy(*groups, "system", "other").agg(F.sum("credit").alias("wins"), F.count("*").alias("games"))


def wins(verdicts: DataFrame) -> DataFrame:
    return wins_by(verdicts.where("winner is not null"), [])


def strengths(won: np.ndarray, rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Bradley-Terry strengths of a matrix of wins, by minorisation-maximisation (Hunter, 2004); geometric mean 1."""
    games = won + won.T
    total = np.maximum(won.sum(axis=1), 1e-12)
    p = np.ones(len(won))
    for _ in range(rounds):
        new = np.maximum(total / np.maximum((games / (p[:, None] + p[None, :])).sum(axis=1), 1e-12), 1e-12)
        new /= np.exp(np.log(new).mean())
        done = np.abs(new - p).max() < close
        p = new
        if done:
            break
    return p


CLUSTER = 1024  # prompts of a block


def draws(total: int, sizes: np.ndarray, block: int, replicates: int, seed: int) -> np.ndarray:
    """How often each of a block's prompts is drawn in each replicate, when every replicate draws `total` prompts out of all blocks (sizes: prompts of each) with replacement.

    A replicate's draws are split down a tree of block ranges by binomial draws with the ranges' shares, then among the block's prompts; each node's generator is seeded by
    the replicate and the node, so blocks agree on what they share without seeing each other, and all counts of a replicate add up to `total`."""
    upto = np.append(0, np.cumsum(sizes))
    out = np.zeros((replicates, int(sizes[block])), np.int64)
    for r in range(replicates):
        low, high, n = 0, len(sizes), total
        while high - low > 1:
            middle = (low + high) // 2
            left = np.random.default_rng([seed, r, low, high]).binomial(n, (upto[middle] - upto[low]) / max(1, upto[high] - upto[low]))
            low, high, n = (low, middle, left) if block < middle else (middle, high, n - left)
        if sizes[block]:
            out[r] = np.random.default_rng([seed, r, block]).multinomial(n, np.full(int(sizes[block]), 1 / sizes[block]))
    return out


def bradley_terry(verdicts: DataFrame, replicates: int = 200, seed: int = 0, most: int = 1000, most_blocks: int = 1_000_000) -> DataFrame:
    """system, strength, low, high, wins (a tie is half a one), games: intervals from replicates that draw as many prompts as there are, with replacement.

    Prompts are dealt out into blocks of about CLUSTER by hash; a block's matrices of wins, one for each replicate, are made where its verdicts are and summed by Spark, and replicates are fitted in
    parallel. Nothing is known about all prompts in one place but the blocks' sizes. Rows without winner or prompt_id don't count; equal rows count each.
    """
    usable = verdicts.where("winner is not null and prompt_id is not null")
    systems = [r[0] for r in usable.select(F.explode(F.array("first", "second")).alias("s")).distinct().orderBy("s").limit(most + 1).collect()]
    if len(systems) > most:
        raise ValueError(f"more than {most} systems")
    prompts = usable.select("prompt_id").distinct()
    total = prompts.count()
    if total > most_blocks * CLUSTER:
        raise ValueError(f"more than {most_blocks} blocks of prompts")
    blocks = max(1, -(-total // CLUSTER))
    of = F.pmod(F.xxhash64("prompt_id"), F.lit(blocks)).cast("int").alias("block")
    sizes = np.zeros(blocks, np.int64)
    for block, n in prompts.groupBy(of).count().collect():
        sizes[block] = n
    place, n = {s: i for i, s in enumerate(systems)}, len(systems)

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        counts = np.vstack([np.ones(int(sizes[block]), np.int64), draws(total, sizes, block, replicates, seed)])
        prompt = pd.factorize(pdf["prompt_id"], sort=True)[0]
        pair = (pdf["system"].map(place) * n + pdf["other"].map(place)).to_numpy()
        used, at = np.unique(pair, return_inverse=True)
        own = np.zeros((counts.shape[1], len(used)))
        np.add.at(own, (prompt, at), pdf["wins"].to_numpy())
        summed = counts @ own
        replicate = np.repeat(np.arange(-1, replicates), len(used))
        return pd.DataFrame({"replicate": replicate, "pair": np.tile(used, replicates + 1), "wins": summed.ravel()})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(n * n)
        m[pdf["pair"]] = pdf["wins"]
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "system": list(place), "strength": strengths(m.reshape(n, n))})

    by_prompt = wins_by(usable, ["prompt_id"])
    summed = by_prompt.select(of, "*").groupBy("block").applyInPandas(matrices, "replicate int, pair long, wins double").groupBy("replicate", "pair").agg(F.sum("wins").alias("wins"))
    fitted = summed.groupBy("replicate").applyInPandas(fit, "replicate int, system string, strength double")
    drawn = F.when(F.col("replicate") >= 0, F.col("strength"))
    table = fitted.groupBy("system").agg(F.max(F.when(F.col("replicate") < 0, F.col("strength"))).alias("strength"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))
    return table.join(records(usable), "system", "left").orderBy(F.desc("strength"), "system")


def records(verdicts: DataFrame) -> DataFrame:
    """system, wins (a tie is half a one), games."""
    return wins_by(verdicts.where("winner is not null"), []).groupBy("system").agg(F.sum("wins").alias("wins"), F.sum("games").alias("games"))


def separated(scores: DataFrame) -> DataFrame:
    """Pairs of systems whose intervals don't overlap, the better first; scores has a row for each system."""
    a, b = scores.select(F.col("system").alias("better"), "low"), scores.select(F.col("system").alias("worse"), "high")
    return a.join(b, F.col("low") > F.col("high")).select("better", "worse")


def spearman(rows: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Correlation of average ranks; null where either has no variance."""
    ranked = average_rank(average_rank(rows, groups, a, name="__a"), groups, b, name="__b")
    spread = F.stddev_pop("__a") * F.stddev_pop("__b")
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), (F.covar_pop("__a", "__b") / F.nullif(spread, F.lit(0.0))).alias("rho"))


def permutation_p(a: list[float], b: list[float], most: int = 8, draws: int = 10_000, seed: int = 0) -> float:
    """Share of orders of b that correlate with a at least as well: all orders of up to `most`, else random ones."""
    x, y = np.array(a, float), np.array(b, float)
    x = x - x.mean()
    if len(x) <= most:
        orders = np.array(list(permutations(y)))
    else:
        r = np.random.default_rng(seed)
        orders = np.array([r.permutation(y) for _ in range(draws)] + [y])
    return float((orders @ x >= y @ x - 1e-12).mean())


def gate(rows: DataFrame, system: str, a: str, b: str, threshold: float = 0.8, most: int = 1000) -> DataFrame:
    """One row: systems, rank correlation of two scores, p value, and whether the gate passes; pending below three systems. rows has one row a system."""
    ranked = average_rank(average_rank(rows.withColumn("__g", F.lit(0)), ["__g"], a, name="__a"), ["__g"], b, name="__b")
    got = ranked.orderBy(system).select("__a", "__b").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} systems")
    x, y = [r[0] for r in got], [r[1] for r in got]
    flat = len(set(x)) < 2 or len(set(y)) < 2
    rho = None if flat else float(np.corrcoef(x, y)[0, 1])
    verdict = "pending" if len(got) < 3 else "uncomputable" if rho is None else "pass" if rho >= threshold else "fail"
    p = None if rho is None else permutation_p(x, y)
    return rows.sparkSession.createDataFrame([(len(got), rho, p, verdict)], "systems long, rho double, p double, verdict string")


def divergence(rows: DataFrame, system: str, a: str, b: str) -> DataFrame:
    """Where two rankings of systems part: system, both scores with their average ranks (a: higher is better, b: lower; nulls last), and the difference, the largest first."""
    keyed = rows.select(F.col(system).alias("system"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(0).alias("__g"))
    ranked = average_rank(average_rank(keyed, ["__g"], "a", descending=True, name="rank_a"), ["__g"], "b", name="rank_b")
    return ranked.select("system", "a", "b", "rank_a", "rank_b", (F.col("rank_a") - F.col("rank_b")).alias("delta")).orderBy(F.desc(F.abs("delta")), "system")


def mean_agreement(pairs: DataFrame) -> DataFrame:
    """One row: pairs of raters, the mean of their shares of equal labels and of their kappas, each pair counting alike; null without a pair. pairs: rater_a, rater_b, observed, kappa."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg("observed").alias("observed"), F.avg("kappa").alias("kappa"))
