"""Weighted ridge Rasch fit of abilities (by release) and difficulties (by benchmark), as of any number of dates at once.

The alternating least squares fixed point is linear in the difficulties: with W = sum of weights of a release plus the ridge and V = that of a
benchmark, ``(I - A) delta + c = d`` under ``mean(delta over the anchors) = 0``, where ``A[b, b'] = sum_m w_b w_b' / W_m / V_b``. Spark gathers each
release's row of at most the basket's size, pairs it within the row and sums A and d; what is solved is one system of the basket's size for
each date. So there is one shuffle of the observations, and sums before all others: the fit grows with releases in executors, not in the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.functions.scalar import index_of, logit, probability_of, rating_of

#: Words that say nothing about a configuration.
CONFIG_STOPWORDS = (
    "or the lab default record in config a an and of for to on from if is it e g eg etc that which what when only use used usually all else fall back"
).split()
MIN_QUALIFIED = 3


def config_tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(CONFIG_STOPWORDS))


def select_scores(scores: DataFrame, benches: DataFrame) -> DataFrame:
    """One score of each release and index benchmark: official first, then a matching configuration, then list order."""
    scale = [c for c in ("unit", "elo_reference") if c in benches.columns]
    dim = benches.where("in_index").select("benchmark", "basket_pos", "weight", "legacy", "preferred_config", *scale)
    matched = F.arrays_overlap(config_tokens(F.col("config")), config_tokens(F.col("preferred_config")))
    rank = F.when(F.col("reported_by") == "official", 0).otherwise(2) + F.when(matched, 0).otherwise(1)
    best = F.min(F.struct(rank.alias("rank"), "score_pos", "value", "config", "reported_by")).alias("best")
    picked = scores.join(dim, "benchmark").groupBy("release_id", "benchmark").agg(best, *[F.first(c).alias(c) for c in ("basket_pos", "weight", "legacy", *scale)])
    return picked.select("release_id", "benchmark", "basket_pos", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"), "legacy", "best.value", "best.config", "best.reported_by", *scale)


def known(scores: DataFrame, releases: DataFrame, benches: DataFrame) -> DataFrame:
    """release_id, lab, date, tier, benchmark, y (logit), w and legacy of all released models."""
    out = releases.where(F.col("status") == "released").select("release_id", "lab", "date", F.coalesce("tier", F.lit("flagship")).alias("tier"))
    picked = select_scores(scores, benches)
    elo = ("unit", "elo_reference") if "unit" in picked.columns else ()
    return picked.withColumn("y", logit(probability_of("value", *elo))).join(out.hint("merge"), "release_id").withColumnRenamed("weight", "w")


def observations(scores: DataFrame, releases: DataFrame, benches: DataFrame, asof: DataFrame) -> DataFrame:
    """asof, release_id, benchmark, y (logit), w and legacy of what is released by each date of ``asof`` (asof)."""
    # Dates are a parameter: as a few rows in each task they leave the partitions of the scores as they are, which a cartesian product multiplies by its own.
    rows = known(scores, releases, benches).join(F.broadcast(asof), F.col("date") <= F.col("asof"))
    return rows.select("asof", "release_id", "lab", "date", "tier", "benchmark", "basket_pos", "value", "reported_by", "legacy", "y", "w")


def difficulties(obs: DataFrame, ridge: float = 0.05) -> DataFrame:
    """asof, benchmark, delta, shift (c) of every observed benchmark, and how many there are."""
    row = obs.groupBy("asof", "release_id").agg(F.collect_list(F.struct("benchmark", "legacy", "w", "y")).alias("row"))  # at most the basket's size
    total = F.aggregate("row", F.lit(ridge), lambda acc, o: acc + o["w"])
    mean = F.aggregate("row", F.lit(0.0), lambda acc, o: acc + o["w"] * o["y"]) / total
    one = row.select("asof", "row", total.alias("total"), mean.alias("mean")).select("asof", "row", "total", "mean", F.explode("row").alias("o"))
    pairs = one.select("asof", "total", "mean", "o", F.explode("row").alias("p"))
    same = F.col("o.benchmark") == F.col("p.benchmark")
    system = pairs.groupBy("asof", F.col("o.benchmark").alias("benchmark"), F.col("p.benchmark").alias("other")).agg(
        F.sum(F.col("o.w") * F.col("p.w") / F.col("total")).alias("a"), F.sum(F.when(same, F.col("o.w"))).alias("w"), F.sum(F.when(same, F.col("o.w") * (F.col("mean") - F.col("o.y")))).alias("d"), F.first("o.legacy").alias("legacy")
    )

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(part["benchmark"].unique())
        at = {b: k for k, b in enumerate(names)}
        n = len(names)
        system, right, anchor = np.zeros((n + 1, n + 1)), np.zeros(n + 1), np.zeros(n, bool)
        own = part[part["benchmark"] == part["other"]].set_index("benchmark")
        v = own["w"] + ridge
        for b, o, a in part[["benchmark", "other", "a"]].itertuples(index=False):
            system[at[b], at[o]] -= a / v[b]
        for b in names:
            right[at[b]], anchor[at[b]] = own["d"][b] / v[b], not own["legacy"][b]
        system[range(n), range(n)] += 1
        system[:n, n] = 1
        system[n, :n] = anchor / anchor.sum() if anchor.any() else 1 / n
        found = np.linalg.lstsq(system, right, rcond=None)[0]
        return pd.DataFrame({"asof": [part["asof"].iloc[0]] * n, "benchmark": names, "delta": found[:n], "shift": [found[n]] * n, "observed": [n] * n})

    return system.groupBy("asof").applyInPandas(solve, "asof date, benchmark string, delta double, shift double, observed long")


def residuals(obs: DataFrame, deltas: DataFrame, ridge: float = 0.05) -> DataFrame:
    """The observations with theta, the predicted percentage and the residual in logits."""
    both = obs.join(F.broadcast(deltas), ["asof", "benchmark"])  # a row for each date and benchmark
    w, release = F.col("w"), Window.partitionBy("asof", "release_id")  # at most the basket's size
    out = both.withColumn("theta", F.sum(w * (F.col("y") + F.col("delta"))).over(release) / (F.sum(w).over(release) + ridge) - F.col("shift"))
    margin = F.col("theta") - F.col("delta")
    return out.withColumn("predicted", index_of(margin)).withColumn("residual", F.col("y") - margin)


def _sums(rows: DataFrame, *by: str, **more: Column) -> DataFrame:
    w = F.col("w")
    return rows.groupBy("asof", "release_id", *by).agg(F.sum("w").alias("sw"), F.sum(w * F.col("residual") ** 2).alias("ss"), F.first("observed").alias("observed"), *[c.alias(n) for n, c in more.items()])


def _sigma(sums: DataFrame) -> DataFrame:
    total = sums.groupBy("asof").agg(F.sum("sw").alias("sw"), F.sum("ss").alias("ss"), F.count("*").alias("models"), F.first("observed").alias("observed"))
    freedom = F.greatest(F.lit(1.0), F.col("sw") - (F.col("models") + F.col("observed") - 1))
    return total.select("asof", F.sqrt(F.col("ss") / freedom).alias("sigma"))


def sigma(rows: DataFrame) -> DataFrame:
    """asof and the residual sigma of what ``residuals`` gives."""
    return _sigma(_sums(rows))


def models(rows: DataFrame, basket_size: Column) -> DataFrame:
    """``basket_size``: an aggregate of ``rows``. A row for each asof and fitted release: theta, index, rating, standard error, band, evidence and whether it is qualified.

    Sigma is taken from the same sums by release, so the residual rows are read once.
    """
    one = _sums(rows, "lab", "date", "tier", theta=F.first("theta"), n=F.count("*"), basket=basket_size)
    both = one.join(_sigma(one), "asof")
    se, theta = F.col("se"), F.col("theta")
    return both.withColumn("se", F.col("sigma") / F.sqrt("n")).select(
        "asof", "release_id", "lab", "date", "tier", "theta", index_of(theta).alias("index"), rating_of(theta).alias("rating"), "se",
        index_of(theta - se).alias("index_low"), index_of(theta + se).alias("index_high"), "n", (F.col("n") / F.col("basket")).alias("coverage"), (F.col("n") >= MIN_QUALIFIED).alias("qualified"), "sigma",
    )


def fit_observed(obs: DataFrame, benches: DataFrame, ridge: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, difficulties, residual rows) of observations. Only the difficulties, a row for each date and benchmark, are cached: persist ``obs`` where more than one is used."""
    deltas = difficulties(obs, ridge).persist()
    rows = residuals(obs, deltas, ridge)
    size = benches.where("in_index").agg(F.count("*").cast("double").alias("_size"))
    return models(rows.crossJoin(F.broadcast(size)), F.first("_size")), deltas, rows  # one row


def fit(scores: DataFrame, releases: DataFrame, benches: DataFrame, asof: DataFrame, ridge: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, difficulties, residual rows) as of every date of ``asof``."""
    return fit_observed(observations(scores, releases, benches, asof), benches, ridge)
