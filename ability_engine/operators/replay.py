"""Replay of the forecasts over a grid of dates, each with the fit as of its date: predicted against actual dates and abilities.

The grid never multiplies observations. What a release adds to the system of equations depends on its own scores only, so its sums go to the first date of the
grid that knows it, and the system of a date is the sum of all buckets up to it: prefix sums of matrices of the basket's size. The residual sigma is
a quadratic form in the difficulties whose coefficients are such sums as well, so no residual is looked at a second time.

Of a lab, a date needs the last few flagships that are fitted. A window keeps the last few of each bucket, so a lab costs a few rows for each date of
the grid, however many releases it has. Their abilities are those of the date: their scores meet the date's difficulties within the row.

All of a date's quantities are keyed by its place ``k`` in the grid; the last place is today, which knows everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.functions.scalar import index_of, theta_of
from ability_engine.operators import fit, forecast

POINTS = 5
FOREVER = "9999-12-31"


def grid_places(grid: DataFrame) -> DataFrame:
    """k and asof: the dates of ``grid`` in order, and today after them. A row for each date."""
    dates = grid.select("asof").where("asof is not null").distinct()
    placed = dates.select((F.row_number().over(Window.orderBy("asof")) - 1).alias("k"), "asof")
    return placed.unionByName(placed.agg(F.count("*").cast("int").alias("k")).select("k", F.lit(FOREVER).cast("date").alias("asof")))


def buckets(dates: DataFrame, grid: DataFrame) -> DataFrame:
    """date and k of each date of ``dates``: the first place of the grid that knows it. One row for each day of the calendar."""
    days = dates.select("date").distinct().select("date", F.lit(0).alias("mark")).unionByName(grid.select(F.col("asof").alias("date"), F.lit(1).alias("mark")).distinct())
    before = Window.orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -1)
    return days.withColumn("k", F.coalesce(F.sum("mark").over(before), F.lit(0)).cast("int")).where("mark = 0").select("date", "k")


def score_rows(scores: DataFrame, releases: DataFrame, benches: DataFrame, grid: DataFrame) -> DataFrame:
    """k, release_id, lab, date, tier and row (benchmark, legacy, w, y; at most the basket's size) of each release with scores. One shuffle of the observations."""
    known = fit.known(scores, releases, benches)
    one = known.groupBy("release_id").agg(*[F.first(c).alias(c) for c in ("lab", "date", "tier")], F.collect_list(F.struct("benchmark", "legacy", "w", "y")).alias("row"))
    return one.join(buckets(releases, grid), "date")


def _terms(ridge: float) -> Column:
    """What a release adds to its bucket: a struct for each pair of its benchmarks, and one, without names, of what is a release's own."""
    o_, p_ = F.col("row"), F.col("row")
    held = F.aggregate(o_, F.lit(0.0), lambda acc, o: acc + o["w"])
    weighed = F.aggregate(o_, F.lit(0.0), lambda acc, o: acc + o["w"] * o["y"])
    zero = F.lit(0.0)

    def of(sums: Column) -> Column:
        held, weighed = sums["held"], sums["weighed"]
        total = held + ridge
        bend = (held + 2 * ridge) / (total * total)

        def term(o: Column, p: Column) -> Column:
            own = lambda x: F.when(o["benchmark"] == p["benchmark"], x).otherwise(zero)
            return F.struct(
                o["benchmark"].alias("benchmark"), p["benchmark"].alias("other"), o["legacy"].alias("legacy"), (o["w"] * p["w"] / total).alias("a"), (o["w"] * p["w"] * bend).alias("m"), own(o["w"]).alias("w"), own(o["w"] * (weighed / total - o["y"])).alias("d"),
                own(o["w"] * o["y"]).alias("wy"), own(o["w"] * o["y"] * o["y"]).alias("wyy"), own(o["w"] * weighed * bend).alias("q"), own(o["w"] / total).alias("z"),
            )

        whole = F.struct(
            F.lit("").alias("benchmark"), F.lit("").alias("other"), F.lit(False).alias("legacy"), held.alias("a"), (weighed * weighed * bend).alias("m"), F.lit(1.0).alias("w"), (weighed / total).alias("d"), *[zero.alias(n) for n in ("wy", "wyy", "q", "z")]
        )
        return F.concat(F.flatten(F.transform(o_, lambda o: F.transform(p_, lambda p: term(o, p)))), F.array(whole))

    return F.get(F.transform(F.array(F.struct(held.alias("held"), weighed.alias("weighed"))), of), F.lit(0))


SUMS = ("a", "m", "w", "d", "wy", "wyy", "q", "z")
FITS = "k int, sigma double, shift double, observed long, names array<string>, deltas array<double>"


def _solve(ridge: float):
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        whole, part = part[part["benchmark"] == ""].iloc[0], part[part["benchmark"] != ""]
        names = sorted(part["benchmark"].unique())
        n, at = len(names), {b: k for k, b in enumerate(names)}
        rows, cols = part["benchmark"].map(at).to_numpy(), part["other"].map(at).to_numpy()
        matrix = {s: np.zeros((n, n)) for s in ("a", "m")}
        for s, x in matrix.items():
            x[rows, cols] = part[s]
        own = part[part["benchmark"] == part["other"]].set_index("benchmark").loc[names]
        v = own["w"].to_numpy() + ridge
        anchor = ~own["legacy"].to_numpy(bool)
        system, right = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
        system[:n, :n] = np.eye(n) - matrix["a"] / v[:, None]
        system[:n, n], right[:n] = 1, own["d"].to_numpy() / v
        system[n, :n] = anchor / anchor.sum() if anchor.any() else 1 / n
        found = np.linalg.lstsq(system, right, rcond=None)[0]
        x, c = found[:n], found[n]
        # The sum of w (z - mean + c)^2, z = y + delta: mean is that of a release under the ridge.
        squares = own["wyy"].sum() + 2 * (own["wy"] * x).sum() + (own["w"] * x * x).sum()
        means = whole["m"] + 2 * (own["q"] * x).sum() + x @ matrix["m"] @ x
        total = squares - means + 2 * c * ridge * (whole["d"] + (own["z"] * x).sum()) + c * c * whole["a"]
        freedom = max(1.0, whole["a"] - (whole["w"] + n - 1))
        return pd.DataFrame({"k": [part["k"].iloc[0]], "sigma": [float(np.sqrt(max(0.0, total) / freedom))], "shift": [float(c)], "observed": [n], "names": [names], "deltas": [x.tolist()]})

    return solve


def fits(rows: DataFrame, last: Column, ridge: float = 0.05) -> DataFrame:
    """FITS: a row for each place of the grid that knows a score, up to ``last`` (an aggregate-free column: the greatest place), of the rows of ``score_rows``."""
    terms = rows.select("k", F.explode(_terms(ridge)).alias("t")).groupBy("k", "t.benchmark", "t.other").agg(F.first("t.legacy").alias("legacy"), *[F.sum(F.col("t")[s]).alias(s) for s in SUMS])
    pair = Window.partitionBy("benchmark", "other").orderBy("k")  # a row for each date of the grid
    so_far = pair.rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.coalesce(F.lead("k").over(pair) - 1, last)
    summed = terms.select("benchmark", "other", "legacy", "k", *[F.sum(s).over(so_far).alias(s) for s in SUMS], ahead.alias("_to"))
    return summed.withColumn("k", F.explode(F.sequence("k", "_to"))).drop("_to").groupBy("k").applyInPandas(_solve(ridge), FITS)


def theta_at(row: Column, names: Column, deltas: Column, shift: Column, ridge: float) -> Column:
    """Ability from a release's scores and a date's difficulties."""
    of = F.map_from_arrays(names, deltas)
    sums = F.aggregate(row, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x")), lambda acc, o: F.struct((acc["w"] + o["w"]).alias("w"), (acc["x"] + o["w"] * (o["y"] + of[o["benchmark"]])).alias("x")))
    return F.get(F.transform(F.array(sums), lambda s: s["x"] / (s["w"] + ridge)), F.lit(0)) - shift


def _carried(rows: DataFrame, places: DataFrame, value: str, backwards: bool = False) -> DataFrame:
    """lab, k and the value of the last bucket up to k (``backwards``: of the first one after k), for each place of the grid. rows: a row for each lab and bucket."""
    each = rows.select("lab").distinct().join(places.agg(F.max("k").alias("_most")), how="cross")  # one row
    spread = each.select("lab", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("k"))
    line = Window.partitionBy("lab").orderBy("k")  # a row for each date of the grid
    over = F.first(value, True).over(line.rowsBetween(1, Window.unboundedFollowing)) if backwards else F.last(value, True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return spread.join(rows, ["lab", "k"], "left").select("lab", "k", over.alias(value)).where(F.col(value).isNotNull())


def recent(rows: DataFrame, places: DataFrame, points: int = POINTS) -> DataFrame:
    """lab, k and recent: the last ``points`` fitted flagships (qualified ones if there are two) that place k knows, with their scores."""
    flagships = rows.where("tier = 'flagship'").withColumn("qualified", F.size("row") >= fit.MIN_QUALIFIED)
    newest = [F.desc("date"), F.desc("release_id")]

    def lasting(some: DataFrame, name: str) -> DataFrame:
        kept = some.withColumn("_n", F.row_number().over(Window.partitionBy("lab", "k").orderBy(*newest))).where(F.col("_n") <= points)
        back = Window.partitionBy("lab").orderBy("date", "release_id").rowsBetween(1 - points, 0)
        held = kept.withColumn(name, F.collect_list(F.struct("date", "release_id", "row")).over(back)).where("_n = 1")
        return _carried(held.select("lab", "k", name), places, name)

    every, good = lasting(flagships, "every"), lasting(flagships.where("qualified"), "good")
    return every.join(good, ["lab", "k"], "left").select("lab", "k", F.when(F.size("good") >= 2, F.col("good")).otherwise(F.col("every")).alias("recent"))


def latest(rows: DataFrame, releases: DataFrame, grid: DataFrame, places: DataFrame) -> DataFrame:
    """lab, k and latest: the flagships of the last day with one that place k knows, with their scores (null without)."""
    out = releases.where(F.col("status") == "released").where(F.coalesce("tier", F.lit("flagship")) == "flagship").select("lab", "release_id", "date").join(buckets(releases, grid), "date")
    last = out.withColumn("_n", F.rank().over(Window.partitionBy("lab", "k").orderBy(F.desc("date")))).where("_n = 1")
    scored = last.join(rows.select("release_id", "row"), "release_id", "left")
    return _carried(scored.groupBy("lab", "k").agg(F.collect_list(F.struct("release_id", "row")).alias("latest")), places, "latest")


def following(releases: DataFrame, grid: DataFrame, places: DataFrame) -> DataFrame:
    """lab, k, actual (date) and actual_id: the first flagship after place k, the first by id of its day."""
    out = releases.where(F.col("status") == "released").where(F.coalesce("tier", F.lit("flagship")) == "flagship").select("lab", "release_id", "date").join(buckets(releases, grid), "date")
    first = out.groupBy("lab", "k").agg(F.min(F.struct("date", "release_id")).alias("next"))
    return _carried(first, places, "next", backwards=True).select("lab", "k", F.col("next.date").alias("actual"), F.col("next.release_id").alias("actual_id"))


def backtest(
    scores: DataFrame, releases: DataFrame, benches: DataFrame, grid: DataFrame, ridge: float = 0.05, half_life: float = 730.0, prior_weight: float = 2.0, drift: bool = True, stretch: float = 1.0, windows: DataFrame | None = None, labs: DataFrame | None = None
) -> DataFrame:
    """A row for each date of ``grid`` (asof) and lab: predicted dates (p05 to p95) and theta, the first flagship after it with its date and its theta in today's fit, errors, in68 and in90.

    ``windows``: announced windows by asof and lab, which take the place of the statistical date. ``labs``: labs (lab) that get a row at each date, forecast or not; else those
    that have released something by then. The predicted theta is the lab's trend at the median date, between five points under its last index and the ceiling, or 0 without a trend.
    """
    places = grid_places(grid)
    rows = score_rows(scores, releases, benches, grid)
    solved = fits(rows, F.lit(places.count() - 1), ridge)
    numbered = places.where(F.col("asof") < F.lit(FOREVER).cast("date"))
    at = [F.col(c) for c in ("names", "deltas", "shift")]

    # The trend of what a lab had released by the date.
    some = recent(rows, places).join(solved, "k").select("lab", "k", "sigma", *at, F.explode("recent").alias("r"))
    dated = some.select("lab", "k", "sigma", F.unix_date("r.date").cast("double").alias("x"), theta_at(F.col("r.row"), *at, ridge).alias("theta"))
    trends = forecast.fitted_trend(dated, ("lab", "k"))
    heads = latest(rows, releases, grid, places).join(solved, "k", "left").select("lab", "k", *at, F.explode("latest").alias("r"))
    index = F.when(F.col("r.row").isNotNull() & F.col("names").isNotNull(), index_of(theta_at(F.col("r.row"), *at, ridge)))
    last = heads.groupBy("lab", "k").agg(F.coalesce(F.max(index), F.lit(0.0)).alias("last_index"))

    laws = forecast.laws(releases, numbered.select("asof"), half_life, prior_weight, drift)
    predicted = forecast.chain(laws, 1, stretch, windows).drop("k").join(numbered, "asof").select("lab", "k", *forecast.QUANTILES, "source")
    low, high = theta_of(F.greatest(F.lit(0.5), F.col("last_index") - 5)), theta_of(F.lit(99.5))
    trend = F.least(F.greatest(F.col("intercept") + F.col("slope") * F.unix_date("p50"), low), high)
    made = predicted.join(trends.select("lab", "k", "slope", "intercept"), ["lab", "k"], "left").join(last, ["lab", "k"], "left")
    made = made.select("lab", "k", *forecast.QUANTILES, "source", F.when(F.col("slope").isNotNull(), trend).otherwise(0.0).alias("predicted_theta"))

    today = solved.join(places.agg(F.max("k").alias("k")), "k").select(*at)
    coming = following(releases, grid, places).join(numbered.select("k"), "k")
    scored = rows.select(F.col("release_id").alias("actual_id"), "row").join(coming.select("actual_id").distinct(), "actual_id").crossJoin(F.broadcast(today))  # one row
    abilities = scored.select("actual_id", theta_at(F.col("row"), *at, ridge).alias("actual_theta"))
    actual = coming.join(abilities, "actual_id", "left")
    every = made.select("lab", "k") if labs is None else labs.select("lab").distinct().join(numbered.select("k"), how="cross")
    met = every.join(made, ["lab", "k"], "left").join(actual, ["lab", "k"], "left").join(numbered, "k")
    return met.select(
        "asof", "lab", *forecast.QUANTILES, "source", "predicted_theta", "actual_id", "actual", "actual_theta", F.datediff("actual", "p50").alias("error_days"), F.col("actual").between(F.col("p16"), F.col("p84")).alias("in68"),
        F.col("actual").between(F.col("p05"), F.col("p95")).alias("in90"), (F.col("actual_theta") - F.col("predicted_theta")).alias("theta_error"),
    )


def drift_per_year(releases: DataFrame, to: DataFrame, half_life: float = 730.0) -> DataFrame:
    """asof and the pooled drift of log gaps a year, null without gaps; to: asof."""
    found = forecast.prior(forecast.intervals(forecast.event_dates(releases)), to, half_life)
    return found.select("asof", F.when(F.col("n") > 0, F.col("drift") * 365).alias("drift_per_year"))
