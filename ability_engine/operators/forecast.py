"""Release forecasts: recency-weighted cadences, shrunk to a pooled prior, as of any number of dates, and their replay over history.

Every table is keyed by (asof, lab). The waiting law is log-normal given the time that has passed; quantiles may be stretched about its median.
Expressions that are used several times become columns of their own, so generated code stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.functions import scalar
from ability_engine.functions.scalar import clamp, lognormal_cdf, normal_pdf, normal_quantile, recency_weight, theta_of

#: Prior of a table without gaps; strength of the pull of the drift to 0 (days squared); what is left of a law that is overdue.
DEFAULT_MU, DEFAULT_SIGMA = math.log(120), 0.6
DRIFT_KAPPA = 730.0**2
OVERDUE = 1e-9
QUANTILES = {"p05": 0.05, "p16": 0.16, "p50": 0.5, "p84": 0.84, "p95": 0.95}
MOST_DAYS = 36_500.0


def event_dates(releases: DataFrame, tiers: tuple[str, ...] = ("flagship",)) -> DataFrame:
    """Distinct release dates of each lab."""
    return releases.where((F.col("status") == "released") & F.coalesce("tier", F.lit("flagship")).isin(*tiers)).select("lab", "date").distinct()


def intervals(dates: DataFrame) -> DataFrame:
    """lab, date (of the later release) and the gap in days before it."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("lab").orderBy("date")))
    return dates.withColumn("gap", gap).where("gap >= 1")


def _weighted(gaps: DataFrame, grid: DataFrame, half_life: float) -> DataFrame:
    both = gaps.join(grid, F.col("date") <= F.col("asof"))
    return both.select("asof", "lab", F.ln("gap").alias("x"), F.unix_date("date").cast("double").alias("t"), recency_weight(F.datediff("asof", "date"), half_life).alias("w"))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean and population variance of x, Kish's effective number and the mean of t. The variance in two passes."""
    w = F.col("w")
    mean = rows.groupBy(*by).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("mean"), (F.sum(w * F.col("t")) / F.sum(w)).alias("t_bar"), (F.sum(w) ** 2 / F.sum(w * w)).alias("n"), F.count("*").alias("gaps"))
    both = rows.join(mean, by)
    dx, dt = F.col("x") - F.col("mean"), F.col("t") - F.col("t_bar")
    return mean.join(both.groupBy(*by).agg((F.sum(w * dx * dx) / F.sum(w)).alias("variance"), (F.sum(w * dt * dx) / (F.sum(w * dt * dt) + DRIFT_KAPPA)).alias("drift")), by)


def prior(gaps: DataFrame, grid: DataFrame, half_life: float = 730.0) -> DataFrame:
    """asof, mu, sigma, n, drift (log days per day) and t_bar, pooled over labs; the defaults where there are no gaps."""
    found = _moments(_weighted(gaps, grid, half_life), ["asof"])
    c = lambda name, default: F.coalesce(name, F.lit(default)).alias(name)
    sigma = F.when(F.col("gaps") < 2, DEFAULT_SIGMA).otherwise(F.sqrt("variance"))
    rows = found.select("asof", F.col("mean").alias("mu"), sigma.alias("sigma"), "n", "drift", "t_bar")
    return grid.join(rows, "asof", "left").select("asof", c("mu", DEFAULT_MU), c("sigma", DEFAULT_SIGMA), c("n", 0.0), c("drift", 0.0), c("t_bar", 0.0))


def laws(releases: DataFrame, grid: DataFrame, half_life: float = 730.0, prior_weight: float = 2.0, drift: bool = True) -> DataFrame:
    """asof, lab, last (date of its latest flagship), t0 (days since), mu and sigma of every lab that has released by then."""
    dates = event_dates(releases)
    gaps = intervals(dates)
    pooled = prior(gaps, grid, half_life).select("asof", F.col("mu").alias("mu_0"), F.col("sigma").alias("sigma_0"), F.col("drift").alias("drift_0"), F.col("t_bar").alias("t_0"))
    own = _moments(_weighted(gaps, grid, half_life), ["asof", "lab"]).select("asof", "lab", "mean", "variance", "n", "t_bar")
    latest = dates.join(grid, F.col("date") <= F.col("asof")).groupBy("asof", "lab").agg(F.max("date").alias("last"))
    both = latest.join(own, ["asof", "lab"], "left").join(pooled, "asof")
    n, w = F.coalesce("n", F.lit(0.0)), prior_weight
    mean, variance = F.coalesce("mean", F.lit(0.0)), F.coalesce("variance", F.lit(0.0))
    shift = clamp(F.col("drift_0") * (F.unix_date("asof") - F.coalesce("t_bar", "t_0")), -1.0, 1.0) if drift else F.lit(0.0)
    mu = F.coalesce(F.try_divide(n * mean + w * F.col("mu_0"), n + w), F.col("mu_0")) + shift
    sigma = F.coalesce(F.sqrt(F.try_divide(n * variance + w * F.col("sigma_0") ** 2, n + w)), F.col("sigma_0"))
    return both.select("asof", "lab", "last", F.datediff("asof", "last").cast("double").alias("t0"), mu.alias("mu"), sigma.alias("sigma"))


def plain_quantiles(rows: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Adds, by name, quantiles of the wait T given T > t0; ``rows`` has mu, sigma and t0.

    On arrays: as columns, a few quantiles are more generated code than the JVM takes, and Spark then interprets them row by row.
    """
    law = rows.select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in ("mu", "sigma", "t0")])
    kept, names = rows.columns, list(quantiles)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mu, sigma, t0 = (batch.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            gone = scalar.lognormal_cdf_array(mu, sigma, t0)

            def wait(q: float) -> pa.Array:
                fresh = np.exp(mu + np.fmax(sigma, 0.0) * NormalDist().inv_cdf(q))
                later = np.where(sigma <= 0, np.exp(mu), np.exp(mu + sigma * scalar.normal_quantile_array(np.clip(gone + q * (1 - gone), 1e-12, 1 - 1e-12))))
                found = np.where(t0 <= 0, fresh, np.where(1 - gone < OVERDUE, t0 + 1, later))
                return pa.array(found, mask=np.isnan(found))

            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[wait(q) for q in quantiles.values()]], [*kept, *names])

    return law.mapInArrow(run, schema)


def bent(wait: Column, mid: Column, stretch: Column) -> Column:
    """A quantile of the wait, stretched about the median ``mid``."""
    return F.when((stretch <= 0) | (stretch == 1) | (mid <= 0) | (wait <= 0), wait).otherwise(mid * F.pow(wait / mid, stretch))


def wait_quantiles(rows: DataFrame, quantiles: dict[str, float], stretch: Column | None = None) -> DataFrame:
    """As ``plain_quantiles``, stretched about the median."""
    if stretch is None:
        return plain_quantiles(rows, quantiles)
    found = plain_quantiles(rows, {**quantiles, "_mid": 0.5})
    return found.select(*rows.columns, *[bent(F.col(n), F.col("_mid"), stretch).alias(n) for n in quantiles])


def wait_probability(rows: DataFrame, horizon: float, name: str, stretch: float = 1.0) -> DataFrame:
    """Adds P(T <= t0 + horizon | T > t0)."""
    kept = rows.columns
    plain = stretch <= 0 or stretch == 1
    out = rows.withColumn("_at", F.col("t0") + horizon) if plain else wait_quantiles(rows, {"_m": 0.5}).withColumn("_at", F.when(F.col("_m") > 0, F.col("_m") * F.pow((F.col("t0") + horizon) / F.col("_m"), F.lit(1 / stretch))).otherwise(F.col("t0") + horizon))
    out = out.withColumn("_gone", F.when(F.col("t0") > 0, lognormal_cdf("mu", "sigma", "t0")).otherwise(0.0)).withColumn("_by", lognormal_cdf("mu", "sigma", "_at"))
    p = F.when(F.lit(horizon) <= 0, 0.0).when(F.col("_at") <= F.col("t0"), 0.0).when(1 - F.col("_gone") < OVERDUE, 1.0).otherwise(clamp((F.col("_by") - F.col("_gone")) / (1 - F.col("_gone")), 0.0, 1.0))
    return out.select(*kept, p.alias(name))


def moved(date: str, days: Column) -> Column:
    """The date ``days`` later, halves rounded up and the offset kept within a century."""
    return F.date_add(F.col(date), F.floor(clamp(days, 0.0, MOST_DAYS) + 0.5).cast("int"))


def next_release(rows: DataFrame, stretch: Column | None = None) -> DataFrame:
    """The laws with the dates of the next release: p05, p16, p50, p84, p95."""
    found = wait_quantiles(rows, QUANTILES, stretch)
    return found.select(*rows.columns, *[moved("last", F.col(n)).alias(n) for n in QUANTILES])


def announced(releases: DataFrame, grid: DataFrame) -> DataFrame:
    """By asof and lab: the announced release of the earliest window that starts after asof. releases: lab, release_id, status, window_start, window_end."""
    open_ = releases.where("status = 'announced' and window_start is not null").join(grid, F.col("window_start") > F.col("asof"))
    first = F.min(F.struct("window_start", "release_id", "window_end")).alias("a")
    return open_.groupBy("asof", "lab").agg(first).select("asof", "lab", F.col("a.release_id").alias("release_id"), F.col("a.window_start").alias("window_start"), F.coalesce("a.window_end", "a.window_start").alias("window_end"))


def certainty(p16: Column, p84: Column) -> Column:
    """1 for a day, falling with the width of the window."""
    return 1 / (1 + F.greatest(F.lit(0), F.datediff(p84, p16)) / 90)


def chain(rows: DataFrame, count: int = 5, stretch: float = 1.0, windows: DataFrame | None = None, horizon: int | None = None) -> DataFrame:
    """asof, lab, k, the dates of the k-th next release, their certainty, source and release_id.

    From the second on, steps of the median, with a spread that grows as sqrt(k). A window of ``windows`` (see ``announced``) takes the place of the first
    release, and the chain goes on from its middle. ``horizon``: days after asof up to which statistical medians are given; one beyond it ends the chain.
    """
    first = wait_quantiles(rows, QUANTILES, F.lit(stretch))
    if windows is not None:
        first = first.join(windows, ["asof", "lab"], "left")
    else:
        first = first.withColumns({"release_id": F.lit(None).cast("string"), "window_start": F.lit(None).cast("date"), "window_end": F.lit(None).cast("date")})
    k, given = F.col("k"), F.col("window_start").isNotNull()
    width = F.greatest(F.lit(0), F.datediff("window_end", "window_start"))
    first = first.withColumn("_len", width).withColumn("_mid", F.date_add("window_start", F.floor(F.col("_len") / 2 + 0.5).cast("int")))
    first = first.withColumn("_anchor", F.coalesce("_mid", "last")).withColumn("_from", F.when(given, 0.0).otherwise(clamp(F.col("p50"), 0.0, MOST_DAYS)))
    steps = first.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("_off", clamp(F.col("_from") + (k - 1) * F.exp("mu"), 0.0, MOST_DAYS))
    spread = lambda q: F.col("_off") * F.exp(F.col("sigma") * stretch * F.sqrt(k) * NormalDist().inv_cdf(q))
    edge = {"p05": -0.15 * F.col("_len"), "p16": F.lit(0.0), "p50": F.col("_len") / 2, "p84": F.col("_len").cast("double"), "p95": 1.15 * F.col("_len")}
    shown = lambda n: F.date_add("window_start", F.floor(edge[n] + 0.5).cast("int"))
    days = {n: F.when((k == 1) & given, shown(n)).when(k == 1, moved("last", F.col(n))).otherwise(moved("_anchor", F.col("_off") if q == 0.5 else spread(q))) for n, q in QUANTILES.items()}
    kept = steps.columns
    dated = steps.select(*[c for c in kept if c not in QUANTILES], *[d.alias(n) for n, d in days.items()])
    own = (k == 1) & given
    if horizon is not None:
        # Medians grow with k, so whatever is beyond the horizon ends the chain.
        dated = dated.withColumn("_late", F.datediff("p50", "asof") > horizon).where(own | ~F.col("_late"))
    return dated.select("asof", "lab", "k", *QUANTILES, certainty(F.col("p16"), F.col("p84")).alias("certainty"), F.when(own, "announced").otherwise("statistical").alias("source"), F.when(own, F.col("release_id")).alias("release_id"))


def anchors(releases: DataFrame, models: DataFrame) -> DataFrame:
    """asof, lab, release_id, date and index (0 if it isn't fitted) of the release that a forecast starts from: of a lab's latest flagships the one of the highest index, else the last by id."""
    out = releases.where((F.col("status") == "released") & (F.coalesce("tier", F.lit("flagship")) == "flagship")).select("lab", "release_id", "date")
    rows = out.join(models.select("asof").distinct(), F.col("date") <= F.col("asof")).join(models.select("asof", "release_id", "index"), ["asof", "release_id"], "left")
    best = F.max(F.struct("date", F.coalesce("index", F.lit(0.0)).alias("index"), "release_id")).alias("b")
    return rows.groupBy("asof", "lab").agg(best).select("asof", "lab", "b.release_id", "b.date", "b.index")


def capability_trend(models: DataFrame, points: int = 5) -> DataFrame:
    """Least squares of theta over days, by asof and lab, of the last ``points`` fitted flagships (qualified ones if there are two)."""
    some = models.where(F.col("tier") == "flagship").withColumn("good", F.count_if("qualified").over(Window.partitionBy("asof", "lab")))
    newest = Window.partitionBy("asof", "lab").orderBy(F.desc("date"), F.desc("release_id"))
    last = some.where((F.col("good") < 2) | F.col("qualified")).withColumn("at", F.row_number().over(newest)).where(F.col("at") <= points).withColumn("x", F.unix_date("date").cast("double"))
    return fitted_trend(last, ("asof", "lab"))


def fitted_trend(last: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """n, slope, intercept, sigma and slope_se of each group's few rows (x in days, theta, sigma of the fit)."""
    sums = last.groupBy(*by).agg(F.count("*").alias("n"), F.regr_sxx("theta", "x").alias("sxx"), F.regr_sxy("theta", "x").alias("sxy"), F.regr_syy("theta", "x").alias("syy"), F.avg("x").alias("x_bar"), F.avg("theta").alias("y_bar"), (F.max("x") - F.min("x")).alias("span"), F.stddev_pop("theta").alias("sd"), F.first("sigma").alias("of_fit"))
    sigma = F.col("of_fit")
    flat = (F.col("n") == 1) | ~(F.col("sxx") > 0)
    slope = F.when(flat, 0.0).otherwise(F.try_divide(F.col("sxy"), F.col("sxx")))
    own = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") ** 2, F.col("sxx"))) / F.greatest(F.lit(1), F.col("n") - 2))
    noise = F.when(F.col("n") == 1, sigma).when(flat, F.greatest(sigma, F.col("sd"))).otherwise(F.greatest(own, sigma))
    out = sums.select(*by, "n", "sxx", "span", "of_fit", slope.alias("slope"), (F.col("y_bar") - slope * F.col("x_bar")).alias("intercept"), noise.alias("sigma"))
    slope_se = F.when((F.col("n") == 1) | ~(F.col("sxx") > 0), 0.0).when(F.col("n") == 2, F.try_divide(sigma, F.col("span"))).otherwise(F.col("sigma") / F.sqrt("sxx"))
    return out.select(*by, "n", "slope", "intercept", "sigma", slope_se.alias("slope_se"))


def capability_fan(trend: DataFrame, last: DataFrame, asof: Column, to: Column, step: int = 7) -> DataFrame:
    """theta and its band by lab and date, of a trend of one asof; the centre stays between five points under the last index and the ceiling. last: lab, date, index."""
    rows = trend.drop("asof").join(last.select("lab", F.col("date").alias("last"), F.col("index").alias("last_index")), "lab").withColumn("day", F.explode(F.sequence(F.unix_date(asof), F.unix_date(to), F.lit(step))))
    low, high = theta_of(F.col("last_index") - 5), theta_of(99.5)
    theta = F.least(F.greatest(F.col("intercept") + F.col("slope") * F.col("day"), low), high)
    half = 1.2816 * F.sqrt(F.col("sigma") ** 2 + (F.col("slope_se") * F.greatest(F.lit(0), F.col("day") - F.unix_date("last"))) ** 2)
    return rows.select("lab", F.date_from_unix_date("day").alias("date"), theta.alias("theta"), (theta - half).alias("theta_low"), (theta + half).alias("theta_high"))


def density(rows: DataFrame, samples: int = 48, stretch: float = 1.0) -> DataFrame:
    """asof, lab, day (offset from the last release) and p: the next release's density between its 2nd and 98th percentile, 1 at the mode.

    A stretched law begins before t0 where its median is later, so it is pulled back to the plain one before it is read off. A law's samples are a row of an array
    in its own task: they meet their mode there, without a window, and without generated code that is too long for the JVM's compiler.
    """
    ends = wait_quantiles(rows, {"lo": 0.02, "hi": 0.98, "_m": 0.5}, F.lit(stretch))
    laws_ = ends.select("asof", "lab", *[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "_m", "mu", "sigma", "t0")])
    schema = T.StructType([*laws_.schema.fields[:2], T.StructField("i", T.IntegerType()), T.StructField("day", T.DoubleType()), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(samples, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lo, hi, mid, mu, sigma, t0 = (part.column(k).to_numpy(zero_copy_only=False)[:, None] for k in range(2, 8))
                day = lo + (hi - lo) * i / (samples - 1)

                def gone(t: np.ndarray) -> np.ndarray:
                    """Probability that the wait is over by ``t``, given t0."""
                    if stretch > 0 and stretch != 1:
                        bent = (mid > 0) & (t > 0)
                        t = np.where(bent, mid * np.where(bent, t / np.where(mid > 0, mid, 1.0), 1.0) ** (1 / stretch), t)
                    return scalar.lognormal_cdf_array(mu, sigma, np.maximum(t, t0))

                mass = gone(day + 0.5) - gone(day - 0.5)
                top = mass.max(axis=1, keepdims=True)
                p = np.where((hi - lo < 1) | ~(top > 0), 1.0, mass / np.where(top > 0, top, 1.0))
                none = np.isnan(day + mass).ravel()
                keys = part.select([0, 1]).take(pa.array(np.repeat(np.arange(part.num_rows), samples)))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.tile(i, part.num_rows)), pa.array(day.ravel(), mask=none), pa.array(p.ravel(), mask=none)], ["asof", "lab", "i", "day", "p"])

    return laws_.mapInArrow(run, schema)


def chain_density(rows: DataFrame, k: int, samples: int = 48, stretch: float = 1.0) -> DataFrame:
    """As ``density``, of the k-th next release, k at least 2: a log-normal law about its median, m days after the last release. rows: asof, lab, sigma, m."""
    sd = F.col("sigma") * stretch * math.sqrt(k)
    low, high = NormalDist().inv_cdf(0.02), NormalDist().inv_cdf(0.98)
    at = rows.withColumn("m", F.greatest(F.lit(1.0), "m")).withColumn("sd", sd)
    ends = at.withColumn("lo", clamp(F.col("m") * F.exp(F.col("sd") * low), 0.0, MOST_DAYS)).withColumn("hi", clamp(F.col("m") * F.exp(F.col("sd") * high), 0.0, MOST_DAYS))
    points = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("day", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (samples - 1))
    law = F.when((F.col("day") > 0) & (F.col("sd") > 0), normal_pdf(F.try_divide(F.ln("day") - F.ln("m"), F.col("sd"))) / (F.col("day") * F.col("sd"))).otherwise(0.0)
    raw = points.withColumn("raw", law)
    top = F.max("raw").over(Window.partitionBy("asof", "lab"))  # ``samples`` rows
    return raw.select("asof", "lab", "i", "day", F.when((F.col("hi") - F.col("lo") < 1) | ~(top > 0), 1.0).otherwise(F.col("raw") / top).alias("p"))


def window_density(windows: DataFrame, samples: int = 48) -> DataFrame:
    """As ``density``, of announced windows (asof, lab, p05, p16, p84, p95): level within the window, straight slopes to its outer edges; day counts from 1970."""
    d = {n: F.unix_date(n).cast("double") for n in ("p05", "p16", "p84", "p95")}
    points = windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("day", d["p05"] + (d["p95"] - d["p05"]) * F.col("i") / (samples - 1))
    day = F.col("day")
    p = F.when(d["p95"] - d["p05"] < 1, 1.0).when((day <= d["p05"]) | (day >= d["p95"]), 0.0).when(day < d["p16"], F.try_divide(day - d["p05"], d["p16"] - d["p05"])).when(day > d["p84"], F.try_divide(d["p95"] - day, d["p95"] - d["p84"])).otherwise(1.0)
    top = F.max(p).over(Window.partitionBy("asof", "lab"))
    return points.select("asof", "lab", "i", "day", (p / F.when(top > 0, top).otherwise(1.0)).alias("p"))


def replay_grid(releases: DataFrame, to: Column, step: int = 30, after: int = 365) -> DataFrame:
    """asof: every ``step`` days from ``after`` days after the first flagship up to a step before ``to``."""
    first = event_dates(releases).agg(F.date_add(F.min("date"), after).alias("start"))
    end = F.date_sub(to, step)
    return first.where(F.col("start") <= end).select(F.explode(F.sequence("start", end, F.expr(f"interval {step} days"))).alias("asof"))


def actuals(releases: DataFrame, grid: DataFrame) -> DataFrame:
    """asof, lab and the first flagship date strictly after it."""
    ahead = event_dates(releases).join(grid, F.col("date") > F.col("asof"))
    return ahead.groupBy("asof", "lab").agg(F.min("date").alias("actual"))


def backtest(rows: DataFrame, actual: DataFrame, stretch: Column | None = None) -> DataFrame:
    """The forecasts with what happened: error_days, in68, in90."""
    found = next_release(rows, stretch).join(actual, ["asof", "lab"], "left")
    return found.withColumns({"error_days": F.datediff("actual", "p50"), "in68": F.col("actual").between(F.col("p16"), F.col("p84")), "in90": F.col("actual").between(F.col("p05"), F.col("p95"))})


def summary(rows: DataFrame, labs: DataFrame | None = None) -> DataFrame:
    """Coverage and errors over all labs (total true) and by lab, in one pass; 0 where nothing was forecast, and a total of zeros without rows. Labs of ``labs`` without rows get a row of zeros.

    n: forecasts with a known outcome; unforecastable: known outcomes without a forecast. theta_mae if rows have theta_error.
    """
    none = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])  # so that there is a total without rows as well
    known = rows.where(F.col("actual").isNotNull()).unionByName(none)
    made = F.col("p50").isNotNull()
    error = F.when(made, F.abs("error_days"))
    share = lambda c: F.coalesce(F.avg(F.when(made, F.col(c).cast("int"))), F.lit(0.0)).alias(c.replace("in", "coverage"))
    theta = [F.avg(F.abs("theta_error")).alias("theta_mae")] if "theta_error" in rows.columns else []
    found = known.rollup("lab").agg(
        (F.grouping("lab") == 1).alias("total"), F.count_if(made).alias("n"), F.count_if(~made & F.col("actual").isNotNull()).alias("unforecastable"), share("in68"), share("in90"), F.coalesce(F.avg(error), F.lit(0.0)).alias("mae_days"),
        F.coalesce(F.percentile(error, 0.5), F.lit(0.0)).alias("median_abs_days"), F.coalesce(F.avg(F.when(made, F.col("error_days"))), F.lit(0.0)).alias("bias_days"), *theta, F.count("actual").alias("_known"),
    )
    found = found.where(F.col("total") | (F.col("_known") > 0)).drop("_known")
    if labs is None:
        return found
    lacking = labs.select("lab").distinct().join(found.where(~F.col("total")), "lab", "left_anti")
    zero = {c: F.lit(0) for c in ("n", "unforecastable")} | {c: F.lit(0.0) for c in ("coverage68", "coverage90", "mae_days", "median_abs_days", "bias_days")}
    return found.unionByName(lacking.select("lab", F.lit(False).alias("total"), *[v.cast(found.schema[c].dataType).alias(c) for c, v in zero.items()], *([F.lit(None).cast("double").alias("theta_mae")] if theta else [])))


def calibration_curve(rows: DataFrame, actual: DataFrame) -> DataFrame:
    """nominal and observed: the share of actual dates by the nominal quantile's date."""
    names = {f"q{k}": k / 10 for k in range(1, 10)}
    found = wait_quantiles(rows, names).join(actual, ["asof", "lab"])
    shares = found.agg(*[F.avg((F.col("actual") <= F.date_add("last", F.floor(F.col(n) + 0.5).cast("int"))).cast("int")).alias(n) for n in names])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(q).alias("nominal"), F.col(n).alias("observed")) for n, q in names.items()])).alias("r")).select("r.*")


def calibrate(rows: DataFrame, actual: DataFrame, scales: tuple[float, ...] = tuple(1 + k / 10 for k in range(21))) -> DataFrame:
    """scale, coverages and loss of each stretch; laws and their plain quantiles are made once and crossed with the scales only. The first row by (loss, scale) is the choice."""
    known = rows.join(actual, ["asof", "lab"]).select("last", "actual", "mu", "sigma", "t0")
    plain = plain_quantiles(known, {**QUANTILES, "_mid": 0.5}).select("last", "actual", *QUANTILES, "_mid").withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    found = plain.select("scale", "last", "actual", *[bent(F.col(n), F.col("_mid"), F.col("scale")).alias(n) for n in QUANTILES])
    inside = lambda a, b: F.avg(F.col("actual").between(moved("last", F.col(a)), moved("last", F.col(b))).cast("int"))
    sums = found.groupBy("scale").agg(inside("p16", "p84").alias("coverage68"), inside("p05", "p95").alias("coverage90"))
    return sums.withColumn("loss", F.abs(F.col("coverage68") - 0.68) + F.abs(F.col("coverage90") - 0.9))


def best_scale(calibrated: DataFrame) -> DataFrame:
    """The stretch of the least loss, the smaller where equal."""
    return calibrated.orderBy("loss", "scale").limit(1)
