"""Queries of the replay with the fit of each date, on suppliers, brands and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ability_engine.operators import forecast, replay
from ability_engine.plans import oracle as o
from ability_engine.plans.ability import dates, rounded
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

#: The first of every second month of four years.
GRID = tuple(f"{y}-{m:02}-01" for y in range(2020, 2024) for m in range(1, 13, 2))
SQL_GRID = ", ".join(f"DATE '{d}'" for d in GRID)
TODAY = "DATE '9999-12-31'"
Q = forecast.QUANTILES

_FLAGSHIPS = {"launches": "SELECT * FROM releases"}
_TREND = {
    "good": f"SELECT *, count(*) FILTER (qualified) OVER (PARTITION BY asof, lab) AS good FROM models WHERE tier = 'flagship' AND asof < {TODAY}",
    "last5": "SELECT *, date - DATE '1970-01-01' AS x FROM (SELECT *, row_number() OVER (PARTITION BY asof, lab ORDER BY date DESC, release_id DESC) AS k FROM good WHERE good < 2 OR qualified) WHERE k <= 5",
    "lines": "SELECT asof, lab, count(*) AS n, regr_sxx(theta, x) AS sxx, regr_slope(theta, x) AS b, avg(x) AS xb, avg(theta) AS yb FROM last5 GROUP BY 1, 2",
    "trended": "SELECT asof, lab, CASE WHEN n = 1 OR sxx <= 0 THEN 0 ELSE b END AS slope, yb - CASE WHEN n = 1 OR sxx <= 0 THEN 0 ELSE b END * xb AS intercept FROM lines",
    "heads": "SELECT l.asof, l.lab, coalesce(max(m.index), 0.0) AS last_index FROM latest l JOIN releases r ON r.lab = l.lab AND r.date = l.last AND r.status = 'released' AND r.tier = 'flagship' LEFT JOIN models m ON m.asof = l.asof AND m.release_id = r.release_id GROUP BY 1, 2",
    "moves": f"SELECT asof, lab, {', '.join(o.moved('last', n) + f' AS {n}' for n in Q)} FROM waits",
    "made": f"SELECT w.*, CASE WHEN slope IS NULL THEN 0.0 ELSE least(greatest(intercept + slope * (p50 - DATE '1970-01-01'), {o.clipped('greatest(0.5, last_index - 5)')}), {o.clipped('99.5')}) END AS predicted_theta FROM moves w LEFT JOIN trended t ON t.asof = w.asof AND t.lab = w.lab LEFT JOIN heads h ON h.asof = w.asof AND h.lab = w.lab",
    "coming": "SELECT g.asof, lab, min((date, release_id)) AS c FROM releases JOIN dates_grid g ON date > g.asof WHERE status = 'released' AND tier = 'flagship' GROUP BY 1, 2",
    "backtest": f"""SELECT w.*, c.c[1] AS actual, c.c[2] AS actual_id, m.theta AS actual_theta, CAST(c.c[1] - p50 AS INT) AS error_days, c.c[1] BETWEEN p16 AND p84 AS in68, c.c[1] BETWEEN p05 AND p95 AS in90, m.theta - predicted_theta AS theta_error
        FROM made w LEFT JOIN coming c ON c.asof = w.asof AND c.lab = w.lab LEFT JOIN models m ON m.asof = {TODAY} AND m.release_id = c.c[2]""",
}
_PARTS = (o.fit(f"{SQL_GRID}, {TODAY}"), _FLAGSHIPS, o.laws(SQL_GRID), o.waits(Q), _TREND)


def _drift(spark, sf_dir):
    """The dates that know a gap, which are those of the SQL: the operators have defaults for the others."""
    return replay.drift_per_year(a.releases(spark, sf_dir), dates(spark, *GRID)).where("drift_per_year IS NOT NULL")


def _backtest(spark, sf_dir):
    found = replay.backtest(a.scores(spark, sf_dir), a.releases(spark, sf_dir), a.benches(spark, sf_dir), dates(spark, *GRID))
    return found.join(F.broadcast(_drift(spark, sf_dir).select("asof")), "asof", "left_semi")  # at most the dates of the grid


@query("backtest_theta", o.sql(f"SELECT asof, lab, p05, p16, p50, p84, p95, {o.r6('predicted_theta')} AS predicted_theta, actual, actual_id, {o.r6('actual_theta')} AS actual_theta, error_days, in68, in90, {o.r6('theta_error')} AS theta_error FROM backtest", *_PARTS))
def backtest_theta(spark, sf_dir):
    return rounded(_backtest(spark, sf_dir), "predicted_theta", "actual_theta", "theta_error").drop("source")


@query(
    "backtest_theta_summary",
    o.sql(
        f"SELECT lab, GROUPING(lab) = 1 AS total, count(*) AS n, {o.r6('avg(CAST(in68 AS INT))')} AS coverage68, {o.r6('avg(CAST(in90 AS INT))')} AS coverage90, {o.r6('avg(abs(error_days))')} AS mae_days, {o.r6('avg(abs(theta_error))')} AS theta_mae FROM backtest WHERE actual IS NOT NULL GROUP BY ROLLUP (lab)",
        *_PARTS,
    ),
)
def backtest_theta_summary(spark, sf_dir):
    means = ("coverage68", "coverage90", "mae_days", "theta_mae")
    found = rounded(forecast.summary(_backtest(spark, sf_dir)), *means)
    return found.select("lab", "total", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in means])  # the SQL has no mean of no rows


@query("fit_by_grid", o.sql(f"SELECT CAST(row_number() OVER (ORDER BY asof) - 1 AS INT) AS k, {o.r6('sigma')} AS sigma, (SELECT count(*) FROM delta d WHERE d.asof = s.asof) AS observed FROM sig s", o.fit(f"{SQL_GRID}, {TODAY}")))
def fit_by_grid(spark, sf_dir):
    grid = dates(spark, *GRID)
    rows = replay.score_rows(a.scores(spark, sf_dir), a.releases(spark, sf_dir), a.benches(spark, sf_dir), grid)
    return rounded(replay.fits(rows, F.lit(len(GRID))), "sigma").select("k", "sigma", "observed")


@query("drift_per_year", o.sql(f"SELECT asof, {o.r6('drift * 365')} AS drift_per_year FROM prior", _FLAGSHIPS, o.laws(SQL_GRID)))
def drift_per_year(spark, sf_dir):
    return rounded(_drift(spark, sf_dir), "drift_per_year")
