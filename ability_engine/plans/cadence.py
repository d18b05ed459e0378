"""Queries of the forecasts and their replay, on orders (releases) and customers (labs)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ability_engine.functions import scalar
from ability_engine.operators import forecast
from ability_engine.plans import oracle as o
from ability_engine.plans.ability import dates, r6, rounded
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

ONE = ("2000-06-30",)
GRID = tuple(f"{y}-{m}-01" for y in range(1997, 2001) for m in ("01", "07"))
SQL_ONE, SQL_GRID = o.CUSTOMER_ASOF, ", ".join(f"DATE '{d}'" for d in GRID)
Q = forecast.QUANTILES


def _laws(spark, sf_dir, days):
    return forecast.laws(a.launches(spark, sf_dir), dates(spark, *days)).cache()


@query("normal_cdf", f"SELECT CAST(k AS BIGINT) AS k, round({o.normal_cdf('(k / 50.0::DOUBLE - 10)')}, 12) + 0.0 AS p FROM (SELECT unnest(range(1001)) AS k)")
def normal_cdf(spark, sf_dir):
    return spark.range(1001).select(F.col("id").alias("k"), (F.round(scalar.normal_cdf(F.col("id") / 50 - 10), 12) + 0.0).alias("p"))


@query("normal_inverse", f"SELECT CAST(k AS BIGINT) AS k, {o.r6(o.normal_quantile('(k / 1000.0::DOUBLE)'))} AS z FROM (SELECT unnest(range(1, 1000)) AS k)")
def normal_inverse(spark, sf_dir):
    return spark.range(1, 1000).select(F.col("id").alias("k"), r6(scalar.normal_quantile(F.col("id") / 1000)).alias("z"))


@query("cadence_intervals", o.sql("SELECT lab, date, CAST(gap AS INT) AS gap FROM gaps", o.laws(SQL_ONE)))
def cadence_intervals(spark, sf_dir):
    return forecast.intervals(forecast.event_dates(a.launches(spark, sf_dir)))


@query("cadence_prior", o.sql(f"SELECT asof, {o.r6('mu')} AS mu, {o.r6('sigma')} AS sigma, {o.r6('n')} AS n, {o.r6('drift * 365')} AS drift_per_year FROM prior", o.laws(SQL_GRID)))
def cadence_prior(spark, sf_dir):
    gaps = forecast.intervals(forecast.event_dates(a.launches(spark, sf_dir)))
    found = forecast.prior(gaps, dates(spark, *GRID)).withColumn("drift_per_year", F.col("drift") * 365)
    return rounded(found, "mu", "sigma", "n", "drift_per_year").select("asof", "mu", "sigma", "n", "drift_per_year")


def _by(h: str) -> str:
    return o.normal_cdf(f"((ln(t0 + {h}) - mu) / sigma)")


@query("lab_forecast", o.sql(f"SELECT lab, last, {o.r6('mu')} AS mu, {o.r6('sigma')} AS sigma, " + ", ".join(f"{o.r6(f'CASE WHEN 1 - gone < 1e-9 THEN 1.0 ELSE least(greatest(({_by(h)} - gone) / (1 - gone), 0.0), 1.0) END')} AS p{h}" for h in ("30", "90")) + " FROM gone", o.laws(SQL_ONE)))
def lab_forecast(spark, sf_dir):
    rows = forecast.wait_probability(forecast.wait_probability(_laws(spark, sf_dir, ONE), 30.0, "p30"), 90.0, "p90")
    return rounded(rows, "mu", "sigma", "p30", "p90").select("lab", "last", "mu", "sigma", "p30", "p90")


def _chain(n: str, q: float) -> str:
    spread = "off" if q == 0.5 else f"off * exp(sigma * sqrt(k) * ({NormalDist().inv_cdf(q)!r}::DOUBLE))"
    return f"{o.moved('last', f'CASE WHEN k = 1 THEN {n} ELSE {spread} END')} AS {n}"


@query("prediction_chain", o.sql(f"SELECT lab, k, {', '.join(_chain(n, q) for n, q in Q.items())} FROM (SELECT *, least(greatest(least(greatest(p50, 0), 36500) + (k - 1) * exp(mu), 0), 36500) AS off FROM waits, (SELECT CAST(unnest(range(1, 6)) AS INT) AS k))", o.laws(SQL_ONE), o.waits(Q)))
def prediction_chain(spark, sf_dir):
    return forecast.chain(_laws(spark, sf_dir, ONE)).drop("asof", "certainty", "source", "release_id")


_ANNOUNCED = {"windows": f"SELECT o_custkey AS lab, CAST(o_orderdate AS DATE) + 60 AS s, CAST(o_orderdate AS DATE) + 60 + CAST(o_orderkey % 90 AS INT) AS e, 'o-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) + 60 > {SQL_ONE}", "opened": "SELECT lab, min((s, id, e)) AS a FROM windows GROUP BY 1", "opens": "SELECT lab, a[1] AS s, a[2] AS id, a[3] AS e, a[3] - a[1] AS len FROM opened"}


def _windows(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders").withColumn("s", F.date_add(F.col("o_orderdate").cast("date"), 60))
    rows = a.launches(spark, sf_dir).join(orders.select(F.concat(F.lit("o-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("release_id"), F.col("s").alias("window_start"), F.expr("date_add(s, cast(o_orderkey % 90 as int))").alias("window_end")), "release_id")
    return forecast.announced(rows, dates(spark, *ONE))


@query(
    "announced_windows",
    o.sql(f"""SELECT w.lab, k, CASE WHEN k = 1 THEN s + CAST(floor(-0.15::DOUBLE * len + 0.5) AS INT) END AS p05, CASE WHEN k = 1 THEN s + CAST(floor(len / 2 + 0.5) AS INT) ELSE {o.moved('(s + CAST(floor(len / 2 + 0.5) AS INT))', 'least(greatest((k - 1) * exp(mu), 0), 36500)')} END AS p50,
        CASE WHEN k = 1 THEN e END AS p84, CASE WHEN k = 1 THEN s + CAST(floor(1.15::DOUBLE * len + 0.5) AS INT) END AS p95, CASE WHEN k = 1 THEN 'announced' ELSE 'statistical' END AS source, CASE WHEN k = 1 THEN id END AS release_id, CASE WHEN k = 1 THEN {o.r6('1 / (1 + len / 90.0)')} END AS certainty
        FROM waits w JOIN opens n ON w.lab = n.lab, (SELECT CAST(unnest(range(1, 4)) AS INT) AS k)""", o.laws(SQL_ONE), o.waits({"p50": 0.5}), _ANNOUNCED),
)
def announced_windows(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    found = forecast.chain(_laws(spark, sf_dir, ONE), 3, windows=windows).join(windows.select("lab"), "lab", "left_semi")
    first = lambda c: F.when(F.col("k") == 1, F.col(c)).alias(c)
    return found.select("lab", "k", first("p05"), "p50", first("p84"), first("p95"), "source", "release_id", F.when(F.col("k") == 1, r6("certainty")).alias("certainty"))


@query("window_density", o.sql("SELECT lab, i, round(CASE WHEN b - a < 1 THEN 1.0 WHEN d <= a OR d >= b THEN 0.0 WHEN d < s THEN (d - a) / (s - a) WHEN d > e THEN (b - d) / (b - e) ELSE 1.0 END, 6)::DOUBLE AS p FROM (SELECT *, a + (b - a) * i / 10.0::DOUBLE AS d FROM (SELECT lab, (s + CAST(floor(-0.15::DOUBLE * len + 0.5) AS INT) - DATE '1970-01-01')::DOUBLE AS a, (s - DATE '1970-01-01')::DOUBLE AS s, (e - DATE '1970-01-01')::DOUBLE AS e, (s + CAST(floor(1.15::DOUBLE * len + 0.5) AS INT) - DATE '1970-01-01')::DOUBLE AS b FROM opens WHERE len > 20), (SELECT CAST(unnest(range(11)) AS INT) AS i))", o.laws(SQL_ONE), _ANNOUNCED))
def window_density(spark, sf_dir):
    windows = _windows(spark, sf_dir).where(F.datediff("window_end", "window_start") > 20)
    width = F.datediff("window_end", "window_start")
    shown = windows.select("asof", "lab", F.date_add("window_start", F.floor(-0.15 * width + 0.5).cast("int")).alias("p05"), F.col("window_start").alias("p16"), F.col("window_end").alias("p84"), F.date_add("window_start", F.floor(1.15 * width + 0.5).cast("int")).alias("p95"))
    return forecast.window_density(shown, 11).select("lab", "i", r6("p").alias("p"))


_Z02, _Z98 = NormalDist().inv_cdf(0.02), NormalDist().inv_cdf(0.98)


@query("chain_density", o.sql(f"SELECT lab, i, round(day, 4) + 0.0 AS day, round(raw / max(raw) OVER (PARTITION BY lab), 4) + 0.0 AS p FROM (SELECT *, exp(-pow((ln(day) - ln(m)) / sd, 2) / 2) / sqrt(2 * pi()) / (day * sd) AS raw FROM (SELECT *, least(36500.0, m * exp(sd * ({_Z02!r}::DOUBLE))) + (least(36500.0, m * exp(sd * ({_Z98!r}::DOUBLE))) - least(36500.0, m * exp(sd * ({_Z02!r}::DOUBLE)))) * i / 10.0::DOUBLE AS day FROM (SELECT lab, greatest(1.0::DOUBLE, 2 * exp(mu)) AS m, sigma * sqrt(2.0::DOUBLE) AS sd FROM gone), (SELECT CAST(unnest(range(11)) AS INT) AS i)))", o.laws(SQL_ONE)))
def chain_density(spark, sf_dir):
    rows = _laws(spark, sf_dir, ONE).withColumn("m", 2 * F.exp("mu"))
    return forecast.chain_density(rows, 2, 11).select("lab", "i", (F.round("day", 4) + 0.0).alias("day"), (F.round("p", 4) + 0.0).alias("p"))


@query("replay_grid", "SELECT CAST(unnest(generate_series(m + 365, DATE '2001-12-31' - 30, INTERVAL 30 DAY)) AS DATE) AS asof FROM (SELECT min(CAST(o_orderdate AS DATE)) AS m FROM orders WHERE o_orderstatus <> 'P' AND substr(o_orderpriority, 1, 1) NOT IN ('4', '5'))")
def replay_grid(spark, sf_dir):
    return forecast.replay_grid(a.launches(spark, sf_dir), F.lit("2001-12-31").cast("date"))


@query("stretched_probability", o.sql(f"SELECT lab, {o.r6('CASE WHEN at_ <= t0 THEN 0.0 WHEN 1 - gone < 1e-9 THEN 1.0 ELSE least(greatest((' + o.normal_cdf('((ln(at_) - mu) / sigma)') + ' - gone) / (1 - gone), 0.0), 1.0) END')} AS p FROM (SELECT *, p50 * pow((t0 + 60) / p50, 1 / 1.5::DOUBLE) AS at_ FROM waits)", o.laws(SQL_ONE), o.waits({"p50": 0.5})))
def stretched_probability(spark, sf_dir):
    return forecast.wait_probability(_laws(spark, sf_dir, ONE), 60.0, "p", stretch=1.5).select("lab", r6("p").alias("p"))


def _mass(a_: str) -> str:
    return f"(CASE WHEN {a_} <= 0 THEN 0.0 ELSE {o.normal_cdf(f'((ln(greatest({a_}, 1e-300)) - mu) / sigma)')} END)"


@query(
    "release_density",
    o.sql(
        f"SELECT lab, i, round(day, 4) + 0.0 AS day, round(CASE WHEN hi - lo < 1 OR NOT top > 0 THEN 1.0 ELSE mass / top END, 4) + 0.0 AS p FROM (SELECT *, max(mass) OVER (PARTITION BY lab) AS top FROM (SELECT *, {_mass('b')} - {_mass('a')} AS mass FROM (SELECT *, greatest(day - 0.5, t0) AS a, greatest(day + 0.5, t0) AS b FROM (SELECT *, lo + (hi - lo) * i / 47 AS day FROM waits, (SELECT CAST(unnest(range(48)) AS INT) AS i)))))",
        o.laws(SQL_ONE), o.waits({"lo": 0.02, "hi": 0.98}),
    ),
)
def release_density(spark, sf_dir):
    rows = forecast.density(_laws(spark, sf_dir, ONE))
    return rows.select("lab", "i", (F.round("day", 4) + 0.0).alias("day"), (F.round("p", 4) + 0.0).alias("p"))


_BACK = {"back": f"SELECT w.asof, w.lab, {', '.join(o.moved('last', n) + f' AS {n}' for n in Q)}, actual FROM waits w LEFT JOIN actual a ON w.asof = a.asof AND w.lab = a.lab", "backtest": "SELECT *, CAST(actual - p50 AS INT) AS error_days, actual BETWEEN p16 AND p84 AS in68, actual BETWEEN p05 AND p95 AS in90 FROM back"}
_REPLAY = (o.laws(SQL_GRID), o.waits(Q), o.ACTUAL, _BACK)


def _replay(spark, sf_dir):
    launches, grid = a.launches(spark, sf_dir), dates(spark, *GRID)
    return forecast.laws(launches, grid).cache(), forecast.actuals(launches, grid)


@query("backtest_rows", o.sql("SELECT asof, lab, p05, p16, p50, p84, p95, actual, error_days, in68, in90 FROM backtest", *_REPLAY))
def backtest_rows(spark, sf_dir):
    return forecast.backtest(*_replay(spark, sf_dir)).select("asof", "lab", *Q, "actual", "error_days", "in68", "in90")


@query("backtest_summary", o.sql(f"SELECT lab, GROUPING(lab) = 1 AS total, count(*) AS n, 0::BIGINT AS unforecastable, {o.r6('avg(CAST(in68 AS INT))')} AS coverage68, {o.r6('avg(CAST(in90 AS INT))')} AS coverage90, {o.r6('avg(abs(error_days))')} AS mae_days, median(abs(error_days))::DOUBLE AS median_abs_days, {o.r6('avg(error_days)')} AS bias_days FROM backtest WHERE actual IS NOT NULL GROUP BY ROLLUP (lab)", *_REPLAY))
def backtest_summary(spark, sf_dir):
    return rounded(forecast.summary(forecast.backtest(*_replay(spark, sf_dir))), "coverage68", "coverage90", "mae_days", "bias_days")


_TENTHS = {f"q{k}": k / 10 for k in range(1, 10)}


@query("calibration_curve", o.sql(" UNION ALL ".join(f"SELECT {q!r}::DOUBLE AS nominal, {o.r6(f'avg(CAST(actual <= last + CAST(floor({n} + 0.5) AS INT) AS INT))')} AS observed FROM waits w JOIN actual a ON w.asof = a.asof AND w.lab = a.lab" for n, q in _TENTHS.items()), o.laws(SQL_GRID), o.waits(_TENTHS), o.ACTUAL))
def calibration_curve(spark, sf_dir):
    return rounded(forecast.calibration_curve(*_replay(spark, sf_dir)), "observed")


_SCALED = {"scaled": "SELECT g.*, actual, scale FROM gone g JOIN actual a ON g.asof = a.asof AND g.lab = a.lab, (SELECT 1 + unnest(range(21)) / 10.0::DOUBLE AS scale)"}
_COVER = f"SELECT scale, avg(CAST(actual BETWEEN {o.moved('last', 'p16')} AND {o.moved('last', 'p84')} AS INT)) AS coverage68, avg(CAST(actual BETWEEN {o.moved('last', 'p05')} AND {o.moved('last', 'p95')} AS INT)) AS coverage90 FROM waits GROUP BY 1"


@query("calibrate_scale", o.sql(f"SELECT {o.r6('scale')} AS scale, {o.r6('coverage68')} AS coverage68, {o.r6('coverage90')} AS coverage90, {o.r6('abs(coverage68 - 0.68) + abs(coverage90 - 0.9)')} AS loss FROM ({_COVER})", o.laws(SQL_GRID), o.ACTUAL, _SCALED, o.waits(Q, "scale", "scaled")))
def calibrate_scale(spark, sf_dir):
    return rounded(forecast.calibrate(*_replay(spark, sf_dir)), "scale", "coverage68", "coverage90", "loss")


@query("best_scale", o.sql(f"SELECT {o.r6('scale')} AS scale FROM ({_COVER}) ORDER BY round(abs(coverage68 - 0.68) + abs(coverage90 - 0.9), 9), scale LIMIT 1", o.laws(SQL_GRID), o.ACTUAL, _SCALED, o.waits(Q, "scale", "scaled")))
def best_scale(spark, sf_dir):
    found = forecast.calibrate(*_replay(spark, sf_dir)).withColumn("loss", F.round("loss", 9))
    return forecast.best_scale(found).select(r6("scale").alias("scale"))
