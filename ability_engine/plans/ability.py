"""Queries of the fit, the frontier and the views of what is current, on suppliers, brands and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ability_engine.operators import fit, forecast, frontier, lineup
from ability_engine.plans import oracle as o
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

NOW, THEN = "2025-02-01", "2020-03-01"
DATES = ("2021-06-30", "2023-03-31", "2025-02-01")
SQL_DATES = ", ".join(f"DATE '{d}'" for d in DATES)


def on(day: str) -> Column:
    return F.lit(day).cast("date")


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def dates(spark: SparkSession, *days: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("asof"))


def fitted(spark: SparkSession, sf_dir: str, *days: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    benches = a.benches(spark, sf_dir)
    obs = fit.observations(a.scores(spark, sf_dir), a.releases(spark, sf_dir), benches, dates(spark, *(days or ("2025-02-01",)))).persist()
    return fit.fit_observed(obs, benches)


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.line(fitted(spark, sf_dir)[0]).cache()


@query("score_selection", o.sql(f"SELECT release_id, benchmark, {o.r6('value')} AS value, config, reported_by FROM picked", {"picked": o.PICKED}))
def score_selection(spark, sf_dir):
    return rounded(fit.select_scores(a.scores(spark, sf_dir), a.benches(spark, sf_dir)), "value").select("release_id", "benchmark", "value", "config", "reported_by")


_FIT = f"SELECT asof, release_id, {o.r6('theta')} AS theta, {o.r6('index')} AS index, {o.r6('rating')} AS rating, {o.r6('se')} AS se, n, {o.r6('n / 21.0::DOUBLE')} AS coverage, qualified FROM models"


@query("ability_fit", o.sql(_FIT, o.fit()))
def ability_fit(spark, sf_dir):
    return rounded(fitted(spark, sf_dir)[0], "theta", "index", "rating", "se", "coverage").select("asof", "release_id", "theta", "index", "rating", "se", "n", "coverage", "qualified")


@query("ability_fit_by_date", o.sql(_FIT, o.fit(SQL_DATES)))
def ability_fit_by_date(spark, sf_dir):
    return rounded(fitted(spark, sf_dir, *DATES)[0], "theta", "index", "rating", "se", "coverage").select("asof", "release_id", "theta", "index", "rating", "se", "n", "coverage", "qualified")


@query("benchmark_difficulty", o.sql(f"SELECT benchmark, {o.r6('delta')} AS delta FROM delta", o.fit()))
def benchmark_difficulty(spark, sf_dir):
    return rounded(fitted(spark, sf_dir)[1], "delta").select("benchmark", "delta")


@query("residuals", o.sql(f"SELECT release_id, benchmark, {o.r6('100 / (1 + exp(-(theta - delta)))')} AS predicted, {o.r6('residual')} AS residual FROM rows", o.fit()))
def residuals(spark, sf_dir):
    return rounded(fitted(spark, sf_dir)[2], "predicted", "residual").select("release_id", "benchmark", "predicted", "residual")


@query("frontier_line", o.sql(f"SELECT date, release_id, lab, {o.r6('index')} AS index, {o.r6('theta')} AS theta FROM knots", o.fit()))
def frontier_line(spark, sf_dir):
    return rounded(knots(spark, sf_dir), "index", "theta").select("date", "release_id", "lab", "index", "theta")


@query("leadership_stripes", o.sql('SELECT date AS start, lead(date) OVER (ORDER BY date, release_id) AS "end", release_id, lab FROM knots', o.fit()))
def leadership_stripes(spark, sf_dir):
    return frontier.stripes(knots(spark, sf_dir)).drop("asof")


_PACE = {"paced": "SELECT o.at, slope * 365 AS logits_per_year, CASE WHEN slope > 0 THEN ln(2) / slope END AS doubling_days, steps FROM ols o JOIN steps s ON o.at = s.at WHERE steps >= 2"}


@query("frontier_pace", o.sql(f"SELECT at, {o.r6('logits_per_year')} AS logits_per_year, {o.r6('doubling_days')} AS doubling_days, steps FROM paced", o.fit(), o.GRID, o.DAILY, _PACE))
def frontier_pace(spark, sf_dir):
    k = knots(spark, sf_dir)
    return rounded(frontier.pace(k, frontier.month_grid(k, on(NOW))), "logits_per_year", "doubling_days").drop("asof")


@query("frontier_velocity", o.sql(f"SELECT o.at, {o.r6('slope_index * 30')} AS per_month FROM ols o JOIN steps s ON o.at = s.at WHERE dates >= 2", o.fit(), o.GRID, o.DAILY))
def frontier_velocity(spark, sf_dir):
    k = knots(spark, sf_dir)
    return rounded(frontier.velocity(k, frontier.month_grid(k, on(NOW))), "per_month").drop("asof")


@query("frontier_trend", o.sql(f"SELECT o.at, {o.r6('slope')} AS slope, {o.r6('intercept')} AS intercept, {o.r6('sqrt(sse / (n - 2))')} AS sigma, {o.r6('sqrt(sse / (n - 2)) / sqrt(sxx)')} AS slope_se, n FROM ols o JOIN steps s ON o.at = s.at WHERE steps >= 2", o.fit(), o.GRID, o.DAILY))
def frontier_trend(spark, sf_dir):
    k = knots(spark, sf_dir)
    return rounded(frontier.trend(k, frontier.month_grid(k, on(NOW))), "slope", "intercept", "sigma", "slope_se").drop("stop", "asof")


@query(
    "frontier_gains_quarter",
    o.sql(
        f"""SELECT start, "end", {o.r6('greatest(0.0, top - coalesce(lag(top) OVER (ORDER BY start), theta_0))')} AS gain, steps FROM (
        SELECT p.start, p."end", theta_0, max(k.theta) AS top, count(*) FILTER (k.date >= p.start) AS steps FROM periods p LEFT JOIN knots k ON k.date < p."end" GROUP BY 1, 2, 3)""",
        o.fit(),
        {"periods": f"SELECT CAST(s AS DATE) AS start, CAST(s + INTERVAL 3 MONTH AS DATE) AS \"end\", theta_0 FROM (SELECT unnest(generate_series(date_trunc('quarter', m), {o.ASOF}, INTERVAL 3 MONTH)) AS s, theta_0 FROM (SELECT min(date) AS m, arg_min(theta, (date, release_id)) AS theta_0 FROM knots))"},
    ),
)
def frontier_gains_quarter(spark, sf_dir):
    return rounded(frontier.gains(knots(spark, sf_dir), on(NOW)), "gain").drop("asof")


_EARLY = "DATE '2020-03-01'"
_EARLY_TREND = o.TREND | {"at_grid": f"SELECT {_EARLY} AS at"}


@query(
    "frontier_fan",
    o.sql(
        f"SELECT date, {o.r6('theta')} AS theta, {o.r6('theta - half')} AS theta_low, {o.r6('theta + half')} AS theta_high FROM (SELECT CAST(d AS DATE) AS date, intercept + slope * (CAST(d AS DATE) - DATE '1970-01-01') AS theta, 1.2816 * sqrt(sigma * sigma + pow(slope_se * (CAST(d AS DATE) - at), 2)) AS half FROM trend, (SELECT unnest(list_distinct(list_concat(generate_series({_EARLY}, DATE '2021-01-01', INTERVAL 7 DAY), [TIMESTAMP '2021-01-01']))) AS d))",
        o.fit(), _EARLY_TREND,
    ),
)
def frontier_fan(spark, sf_dir):
    return rounded(frontier.fan(knots(spark, sf_dir), on(THEN), F.lit("2021-01-01").cast("date")), "theta", "theta_low", "theta_high").select("date", "theta", "theta_low", "theta_high")


@query("levels", o.sql(f"SELECT level, kind, {o.r6('theta')} AS theta, {o.r6('1000 + 400 / ln(10) * theta')} AS rating FROM levels", o.fit(), o.LEVELS))
def levels(spark, sf_dir):
    return rounded(frontier.levels(fitted(spark, sf_dir)[1], a.benches(spark, sf_dir)), "theta", "rating").drop("asof")


@query(
    "speculative_levels",
    o.sql(f"SELECT level, 'speculative' AS kind, {o.r6('theta + k * ln(10)')} AS theta FROM levels, (VALUES (1, 'spec-10x'), (2, 'spec-100x'), (3, 'spec-all'), (4, 'spec-singularity')) v(k, level) WHERE kind = 'ceiling'".replace("SELECT level,", "SELECT v.level,"), o.fit(), o.LEVELS),
)
def speculative_levels(spark, sf_dir):
    return rounded(frontier.speculative(frontier.levels(fitted(spark, sf_dir)[1], a.benches(spark, sf_dir))), "theta").select("level", "kind", "theta")


_CROSS = {
    "passed": "SELECT level, min(date) AS date, arg_min(release_id, (date, release_id)) AS release_id FROM levels l JOIN knots k ON k.theta >= l.theta GROUP BY 1",
    "ahead": "SELECT level, stop, (theta - intercept - slope * stop) / slope AS gap, sqrt(pow((theta - intercept - slope * stop) / (slope * slope), 2) * slope_se * slope_se + pow(sigma / slope, 2)) AS sd FROM levels, trend WHERE level NOT IN (SELECT level FROM passed) AND slope > 0",
}


def _day(z: float) -> str:
    return f"DATE '1970-01-01' + CAST(floor(greatest(stop + gap + {z!r} * sd, stop) + 0.5) AS INT)"


@query(
    "crossings",
    o.sql(
        f"SELECT level, 'past' AS kind, date, release_id, NULL::DATE AS p05, NULL::DATE AS p16, NULL::DATE AS p84, NULL::DATE AS p95 FROM passed UNION ALL SELECT level, 'predicted', {_day(0.0)}, NULL, {_day(-1.6449)}, {_day(-1.0)}, {_day(1.0)}, {_day(1.6449)} FROM ahead WHERE gap > 0 AND gap <= 15 * 365",
        o.fit(), _EARLY_TREND, o.LEVELS, _CROSS,
    ),
)
def crossings(spark, sf_dir):
    models, deltas, _ = fitted(spark, sf_dir)
    return frontier.crossings(frontier.line(models).cache(), frontier.levels(deltas, a.benches(spark, sf_dir)), on(THEN)).drop("asof")


@query(
    "pace_eras",
    o.sql(
        f"""SELECT start, lead(start) OVER (ORDER BY start) AS "end", regime, {o.r6('mean_pace')} AS mean_pace, {o.r6('max_pace')} AS max_pace, months FROM (
        SELECT run, regime, min(at) AS start, avg(logits_per_year) AS mean_pace, max(logits_per_year) AS max_pace, count(*) AS months FROM (
        SELECT *, sum(new) OVER (ORDER BY at) AS run FROM (SELECT *, CASE WHEN lag(regime) OVER (ORDER BY at) = regime THEN 0 ELSE 1 END AS new FROM regimes)) GROUP BY 1, 2) WHERE (SELECT count(*) FROM regimes) >= 2""",
        o.fit(), o.GRID, o.DAILY, _PACE,
        {"regimes": "SELECT *, CASE WHEN logits_per_year < 0.5 THEN 'dormant' WHEN logits_per_year < 1.5 THEN 'climb' WHEN logits_per_year < 3 THEN 'acceleration' ELSE 'takeoff' END AS regime FROM paced"},
    ),
)
def pace_eras(spark, sf_dir):
    return rounded(frontier.eras(knots(spark, sf_dir), on(NOW)), "mean_pace", "max_pace").drop("asof")


_LATEST = {"latest": f"SELECT lab, max(date) AS date, arg_max(release_id, (date, release_id)) AS release_id FROM releases WHERE status = 'released' AND tier = 'flagship' AND date <= {o.ASOF} GROUP BY 1"}


@query("latest_per_lab", o.sql("SELECT lab, release_id, date FROM latest", _LATEST))
def latest_per_lab(spark, sf_dir):
    return lineup.latest_per_lab(a.releases(spark, sf_dir), on(NOW))


_RANKED = {"ranking": "SELECT m.*, row_number() OVER (ORDER BY qualified DESC, index DESC, m.release_id) AS place FROM latest l JOIN models m ON l.release_id = m.release_id"}


@query("current_ranking", o.sql(f"SELECT CAST(place AS INT) AS place, release_id, lab, {o.r6('index')} AS index, qualified FROM ranking", o.fit(), _LATEST, _RANKED))
def current_ranking(spark, sf_dir):
    return rounded(lineup.current_ranking(a.releases(spark, sf_dir), fitted(spark, sf_dir)[0], on(NOW)), "index").select("place", "release_id", "lab", "index", "qualified")


@query(
    "rank_ties",
    o.sql(
        "SELECT block, release_id, rank, count(*) OVER (PARTITION BY block, rank) > 1 AS tied FROM fold",
        o.fit(), _LATEST, _RANKED,
        {
            "placed": "SELECT qualified AS block, CAST(row_number() OVER (PARTITION BY qualified ORDER BY place) AS INT) AS k, release_id, rating - 400 / ln(10) * se AS low, rating + 400 / ln(10) * se AS high FROM ranking",
            "fold": "SELECT block, release_id, rank FROM (WITH RECURSIVE f AS (SELECT block, k, release_id, 1 AS rank, low FROM placed WHERE k = 1 UNION ALL SELECT p.block, p.k, p.release_id, CASE WHEN p.high < f.low THEN p.k ELSE f.rank END, CASE WHEN p.high < f.low THEN p.low ELSE f.low END FROM f JOIN placed p ON p.block = f.block AND p.k = f.k + 1) SELECT * FROM f)",
        },
    ),
)
def rank_ties(spark, sf_dir):
    ranking = lineup.current_ranking(a.releases(spark, sf_dir), fitted(spark, sf_dir)[0], on(NOW))
    return lineup.rank_ties(ranking.withColumn("block", F.col("qualified")))


@query("evidence_kind", o.sql("SELECT release_id, n, community, CASE WHEN n = 0 THEN 'none' WHEN community = n THEN 'community-only' WHEN community > 0 THEN 'mixed' ELSE 'official' END AS kind, CASE WHEN n = 0 THEN 'no index benchmarks' WHEN community < n THEN '' WHEN n = 1 THEN 'community Elo only' ELSE 'community scores only' END AS label FROM (SELECT s_suppkey, 'r-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS release_id, count(p.benchmark) AS n, count(*) FILTER (benchmark IN ('Brand#25', 'Brand#7', 'Brand#13')) AS community FROM supplier LEFT JOIN picked p ON p.release_id = 'r-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AND s_suppkey % 10 > 0 GROUP BY 1, 2)", {"picked": o.PICKED}))
def evidence_kind(spark, sf_dir):
    picked = fit.select_scores(a.scores(spark, sf_dir), a.benches(spark, sf_dir)).where("release_id not like '%0'")  # one release in ten counts as unscored
    return lineup.evidence(picked, F.col("benchmark").isin("Brand#25", "Brand#7", "Brand#13"), a.releases(spark, sf_dir))


@query("lab_lineup", o.sql(f"SELECT lab, tier, arg_max(release_id, (date, release_id)) AS release_id, {o.r6('arg_max(theta, (date, release_id))')} AS theta FROM models GROUP BY 1, 2", o.fit()))
def lab_lineup(spark, sf_dir):
    return rounded(lineup.lab_lineup(fitted(spark, sf_dir)[0], on(NOW)), "theta")


_BAND = {
    "tiers": "SELECT DISTINCT lab, date FROM models",
    "state": "SELECT t.lab, t.date, m.tier, arg_max({'t': m.theta, 'id': m.release_id}, (m.date, m.release_id)) AS s FROM tiers t JOIN models m ON m.lab = t.lab AND m.date <= t.date GROUP BY 1, 2, 3",
    "band": "SELECT lab, date, coalesce(any_value(s) FILTER (tier = 'flagship'), arg_max(s, s.t)) AS hi, arg_min(s, s.t) AS lo FROM state GROUP BY 1, 2",
}


@query("lineup_band", o.sql(f"SELECT lab, date, {o.r6('hi.t')} AS hi_theta, {o.r6('lo.t')} AS lo_theta, hi.id AS hi_id, lo.id AS lo_id FROM band", o.fit(), _BAND))
def lineup_band(spark, sf_dir):
    return rounded(lineup.lineup_band(fitted(spark, sf_dir)[0]), "hi_theta", "lo_theta")


_RIBBON = {
    "points": f"SELECT DISTINCT lab, date FROM models UNION SELECT lab, {o.ASOF} FROM models GROUP BY lab HAVING max(date) < {o.ASOF}",
    "ribbon": f"SELECT p.lab, p.date, arg_max({{'t': m.theta, 'id': m.release_id}}, (m.theta, -(m.date - DATE '1970-01-01'))) AS hi, arg_min({{'t': m.theta, 'id': m.release_id}}, (m.theta, m.date)) AS lo FROM points p JOIN (SELECT m.*, row_number() OVER (PARTITION BY lab ORDER BY date DESC, release_id DESC) AS newest FROM models m) m ON m.lab = p.lab AND m.date <= p.date AND (m.date >= p.date - 365 OR (newest = 1 AND p.date = {o.ASOF} AND m.date < p.date - 365)) GROUP BY 1, 2",
}


@query("family_ribbon", o.sql(f"SELECT lab, date, {o.r6('hi.t')} AS hi_theta, {o.r6('lo.t')} AS lo_theta, hi.id AS hi_id, lo.id AS lo_id FROM ribbon", o.fit(), _RIBBON))
def family_ribbon(spark, sf_dir):
    return rounded(lineup.family_ribbon(fitted(spark, sf_dir)[0], on(NOW)), "hi_theta", "lo_theta")


_LIFE = {
    "out": f"SELECT * FROM releases WHERE status = 'released' AND date <= {o.ASOF}",
    "reported": "SELECT s.benchmark, s.release_id, r.date, r.tier, max(value) FILTER (reported_by = 'official') AS best FROM scores s JOIN out r ON s.release_id = r.release_id GROUP BY 1, 2, 3, 4",
    "life": f"SELECT benchmark, min(date) AS first_score, count(*) AS n_scores, min(date) FILTER (best >= 95) AS saturated_at, count(*) FILTER (tier = 'flagship' AND {o.ASOF} - date <= 365) AS covered FROM reported GROUP BY 1",
    "recent": f"SELECT count(*) AS flagships FROM out WHERE tier = 'flagship' AND {o.ASOF} - date <= 365",
}


@query(
    "benchmark_lifetimes",
    o.sql(
        f"""SELECT b.benchmark, first_score, coalesce(n_scores, 0) AS n_scores, saturated_at, CASE WHEN legacy THEN 'legacy' WHEN saturated_at IS NOT NULL THEN 'saturated' WHEN {o.ASOF} - make_date(introduced, 7, 1) BETWEEN 0 AND 365 THEN 'fresh' ELSE 'active' END AS state,
        {o.r6('delta')} AS delta, {o.r6('CASE WHEN flagships > 0 THEN coalesce(covered, 0)::DOUBLE / flagships ELSE 0 END')} AS coverage FROM benches b LEFT JOIN life l ON b.benchmark = l.benchmark LEFT JOIN delta d ON b.benchmark = d.benchmark CROSS JOIN recent
        WHERE {o.ASOF} >= make_date(introduced, 7, 1) OR n_scores > 0""",
        o.fit(), _LIFE,
    ),
)
def benchmark_lifetimes(spark, sf_dir):
    return rounded(lineup.lifetimes(a.scores(spark, sf_dir), a.releases(spark, sf_dir), a.benches(spark, sf_dir), fitted(spark, sf_dir)[1], on(NOW)), "delta", "coverage")


@query(
    "comparability",
    o.sql(
        "SELECT m.release_id, count(DISTINCT u.benchmark) FILTER (v.benchmark IS NOT NULL) AS shared, count(DISTINCT n.release_id) AS neighbours FROM models m LEFT JOIN models n ON n.tier = 'flagship' AND n.release_id <> m.release_id AND abs(n.date - m.date) <= 548 LEFT JOIN rows u ON u.release_id = m.release_id LEFT JOIN rows v ON v.release_id = n.release_id AND v.benchmark = u.benchmark GROUP BY 1",
        o.fit(),
    ),
)
def comparability(spark, sf_dir):
    return lineup.comparability(fitted(spark, sf_dir)[2])


@query("evidence_by_halfyear", o.sql(f"SELECT CAST(year(date) AS INT) AS year, CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END AS half, count(*) AS fitted, {o.r6('avg(n)')} AS mean_n FROM models GROUP BY 1, 2", o.fit()))
def evidence_by_halfyear(spark, sf_dir):
    half = F.when(F.month("date") <= 6, 1).otherwise(2)
    return fitted(spark, sf_dir)[0].groupBy(F.year("date").alias("year"), half.alias("half")).agg(F.count("*").alias("fitted"), r6(F.avg("n")).alias("mean_n"))


@query("unscored_anti", o.sql("SELECT release_id, lab FROM releases WHERE status = 'released' AND release_id NOT IN (SELECT release_id FROM models)", o.fit("DATE '2021-06-30'")))
def unscored_anti(spark, sf_dir):
    return a.releases(spark, sf_dir).where("status = 'released'").join(fitted(spark, sf_dir, "2021-06-30")[0], "release_id", "left_anti").select("release_id", "lab")


@query("missing_basket_anti", o.sql("SELECT r.release_id, b.benchmark FROM releases r JOIN benches b ON b.in_index WHERE r.status = 'released' AND (r.release_id, b.benchmark) NOT IN (SELECT (release_id, benchmark) FROM picked)", {"picked": o.PICKED}))
def missing_basket_anti(spark, sf_dir):
    basket = a.benches(spark, sf_dir).where("in_index").agg(F.collect_list("benchmark").alias("basket"))  # the basket: a small dimension
    reported = fit.select_scores(a.scores(spark, sf_dir), a.benches(spark, sf_dir)).groupBy("release_id").agg(F.collect_set("benchmark").alias("has"))
    rows = a.releases(spark, sf_dir).where("status = 'released'").join(reported, "release_id", "left").join(F.broadcast(basket))
    return rows.select("release_id", F.explode(F.array_except("basket", F.coalesce("has", F.array().cast("array<string>")))).alias("benchmark"))


_TREND_SQL = {
    "good": "SELECT *, count(*) FILTER (qualified) OVER (PARTITION BY lab) AS good FROM models WHERE tier = 'flagship'",
    "last5": "SELECT *, date - DATE '1970-01-01' AS x FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY date DESC, release_id DESC) AS k FROM good WHERE good < 2 OR qualified) WHERE k <= 5",
    "lines": "SELECT lab, count(*) AS n, regr_sxx(theta, x) AS sxx, regr_slope(theta, x) AS b, greatest(0.0, regr_syy(theta, x) - CASE WHEN regr_sxx(theta, x) > 0 THEN regr_sxy(theta, x) * regr_sxy(theta, x) / regr_sxx(theta, x) END) AS sse, avg(x) AS xb, avg(theta) AS yb, max(x) - min(x) AS span, stddev_pop(theta) AS sd, any_value(sigma) AS g FROM last5 GROUP BY 1",
    "trends": "SELECT *, CASE WHEN n = 1 OR sxx <= 0 THEN 0 ELSE b END AS slope, CASE WHEN n = 1 THEN g WHEN sxx <= 0 THEN greatest(g, sd) ELSE greatest(g, sqrt(sse / greatest(1, n - 2))) END AS noise FROM lines",
    "trended": "SELECT lab, n, slope, yb - slope * xb AS intercept, noise AS sigma, CASE WHEN n = 1 OR sxx <= 0 THEN 0 WHEN n = 2 THEN g / span ELSE noise / sqrt(sxx) END AS slope_se FROM trends",
}



@query("capability_trend", o.sql(f"SELECT lab, n, {o.r6('slope')} AS slope, {o.r6('intercept')} AS intercept, {o.r6('sigma')} AS sigma, {o.r6('slope_se')} AS slope_se FROM trended", o.fit(), _TREND_SQL))
def capability_trend(spark, sf_dir):
    return rounded(forecast.capability_trend(fitted(spark, sf_dir)[0]), "slope", "intercept", "sigma", "slope_se").drop("asof")


@query(
    "capability_fan",
    o.sql(
        f"""SELECT lab, date, {o.r6('theta')} AS theta, {o.r6('theta - half')} AS theta_low, {o.r6('theta + half')} AS theta_high FROM (SELECT t.lab, CAST(d AS DATE) AS date,
        least(greatest(intercept + slope * (CAST(d AS DATE) - DATE '1970-01-01'), {o.clipped('(l.index - 5)')}), {o.clipped('99.5')}) AS theta, 1.2816 * sqrt(sigma * sigma + pow(slope_se * greatest(0, CAST(d AS DATE) - l.date), 2)) AS half
        FROM trended t JOIN lastm l ON t.lab = l.lab, (SELECT unnest(generate_series({o.ASOF}, DATE '2025-06-01', INTERVAL 7 DAY)) AS d))""",
        o.fit(), _TREND_SQL, {"lastm": "SELECT lab, max(date) AS date, arg_max(index, (date, release_id)) AS index FROM models WHERE tier = 'flagship' GROUP BY 1"},
    ),
)
def capability_fan(spark, sf_dir):
    models = fitted(spark, sf_dir)[0]
    last = models.where("tier = 'flagship'").groupBy("lab").agg(F.max("date").alias("date"), F.max_by("index", F.struct("date", "release_id")).alias("index"))
    return rounded(forecast.capability_fan(forecast.capability_trend(models), last, on(NOW), F.lit("2025-06-01").cast("date")), "theta", "theta_low", "theta_high")


_ELO = {"picked": o.PICKED.replace(f"{o.clipped('value')} AS y", f"CASE WHEN benchmark = 'Brand#11' THEN ln((least(greatest(1 / (1 + pow(10.0, (50.0 - value) / 400)), 0.005), 0.995)) / (1 - least(greatest(1 / (1 + pow(10.0, (50.0 - value) / 400)), 0.005), 0.995))) ELSE {o.clipped('value')} END AS y")}


def _elo_benches(spark, sf_dir):
    return a.benches(spark, sf_dir).withColumns({"unit": F.when(F.col("benchmark") == "Brand#11", "elo").otherwise("%"), "elo_reference": F.when(F.col("benchmark") == "Brand#11", 50.0)})


@query("elo_fit", o.sql(f"SELECT release_id, {o.r6('theta')} AS theta, n FROM models", o.fit(), _ELO))
def elo_fit(spark, sf_dir):
    models, _, _ = fit.fit(a.scores(spark, sf_dir), a.releases(spark, sf_dir), _elo_benches(spark, sf_dir), dates(spark, NOW))
    return rounded(models, "theta").select("release_id", "theta", "n")
