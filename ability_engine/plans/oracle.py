"""SQL of the adapter relations and of the fit, from which the oracle queries are put together. The fit is unrolled alternating least squares."""

from __future__ import annotations

import re

from ability_engine.functions.scalar import QUANTILE, TAIL_BOTTOM, TAIL_TOP
from ability_engine.operators.fit import CONFIG_STOPWORDS

SWEEPS = 70
_STOP = "[" + ", ".join(f"'{w}'" for w in CONFIG_STOPWORDS) + "]"
ASOF = "DATE '2025-02-01'"
CUSTOMER_ASOF = "DATE '2000-06-30'"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


def clipped(x: str) -> str:
    return f"ln((least(greatest({x}, 0.5), 99.5) / 100) / (1 - least(greatest({x}, 0.5), 99.5) / 100))"


def horner(x: str, factors: tuple[float, ...]) -> str:
    out = repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r})"
    return out


def normal_cdf(x: str) -> str:
    z = f"abs({x})"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN exp(-({x}) * ({x}) / 2) * {horner(z, TAIL_TOP)} / {horner(z, TAIL_BOTTOM)} ELSE exp(-({x}) * ({x}) / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / sqrt(2 * pi()) END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_quantile(p: str) -> str:
    r, t = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    ratio = lambda x, k: f"{horner(x, QUANTILE[k][0])} / {horner(x, QUANTILE[k][1])}"
    tail = f"(CASE WHEN {t} <= 5 THEN {ratio(f'({t} - 1.6)', 1)} ELSE {ratio(f'({t} - 5)', 2)} END)"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(r, 0)} WHEN {p} < 0.5 THEN -{tail} ELSE {tail} END)"


ADAPTERS = {
    "benches": """SELECT p_brand AS benchmark, n AS basket_pos, CASE WHEN n = 25 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, n <= 6 AS legacy, 1 + n % 4 AS generation,
        (n <= 20 OR n = 25) AS in_index, 2016 + n % 10 AS introduced, CASE WHEN n % 5 = 0 THEN 40.0 + n END::DOUBLE AS human_baseline, 'no tools, pass@1' AS preferred_config
        FROM (SELECT DISTINCT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS n FROM part)""",
    "releases": """SELECT 'r-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS release_id, s_nationkey AS lab, DATE '2019-01-01' + CAST((37 * s_suppkey) % 2200 AS INT) AS date,
        CASE s_suppkey % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'flagship' END AS tier, CASE WHEN s_suppkey % 11 = 0 THEN 'announced' ELSE 'released' END AS status FROM supplier""",
    "scores": """SELECT 'r-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS release_id, benchmark, 100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(*) AS value,
        CASE l_linestatus WHEN 'F' THEN 'official' ELSE 'maintainer' END AS reported_by, CASE odd WHEN 1 THEN 'pass@1' ELSE 'default' END AS config, CASE l_linestatus WHEN 'F' THEN 0 ELSE 2 END + odd AS score_pos
        FROM (SELECT l_suppkey, p_brand AS benchmark, l_linestatus, l_returnflag, l_linenumber % 2 AS odd FROM lineitem JOIN part ON l_partkey = p_partkey
              WHERE (7 * l_suppkey + 3 * CAST(replace(p_brand, 'Brand#', '') AS INT)) % 10 < 4) GROUP BY l_suppkey, benchmark, l_linestatus, odd""",
    "launches": """SELECT 'o-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS release_id, o_custkey AS lab, CAST(o_orderdate AS DATE) AS date,
        CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN 'mid' WHEN '5' THEN 'small' ELSE 'flagship' END AS tier, CASE o_orderstatus WHEN 'P' THEN 'announced' ELSE 'released' END AS status FROM orders""",
    "visits": "SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS address, CASE event_type WHEN 'error' THEN 'bot' ELSE 'visit' END AS class FROM events",
}

PICKED = f"""SELECT release_id, benchmark, weight AS w, legacy, value, config, reported_by, {clipped('value')} AS y FROM (
    SELECT s.*, b.weight, b.legacy, row_number() OVER (PARTITION BY release_id, s.benchmark ORDER BY CASE reported_by WHEN 'official' THEN 0 ELSE 2 END
        + CASE WHEN list_has_any({tokens('config')}, {tokens('preferred_config')}) THEN 0 ELSE 1 END, score_pos) AS k
    FROM scores s JOIN benches b ON s.benchmark = b.benchmark WHERE b.in_index) WHERE k = 1"""


def fit(dates: str = ASOF) -> dict[str, str]:
    """obs, delta, rows, sig and models as of the listed dates."""
    out = {
        "picked": PICKED,
        "grid": f"SELECT unnest([{dates}]) AS asof",
        "obs": "SELECT g.asof, r.lab, r.date, r.tier, p.* FROM picked p JOIN releases r ON p.release_id = r.release_id AND r.status = 'released' JOIN grid g ON r.date <= g.asof",
        "d0": "SELECT DISTINCT asof, benchmark, legacy, 0.0::DOUBLE AS delta FROM obs",
    }
    for k in range(1, SWEEPS + 1):
        out[f"t{k}"] = f"SELECT o.asof, release_id, sum(w * (y + delta)) / (sum(w) + 0.05) AS theta FROM obs o JOIN d{k - 1} d ON o.asof = d.asof AND o.benchmark = d.benchmark GROUP BY 1, 2"
        out[f"u{k}"] = f"SELECT o.asof, benchmark, legacy, sum(w * (theta - y)) / (sum(w) + 0.05) AS delta FROM obs o JOIN t{k} t ON o.asof = t.asof AND o.release_id = t.release_id GROUP BY 1, 2, 3"
        out[f"c{k}"] = f"SELECT asof, coalesce(avg(delta) FILTER (NOT legacy), avg(delta)) AS c FROM u{k} GROUP BY 1"
        out[f"d{k}"] = f"SELECT u.asof, benchmark, legacy, delta - c AS delta FROM u{k} u JOIN c{k} c ON u.asof = c.asof"
    n = SWEEPS
    return out | {
        "delta": f"SELECT asof, benchmark, delta FROM d{n}",
        "rows": f"SELECT o.*, d.delta, t.theta - c.c AS theta, o.y - (t.theta - c.c - d.delta) AS residual FROM obs o JOIN d{n} d ON o.asof = d.asof AND o.benchmark = d.benchmark JOIN t{n} t ON o.asof = t.asof AND o.release_id = t.release_id JOIN c{n} c ON o.asof = c.asof",
        "sig": "SELECT asof, sqrt(sum(w * residual * residual) / greatest(1.0, sum(w) - (count(DISTINCT release_id) + count(DISTINCT benchmark) - 1))) AS sigma FROM rows GROUP BY 1",
        "models": "SELECT *, 100 / (1 + exp(-theta)) AS index, 1000 + 400 / ln(10) * theta AS rating, n >= 3 AS qualified, sigma / sqrt(n) AS se FROM (SELECT r.asof, release_id, lab, date, tier, any_value(theta) AS theta, count(*) AS n, any_value(sigma) AS sigma FROM rows r JOIN sig s ON r.asof = s.asof GROUP BY 1, 2, 3, 4, 5)",
        "ordered": "SELECT *, max(index) OVER (PARTITION BY asof ORDER BY date, release_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM models WHERE qualified AND tier = 'flagship'",
        "knots": f"SELECT asof, date, release_id, lab, index, {clipped('index')} AS theta FROM ordered WHERE best IS NULL OR index > best",
    }


#: The step function of the knots, by day, in trailing windows of 365 days up to each date of at_grid.
DAILY = {
    "spine": "SELECT g.at, CAST(unnest(generate_series(greatest(g.at - 365, (SELECT min(date) FROM knots)), g.at, INTERVAL 1 DAY)) AS DATE) AS day FROM at_grid g",
    "steps": "SELECT g.at, count(*) AS steps, count(DISTINCT date) AS dates FROM at_grid g JOIN knots k ON k.date BETWEEN g.at - 365 AND g.at GROUP BY 1",
    "daily": "SELECT s.at, s.day - DATE '1970-01-01' AS x, k.theta, k.index FROM spine s ASOF JOIN (SELECT date, max(theta) AS theta, max(index) AS index FROM knots GROUP BY 1) k ON s.day >= k.date",
    "ols": "SELECT at, count(*) AS n, regr_slope(theta, x) AS slope, regr_intercept(theta, x) AS intercept, regr_slope(index, x) AS slope_index, greatest(0.0, regr_syy(theta, x) - regr_sxy(theta, x) * regr_sxy(theta, x) / regr_sxx(theta, x)) AS sse, regr_sxx(theta, x) AS sxx FROM daily GROUP BY 1 HAVING count(*) >= 2",
}
MONTHS = f"SELECT CAST(unnest(generate_series(date_trunc('month', m) + INTERVAL 1 MONTH, {ASOF}, INTERVAL 1 MONTH)) AS DATE) AS at, m FROM (SELECT min(date) AS m FROM knots)"
GRID = {"months": MONTHS, "at_grid": "SELECT at FROM months WHERE at - m >= 365"}
TREND = {"at_grid": f"SELECT {ASOF} AS at"} | DAILY | {"trend": "SELECT o.at, slope, intercept, sqrt(sse / (n - 2)) AS sigma, sqrt(sse / (n - 2)) / sqrt(sxx) AS slope_se, o.at - DATE '1970-01-01' AS stop FROM ols o JOIN steps s ON o.at = s.at WHERE steps >= 2"}
LEVELS = {
    "full": "SELECT b.*, delta, delta + ln(0.95 / 0.05) AS theta FROM delta d JOIN benches b ON d.benchmark = b.benchmark",
    "levels": """SELECT 'human:' || benchmark AS level, 'human' AS kind, delta + ln(human_baseline / (100 - human_baseline)) AS theta FROM full WHERE human_baseline > 0 AND human_baseline < 100
        UNION ALL SELECT 'sat:' || benchmark, 'saturation', theta FROM full UNION ALL SELECT 'gen:' || generation, 'generation', avg(theta) FROM full GROUP BY generation
        UNION ALL SELECT 'ceiling', 'ceiling', max(theta) FROM full WHERE NOT legacy""",
}


def sql(final: str, *parts: dict[str, str]) -> str:
    """One statement of the adapter relations, further relations and ``final``."""
    ctes = dict(ADAPTERS)
    for p in parts:
        ctes |= p
    text = "WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k not in ADAPTERS else ''}({v})" for k, v in ctes.items()) + "\n" + final
    return re.sub(r"\b(asof|at|full)\b", r'"\1"', text)  # keywords of some engines


#: The forecast, by (asof, lab), from event_dates on. dates_grid holds the dates to stand at.
def laws(dates: str) -> dict[str, str]:
    return {
        "dates_grid": f"SELECT unnest([{dates}]) AS asof",
        "event_dates": "SELECT DISTINCT lab, date FROM launches WHERE status = 'released' AND tier = 'flagship'",
        "gaps": "SELECT * FROM (SELECT lab, date, date - lag(date) OVER (PARTITION BY lab ORDER BY date) AS gap FROM event_dates) WHERE gap >= 1",
        "wgaps": "SELECT g.asof, lab, ln(gap) AS x, (date - DATE '1970-01-01')::DOUBLE AS t, pow(0.5, (g.asof - date) / 730.0::DOUBLE) AS w FROM gaps JOIN dates_grid g ON date <= g.asof",
        "pool1": "SELECT asof, sum(w * x) / sum(w) AS mu, sum(w * t) / sum(w) AS t_bar, sum(w) * sum(w) / sum(w * w) AS n, count(*) AS gaps FROM wgaps GROUP BY 1",
        "prior": "SELECT p.asof, any_value(p.mu) AS mu, CASE WHEN any_value(gaps) < 2 THEN 0.6 ELSE sqrt(sum(w * (x - mu) * (x - mu)) / sum(w)) END AS sigma, any_value(n) AS n, sum(w * (t - t_bar) * (x - mu)) / (sum(w * (t - t_bar) * (t - t_bar)) + 730.0 * 730.0) AS drift, any_value(t_bar) AS t_bar FROM wgaps g JOIN pool1 p ON g.asof = p.asof GROUP BY 1",
        "own1": "SELECT asof, lab, sum(w * x) / sum(w) AS mean, sum(w * t) / sum(w) AS t_bar, sum(w) * sum(w) / sum(w * w) AS n FROM wgaps GROUP BY 1, 2",
        "own": "SELECT o.asof, o.lab, any_value(mean) AS mean, any_value(t_bar) AS t_bar, any_value(n) AS n, sum(w * (x - mean) * (x - mean)) / sum(w) AS variance FROM wgaps g JOIN own1 o ON g.asof = o.asof AND g.lab = o.lab GROUP BY 1, 2",
        "latest": "SELECT g.asof, lab, max(date) AS last FROM event_dates JOIN dates_grid g ON date <= g.asof GROUP BY 1, 2",
        "laws": """SELECT l.asof, l.lab, l.last, (l.asof - l.last)::DOUBLE AS t0, (coalesce(o.n * o.mean, 0) + 2 * p.mu) / (coalesce(o.n, 0) + 2)
            + least(1.0, greatest(-1.0, p.drift * ((l.asof - DATE '1970-01-01') - coalesce(o.t_bar, p.t_bar)))) AS mu, sqrt((coalesce(o.n * o.variance, 0) + 2 * p.sigma * p.sigma) / (coalesce(o.n, 0) + 2)) AS sigma
            FROM latest l JOIN prior p ON l.asof = p.asof LEFT JOIN own o ON l.asof = o.asof AND l.lab = o.lab""",
        "gone": f"SELECT *, CASE WHEN t0 <= 0 THEN 0.0 ELSE {normal_cdf('((ln(greatest(t0, 1)) - mu) / sigma)')} END AS gone FROM laws",
    }


def waits(quantiles: dict[str, float], scale: str = "1.0", source: str = "gone") -> dict[str, str]:
    """waits: the laws with quantiles of the wait, stretched about the median."""
    names = {**quantiles, "mid": 0.5}
    ps = ", ".join(f"least(greatest(gone + {q!r} * (1 - gone), 1e-12), 1 - 1e-12) AS p_{n}" for n, q in names.items())
    raws = ", ".join(f"CASE WHEN t0 > 0 AND 1 - gone < 1e-9 THEN t0 + 1 ELSE exp(mu + sigma * {normal_quantile(f'p_{n}')}) END AS raw_{n}" for n in names)
    return {"ps": f"SELECT *, {ps} FROM {source}", "raws": f"SELECT *, {raws} FROM ps", "waits": f"SELECT *, {', '.join(f'raw_mid * pow(raw_{n} / raw_mid, {scale}) AS {n}' for n in quantiles)} FROM raws"}


def moved(date: str, days: str) -> str:
    return f"({date} + CAST(floor(least(greatest({days}, 0.0), 36500.0) + 0.5) AS INT))"


ACTUAL = {"actual": "SELECT g.asof, lab, min(date) AS actual FROM event_dates JOIN dates_grid g ON date > g.asof GROUP BY 1, 2"}
