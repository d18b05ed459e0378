"""Queries of the views, on the star of suppliers (fitted), on orders (releases) and customers (labs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ability_engine.operators import forecast, frontier, views
from ability_engine.plans import ability, cadence
from ability_engine.plans import oracle as o
from ability_engine.plans.ability import dates, fitted, on, r6, rounded
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

_NEXT = {"firsts": f"SELECT lab, {o.moved('last', 'p50')} AS p50 FROM waits"}


def _firsts(spark, sf_dir):
    return forecast.chain(cadence._laws(spark, sf_dir, cadence.ONE), 1)


@query("bundle_order", "SELECT o_orderkey AS release_id, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_custkey % 7, o_orderkey) AS BIGINT) AS place FROM orders")
def bundle_order(spark, sf_dir):
    releases = a.table(spark, sf_dir, "orders").selectExpr("o_orderkey as release_id", "o_custkey as lab", "cast(o_orderdate as date) as date")
    labs = a.table(spark, sf_dir, "customer").selectExpr("c_custkey as lab", "c_custkey % 7 as lab_pos")
    return views.with_place(views.bundle_releases(releases, labs), "date", F.coalesce("lab_pos", F.lit(0)), "release_id").select("release_id", "place")


@query("bundle_document", "SELECT 1 AS version, (SELECT count(*) FROM supplier) AS releases, (SELECT count(*) FROM nation) AS labs, (SELECT count(DISTINCT p_brand) FROM part) AS benchmarks, 100 AS recent_changes")
def bundle_document(spark, sf_dir):
    labs = a.table(spark, sf_dir, "nation").selectExpr("n_nationkey as lab", "n_nationkey as lab_pos", "n_name as name")
    changes = a.table(spark, sf_dir, "events").selectExpr("cast(ts as string) as at", "cast(event_id as string) as release_id", "event_type as kind")
    doc = views.bundle(a.releases(spark, sf_dir), labs, a.benches(spark, sf_dir), changes, "2025-02-01T00:00:00Z")
    parts = {n: F.size(F.from_json("value", f"{n} array<struct<x:string>>")[n]).cast("long").alias(n) for n in ("releases", "labs", "benchmarks")}
    return doc.select(F.get_json_object("value", "$.version").cast("int").alias("version"), *parts.values(), F.size(F.from_json("value", "recent_changes array<struct<at:string>>")["recent_changes"]).alias("recent_changes"))


@query("source_counts", "SELECT l_suppkey AS release_id, CAST(count(DISTINCT l_partkey) + count(DISTINCT l_linenumber) + 1 AS INT) AS sources FROM lineitem GROUP BY 1")
def source_counts(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("release_id")).agg(F.collect_list(F.concat(F.lit("p"), "l_partkey")).alias("source_urls"), F.collect_list(F.concat(F.lit("l"), "l_linenumber")).alias("score_urls"))
    return views.source_count(rows.withColumn("announcement_url", F.lit("a")))


@query("best_provisional", o.sql("SELECT release_id, lab, n FROM (SELECT *, row_number() OVER (ORDER BY index DESC, release_id) AS k FROM models WHERE n < 9) WHERE k = 1", o.fit()))
def best_provisional(spark, sf_dir):
    return views.best_provisional(fitted(spark, sf_dir)[0].withColumn("qualified", F.col("n") >= 9)).select("release_id", "lab", "n")


@query("next_up", o.sql(f"SELECT lab, p50 FROM firsts WHERE p50 >= {o.CUSTOMER_ASOF} ORDER BY p50, lab LIMIT 1", o.laws(cadence.SQL_ONE), o.waits({"p50": 0.5}), _NEXT))
def next_up(spark, sf_dir):
    return views.next_up(_firsts(spark, sf_dir)).select("lab", "p50")


@query("watch_order", o.sql("SELECT c.c_custkey AS lab, CAST(row_number() OVER (ORDER BY p50 NULLS LAST, c_name, c_custkey) AS INT) AS place FROM customer c LEFT JOIN firsts f ON f.lab = c.c_custkey", o.laws(cadence.SQL_ONE), o.waits({"p50": 0.5}), _NEXT))
def watch_order(spark, sf_dir):
    return views.watch_order(a.table(spark, sf_dir, "customer").selectExpr("c_custkey as lab", "c_name as name"), _firsts(spark, sf_dir)).select("lab", "place")


@query("near_fan_end", o.sql(f"SELECT lab, least({o.moved('last', 'p95')} + 30, DATE '2001-06-30') AS \"end\" FROM waits", o.laws(cadence.SQL_ONE), o.waits({"p95": 0.95})))
def near_fan_end(spark, sf_dir):
    return views.near_end(_firsts(spark, sf_dir), on("2001-06-30")).select("lab", "end")


@query("spotlight_labs", "SELECT o_orderstatus AS asof, o_custkey AS lab FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p30 DESC, o_custkey) AS n FROM (SELECT o_orderstatus, o_custkey, max(o_totalprice) AS p30 FROM orders GROUP BY 1, 2)) WHERE n <= 3 OR o_custkey = 17")
def spotlight_labs(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("asof"), F.col("o_custkey").alias("lab")).agg(F.max("o_totalprice").alias("p30"))
    return views.spotlight(rows, F.lit(17))


#: The laws of the star of suppliers; as in the operator, the defaults stand where no lab has a gap.
_LAWS = o.laws(o.ASOF)
_STAR = _LAWS | {
    "event_dates": _LAWS["event_dates"].replace("launches", "releases"),
    "prior": f"SELECT g.asof, coalesce(p.mu, {forecast.DEFAULT_MU!r}) AS mu, coalesce(p.sigma, {forecast.DEFAULT_SIGMA!r}) AS sigma, coalesce(p.n, 0.0) AS n, coalesce(p.drift, 0.0) AS drift, coalesce(p.t_bar, 0.0) AS t_bar FROM dates_grid g LEFT JOIN ({_LAWS['prior']}) p ON g.asof = p.asof",
}


@query("headline", o.sql(
    f"""SELECT k.release_id AS top_id, {o.r6('k.index')} AS top_index, s.steps, {o.r6('v.logits_per_year')} AS logits_per_year, {o.r6('CASE WHEN v.doubling_days < 3650 THEN v.doubling_days / 30.4375 END')} AS doubling_months, n.lab AS next_lab, n.p50 AS next_date, CASE WHEN p.index > k.index THEN p.release_id END AS provisional_id
    FROM (SELECT * FROM knots ORDER BY date DESC, release_id DESC LIMIT 1) k, (SELECT count(*) AS steps FROM knots) s LEFT JOIN (SELECT * FROM models WHERE NOT qualified ORDER BY index DESC, release_id LIMIT 1) p ON true LEFT JOIN paced v ON true LEFT JOIN (SELECT lab, p50 FROM firsts WHERE p50 >= {o.ASOF} ORDER BY p50, lab LIMIT 1) n ON true""",
    o.fit(), {"at_grid": f"SELECT {o.ASOF} AS at"}, o.DAILY, ability._PACE, _STAR, o.waits({"p50": 0.5}), _NEXT))
def headline(spark, sf_dir):
    # Kept apart: as one plan, fit and forecast are planned anew after each of their stages, and fill the driver.
    models = fitted(spark, sf_dir)[0].persist()
    line = frontier.line(models).cache()
    now = dates(spark, ability.NOW)
    coming = views.next_up(forecast.chain(forecast.laws(a.releases(spark, sf_dir), now).cache(), 1))
    found = views.headline(line, frontier.pace(line, now.withColumn("at", F.col("asof"))), coming, views.best_provisional(models))
    return rounded(found, "top_index", "logits_per_year", "doubling_months").select("top_id", "top_index", "steps", "logits_per_year", "doubling_months", "next_lab", "next_date", "provisional_id")


@query("known_and_age", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2001-05-06' ELSE d END AS known, CASE WHEN floor((DATE '2002-01-01' - d) / (365.25 / 12)) >= 1 THEN CAST(floor((DATE '2002-01-01' - d) / (365.25 / 12)) AS INT) END AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def known_and_age(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    seen = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2001-05-06T01:02:03Z")).when(F.col("o_orderkey") % 3 == 1, F.lit("2001"))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", views.known_at(seen, date).alias("known"), views.age_months(date, on("2002-01-01")).alias("age"))


@query("score_use", o.sql("SELECT s.release_id, s.benchmark, s.score_pos, CASE WHEN p.benchmark IS NOT NULL THEN 'used' WHEN b.in_index THEN 'not used' ELSE 'off-index' END AS use, CAST(row_number() OVER (PARTITION BY s.release_id ORDER BY CASE WHEN b.in_index THEN 0 ELSE 1000 END + b.basket_pos, s.score_pos) AS INT) AS place FROM scores s JOIN benches b ON s.benchmark = b.benchmark LEFT JOIN picked p ON p.release_id = s.release_id AND p.benchmark = s.benchmark AND p.value = s.value", {"picked": o.PICKED}))
def score_use(spark, sf_dir):
    from ability_engine.operators import fit

    scores, benches = a.scores(spark, sf_dir), a.benches(spark, sf_dir)
    used = fit.select_scores(scores, benches)
    return views.score_use(views.ordered_scores(scores, benches), used, benches).select("release_id", "benchmark", "score_pos", "use", "place")


@query("backtest_badges", o.sql("SELECT lab, CASE WHEN actual IS NULL THEN 'no release yet' WHEN in68 THEN '68' WHEN in90 THEN '90' ELSE 'miss' END AS badge, CAST(row_number() OVER (ORDER BY p50, lab) AS INT) AS place FROM backtest WHERE asof = DATE '1999-01-01'", *cadence._REPLAY))
def backtest_badges(spark, sf_dir):
    rows = forecast.backtest(*cadence._replay(spark, sf_dir)).where("asof = date'1999-01-01'")
    return views.backtest_order(rows).select("lab", views.hit_badge(F.col("p50"), F.col("actual"), F.col("in68"), F.col("in90")).alias("badge"), "place")


@query("rank_groups", "WITH r AS (SELECT c_custkey, c_acctbal > 0 AS q, row_number() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT c_custkey AS release_id, n + CASE WHEN q THEN 0 ELSE (SELECT count(*) FROM r WHERE q) END AS rank, false AS tied, CAST(0 AS INT) AS pos, CAST(1 AS BIGINT) AS size FROM r")
def rank_groups(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer").selectExpr("1 as block", "cast(c_custkey as string) as release_id", "c_custkey", "c_acctbal", "c_acctbal > 0 as qualified", "0.0D as se")
    ranking = views.with_place(rows, F.desc("qualified"), F.desc("c_acctbal"), "c_custkey").withColumn("rating", -F.col("place").cast("double"))
    return views.rank_groups(ranking.select("block", "place", "release_id", "qualified", "rating", "se")).selectExpr("cast(release_id as bigint) as release_id", "rank", "tied", "pos", "size")


_POINTS = "SELECT c_custkey AS point_id, DATE '2019-06-01' + CAST(c_custkey % 2000 AS INT) AS date FROM customer"


@query("level_at_dates", o.sql(f"SELECT point_id, {o.r6('(SELECT arg_max(index, date) FROM knots k WHERE k.date <= p.date)')} AS index, {o.r6('(SELECT arg_min(index, (abs(k.date - p.date), k.date)) FROM (SELECT date, max(index) AS index FROM knots GROUP BY 1) k)')} AS near FROM ({_POINTS}) p", o.fit()))
def level_at_dates(spark, sf_dir):
    line = ability.knots(spark, sf_dir).groupBy("asof", "date").agg(F.max("index").alias("index"))
    points = a.table(spark, sf_dir, "customer").selectExpr("c_custkey as point_id", f"date'{ability.NOW}' as asof", "date_add(date'2019-06-01', cast(c_custkey % 2000 as int)) as date")
    near = views.nearest(points.select("point_id", "date"), line.select("date", "index"), "index").select("point_id", F.col("index").alias("near"))
    return rounded(views.level_at(points, line, "index").join(near.hint("merge"), "point_id"), "index", "near").select("point_id", "index", "near")


@query("density_points", "SELECT c_nationkey AS lab, c_custkey / 1.0 AS day, round(CASE WHEN c_custkey > 100 THEN 0 ELSE c_custkey / 10.0 END, 6)::DOUBLE AS p FROM customer")
def density_points(spark, sf_dir):
    samples = a.table(spark, sf_dir, "nation").selectExpr("n_nationkey as lab", "explode(sequence(0, 10)) as i").selectExpr("lab", "i * 10.0D as day", "i * 1.0D as p")
    points = a.table(spark, sf_dir, "customer").selectExpr("c_nationkey as lab", "cast(c_custkey as double) as day")
    return views.density_at(samples, points).select("lab", "day", r6("p").alias("p"))


@query("axis_extents", o.sql(f"SELECT {o.r6('greatest(0.0, a - pad)')} AS lo, {o.r6('least(100.0, b + pad)')} AS hi, {o.r6('floor((t - 0.45) / 0.25) * 0.25')} AS nice_lo, {o.r6('ceil((u + 0.15) / 0.25) * 0.25')} AS nice_hi FROM (SELECT *, greatest(2.0, (b - a) * 0.12) AS pad FROM (SELECT min(100 / (1 + exp(-(theta - se)))) AS a, max(100 / (1 + exp(-(theta + se)))) AS b, min(theta) AS t, max(theta) AS u FROM models))", o.fit()))
def axis_extents(spark, sf_dir):
    models = fitted(spark, sf_dir)[0]
    return rounded(views.index_extent(models).crossJoin(views.theta_extent(models, "theta", "theta").select("nice_lo", "nice_hi")), "lo", "hi", "nice_lo", "nice_hi")  # one row each


@query("stages_order", "SELECT section, name, CAST(row_number() OVER (PARTITION BY section ORDER BY d DESC, name) AS INT) AS place FROM (SELECT CAST(c_custkey % 3 AS INT) AS section, c_name AS name, DATE '2020-01-01' + CAST(c_custkey % 50 AS INT) AS d FROM customer)")
def stages_order(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer").selectExpr("c_custkey % 3 as s", "c_name as name", "c_name as regime", "date_add(date'2020-01-01', cast(c_custkey % 50 as int)) as date").withColumn("start", F.col("date"))
    return views.stages_panel(rows.where("s = 0"), rows.where("s = 1"), rows.where("s = 2")).select("section", "name", "place")


@query("projected_era", "SELECT c_custkey AS at, CASE WHEN s < 0.5 THEN 'dormant' WHEN s < 1.5 THEN 'climb' WHEN s < 3 THEN 'acceleration' ELSE 'takeoff' END AS regime FROM (SELECT c_custkey, c_custkey % 9 / 2000.0::DOUBLE * 365 AS s FROM customer)")
def projected_era(spark, sf_dir):
    return views.projected_era(a.table(spark, sf_dir, "customer").selectExpr("c_custkey as at", "c_custkey % 9 / 2000.0D as slope"))


@query("marker_levels", """SELECT o_orderkey AS release_id, CASE WHEN o_orderkey % 10 = 0 THEN 77.0 WHEN d > DATE '1998-01-01' THEN 66.0 WHEN lab = 0 THEN coalesce((SELECT arg_max(k * 1.0, k) FROM (SELECT unnest(range(0, 60)) AS k) WHERE DATE '1995-01-01' + CAST(k * 20 AS INT) <= d), 59.0) WHEN d < DATE '1996-01-01' THEN 10.0 WHEN d < DATE '1997-01-01' THEN 10.0 ELSE 20.0 END::DOUBLE AS level FROM (SELECT o_orderkey, o_custkey % 2 AS lab, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def marker_levels(spark, sf_dir):
    markers = a.table(spark, sf_dir, "orders").selectExpr("o_orderkey as release_id", "o_custkey % 2 as lab", "date'1998-01-01' as asof", "cast(o_orderdate as date) as date")
    own = markers.where("release_id % 10 = 0").selectExpr("release_id", "77.0D as index")
    coming = spark.createDataFrame([(0, 66.0), (1, 66.0)], "lab long, index double")
    qualified = spark.range(60).selectExpr("0L as lab", "date_add(date'1995-01-01', cast(id * 20 as int)) as date", "cast(id as string) as release_id", "id * 1.0D as index")
    knots = spark.sql("select date'1998-01-01' as asof, d as date, i as index from values (date'1996-01-01', 10.0D), (date'1997-01-01', 20.0D) t(d, i)").withColumn("index", F.col("index"))
    front = knots.unionByName(spark.sql("select date'1998-01-01' as asof, date'1900-01-01' as date, 10.0D as index"))
    return views.marker_level(markers, own, coming, qualified, front).select("release_id", "level")
