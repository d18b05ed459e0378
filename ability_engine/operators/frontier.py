"""The frontier: running maximum of ability over time, its pace, levels, crossings and eras.

A running maximum over all releases needs no global sort of them: the maximum of each day is an aggregate, the running maximum over days is one
of calendar length, and only releases above the best of all days before theirs are looked at one by one. The regressions of the daily sampled
step function use the closed sums of each step, so they cost a row for each knot and date, not for each day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.functions.scalar import index_of, logit, rating_of, theta_of

Z90, Z05 = 1.2816, 1.6449
SATURATION = 0.95


def line(models: DataFrame, provisional: bool = False, tiers: tuple[str, ...] = ("flagship",)) -> DataFrame:
    """Knots (asof, date, release_id, lab, index, theta) of the strict running maximum in the order of date, then release_id."""
    kept = models.where(F.col("tier").isin(*tiers) & (F.lit(provisional) | F.col("qualified")))
    days = kept.groupBy("asof", "date").agg(F.max("index").alias("top"))
    before = Window.partitionBy("asof").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    days = days.select("asof", "date", F.coalesce(F.max("top").over(before), F.lit(float("-inf"))).alias("before")).where("before < double('infinity')")
    above = kept.join(days, ["asof", "date"]).where("index > before")
    earlier = Window.partitionBy("asof", "date").orderBy("release_id").rowsBetween(Window.unboundedPreceding, -1)
    same_day = F.coalesce(F.max("index").over(earlier), F.lit(float("-inf")))
    return above.withColumn("same_day", same_day).where("index > same_day").select("asof", "date", "release_id", "lab", "index", theta_of("index").alias("theta"))


def stripes(knots: DataFrame) -> DataFrame:
    """Each knot's reign: from its date up to that of the next."""
    return knots.select("asof", F.col("date").alias("start"), F.lead("date").over(Window.partitionBy("asof").orderBy("date", "release_id")).alias("end"), "release_id", "lab")


def step_regression(knots: DataFrame, grid: DataFrame, value: str, window: int = 365) -> DataFrame:
    """Least squares, by asof, of the daily sampled step function over the ``window`` days up to each date of ``grid`` (at; with asof: those of each asof).

    steps: knots within the window; dates: days with a knot; n: days sampled; x is the day minus start_day. Dates with fewer than two samples are left out.
    """
    by_day = knots.groupBy("asof", F.unix_date("date").alias("day")).agg(F.max(value).alias("y"), F.count("*").alias("knots"))
    of = Window.partitionBy("asof")
    spans = by_day.withColumn("last", F.coalesce(F.lead("day").over(of.orderBy("day")) - 1, F.lit(2**30))).withColumn("first", F.min("day").over(of))  # days with a knot
    ends = grid.select(*[c for c in ("asof",) if c in grid.columns], "at", F.unix_date("at").alias("stop"))
    within = (F.col("day") <= F.col("stop")) & (F.col("last") >= F.col("stop") - window)
    both = spans.join(ends, "asof").where(within) if "asof" in grid.columns else spans.join(ends, within)
    start = F.greatest(F.col("stop") - window, F.col("first"))
    cut = both.withColumn("start_day", start).withColumn("a", F.greatest("day", "start_day") - F.col("start_day")).withColumn("b", F.least("last", "stop") - F.col("start_day"))
    a, b, y = F.col("a").cast("double"), F.col("b").cast("double"), F.col("y")
    squares = lambda t: t * (t + 1) * (2 * t + 1) / 6
    n, sx, sxx = b - a + 1, (a + b) * (b - a + 1) / 2, squares(b) - squares(a - 1)
    inside = F.col("day") >= F.col("stop") - window
    sums = cut.groupBy("asof", "at", "stop", "start_day").agg(
        F.sum(F.when(inside, F.col("knots")).otherwise(0)).alias("steps"), F.count_if(inside).alias("dates"), F.sum(n).alias("n"),
        F.sum(sx).alias("sx"), F.sum(sxx).alias("sxx"), F.sum(y * n).alias("sy"), F.sum(y * sx).alias("sxy"), F.sum(y * y * n).alias("syy"),
    )
    c = F.col
    centred = sums.where("n >= 2").withColumns({"cxx": c("sxx") - c("sx") ** 2 / c("n"), "cxy": c("sxy") - c("sx") * c("sy") / c("n"), "cyy": c("syy") - c("sy") ** 2 / c("n")})
    slope = c("cxy") / c("cxx")
    sse = F.greatest(F.lit(0.0), c("cyy") - c("cxy") ** 2 / c("cxx"))
    return centred.where("cxx > 0").select("asof", "at", "stop", "start_day", "steps", "dates", c("n").cast("long").alias("n"), slope.alias("slope"), (c("sy") / c("n") - slope * c("sx") / c("n") - slope * c("start_day")).alias("intercept"), sse.alias("sse"), "cxx")


def pace(knots: DataFrame, grid: DataFrame, window: int = 365) -> DataFrame:
    """at, logits_per_year, doubling_days and steps, where two knots or more fall in the window."""
    found = step_regression(knots, grid, "theta", window).where("steps >= 2")
    return found.select("asof", "at", (F.col("slope") * 365).alias("logits_per_year"), F.when(F.col("slope") > 0, math.log(2) / F.col("slope")).alias("doubling_days"), "steps")


def velocity(knots: DataFrame, grid: DataFrame, window: int = 365) -> DataFrame:
    """at and percentage points per 30 days, where knots of two days or more fall in the window."""
    return step_regression(knots, grid, "index", window).where("dates >= 2").select("asof", "at", (F.col("slope") * 30).alias("per_month"))


def trend(knots: DataFrame, grid: DataFrame, window: int = 365) -> DataFrame:
    found = step_regression(knots, grid, "theta", window).where("steps >= 2")
    sigma = F.sqrt(F.try_divide(F.col("sse"), F.col("n") - 2))
    return found.select("asof", "at", "stop", "slope", "intercept", sigma.alias("sigma"), (sigma / F.sqrt("cxx")).alias("slope_se"), "n")


def gains(knots: DataFrame, to: Column, months: int = 3) -> DataFrame:
    """By asof: start, end, gain in logits and steps of each calendar period from the first knot's on."""
    first = knots.groupBy("asof").agg(F.min("date").alias("first"), F.min_by("theta", F.struct("date", "release_id")).alias("theta_0"))
    year = F.trunc("first", "year")
    start = F.add_months(year, (F.floor((F.month("first") - 1) / months) * months).cast("int"))
    periods = first.where(F.col("first") <= to).select("asof", "theta_0", F.explode(F.sequence(start, to, F.expr(f"interval {months} months"))).alias("start"))
    periods = periods.withColumn("end", F.add_months("start", months))
    dated = knots.select("asof", "date", "theta")
    both = periods.join(dated, (periods["asof"] == dated["asof"]) & (F.col("date") < F.col("end")), "left").drop(dated["asof"])
    sums = both.groupBy("asof", "start", "end", "theta_0").agg(F.max("theta").alias("top"), F.count_if(F.col("date") >= F.col("start")).alias("steps"))
    before = F.coalesce(F.lag("top").over(Window.partitionBy("asof").orderBy("start")), F.col("theta_0"))  # one row for each period
    return sums.select("asof", "start", "end", F.greatest(F.lit(0.0), F.col("top") - before).alias("gain"), "steps")


def fan(knots: DataFrame, asof: Column, to: Column, step: int = 7, window: int = 365) -> DataFrame:
    """date, theta and its band from ``asof`` to ``to``, which is always included."""
    one = trend(knots, knots.sparkSession.range(1).select(asof.alias("at")), window)
    days = F.array_union(F.sequence("stop", F.unix_date(to), F.lit(step)), F.array(F.unix_date(to)))
    rows = one.where(to >= asof).withColumn("day", F.explode(days))
    half = Z90 * F.sqrt(F.col("sigma") ** 2 + (F.col("slope_se") * (F.col("day") - F.col("stop"))) ** 2)
    theta = F.col("intercept") + F.col("slope") * F.col("day")
    return rows.select(F.date_from_unix_date("day").alias("date"), theta.alias("theta"), (theta - half).alias("theta_low"), (theta + half).alias("theta_high"), index_of(theta - half).alias("low"), index_of(theta).alias("mid"), index_of(theta + half).alias("high"))


def levels(deltas: DataFrame, benches: DataFrame) -> DataFrame:
    """Abilities that mean something, by asof: human baselines, saturated percentage benchmarks, generations and the ceiling of the current basket."""
    known = deltas.join(benches.where("in_index"), "benchmark")
    human = known.where("human_baseline > 0 and human_baseline < 100").select("asof", F.concat(F.lit("human:"), "benchmark").alias("level"), F.lit("human").alias("kind"), (F.col("delta") + logit(F.col("human_baseline") / 100)).alias("theta"))
    percent = known.where("unit = '%'") if "unit" in benches.columns else known  # an Elo scale has no full mark
    full = percent.withColumn("theta", F.col("delta") + math.log(SATURATION / (1 - SATURATION)))
    saturated = full.select("asof", F.concat(F.lit("sat:"), "benchmark").alias("level"), F.lit("saturation").alias("kind"), "theta")
    generation = full.groupBy("asof", "generation").agg(F.avg("theta").alias("theta")).select("asof", F.concat(F.lit("gen:"), F.col("generation").cast("string")).alias("level"), F.lit("generation").alias("kind"), "theta")
    ceiling = full.where(~F.col("legacy")).groupBy("asof").agg(F.max("theta").alias("theta")).select("asof", F.lit("ceiling").alias("level"), F.lit("ceiling").alias("kind"), "theta")
    return human.unionByName(saturated).unionByName(generation).unionByName(ceiling).withColumn("rating", rating_of("theta"))


def speculative(ceiling: DataFrame) -> DataFrame:
    """Landmarks of ten, a hundred... times the odds of the ceiling."""
    names = F.array(*[F.lit(x) for x in ("spec-10x", "spec-100x", "spec-all", "spec-singularity")])
    rungs = ceiling.where(F.col("kind") == "ceiling").select("theta", F.posexplode(names).alias("k", "level"))
    theta = F.col("theta") + (F.col("k") + 1) * math.log(10)
    return rungs.select("level", F.lit("speculative").alias("kind"), theta.alias("theta"), rating_of(theta).alias("rating"))


def crossings(knots: DataFrame, levels_: DataFrame, asof: Column, window: int = 365, years: int = 15) -> DataFrame:
    """When the frontier passed each level, or is expected to, with quantiles of the day."""
    real = levels_.where("kind <> 'speculative'").select("asof", "level", F.col("theta").alias("height"))
    line = knots.select(F.col("asof").alias("_asof"), "date", "release_id", "theta")
    passed = real.join(line, (F.col("asof") == F.col("_asof")) & (F.col("theta") >= F.col("height"))).groupBy("asof", "level").agg(F.min(F.struct("date", "release_id")).alias("first"))
    one = trend(knots, knots.sparkSession.range(1).select(asof.alias("at")), window).where("slope > 0")
    rest = real.join(passed, ["asof", "level"], "left_anti").join(one, "asof")
    gap = (F.col("height") - F.col("intercept") - F.col("slope") * F.col("stop")) / F.col("slope")
    sd = F.sqrt((gap / F.col("slope")) ** 2 * F.col("slope_se") ** 2 + (F.col("sigma") / F.col("slope")) ** 2)
    day = lambda z: F.floor(F.greatest(F.col("stop") + gap + z * sd, F.col("stop").cast("double")) + 0.5).cast("int")
    ahead = rest.where((gap > 0) & (gap <= years * 365)).select("asof", "level", F.lit("predicted").alias("kind"), F.date_from_unix_date(day(0.0)).alias("date"), F.lit(None).cast("string").alias("release_id"), *[F.date_from_unix_date(day(z)).alias(q) for q, z in (("p05", -Z05), ("p16", -1.0), ("p84", 1.0), ("p95", Z05))])
    none = F.lit(None).cast("date")
    return passed.select("asof", "level", F.lit("past").alias("kind"), "first.date", "first.release_id", *[none.alias(q) for q in ("p05", "p16", "p84", "p95")]).unionByName(ahead)


def regime(pace_: Column) -> Column:
    return F.when(pace_ < 0.5, "dormant").when(pace_ < 1.5, "climb").when(pace_ < 3, "acceleration").otherwise("takeoff")


def month_grid(knots: DataFrame, asof: Column, window: int = 365) -> DataFrame:
    """By asof, at: month starts from ``window`` days after the first knot up to ``asof``."""
    first = knots.groupBy("asof").agg(F.min("date").alias("first"))
    months = first.select("asof", "first", F.explode(F.sequence(F.add_months(F.trunc("first", "month"), 1), F.greatest(asof, F.add_months(F.trunc("first", "month"), 1)), F.expr("interval 1 month"))).alias("at"))
    return months.where((F.datediff("at", "first") >= window) & (F.col("at") <= asof)).select("asof", "at")


def eras(knots: DataFrame, asof: Column, window: int = 365) -> DataFrame:
    """By asof: runs of months of one regime: start, end (null for the last), regime, mean and greatest pace."""
    in_order = Window.partitionBy("asof").orderBy("at")  # one row for each month
    paced = pace(knots, month_grid(knots, asof, window), window).withColumn("regime", regime(F.col("logits_per_year")))
    paced = paced.withColumn("run", F.sum(F.when(F.lag("regime").over(in_order) == F.col("regime"), 0).otherwise(1)).over(in_order))
    paced = paced.withColumn("all", F.count("*").over(Window.partitionBy("asof"))).where("all >= 2")
    runs = paced.groupBy("asof", "run", "regime").agg(F.min("at").alias("start"), F.avg("logits_per_year").alias("mean_pace"), F.max("logits_per_year").alias("max_pace"), F.count("*").alias("months"))
    return runs.select("asof", "start", F.lead("start").over(Window.partitionBy("asof").orderBy("start")).alias("end"), "regime", "mean_pace", "max_pace", "months")
