"""Views of what is published: the bundle's order, headline figures, badges, orders of panels, points on lines. Each takes and gives tables keyed by release, lab or date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.operators import asof
from ability_engine.operators.frontier import regime
from ability_engine.operators.lineup import tie_groups

#: Days of a month, for ages and for doubling times; the longest doubling time that is shown; labs in the spotlight; days after the next release's late end.
MONTH_DAYS, DOUBLING_MONTH, DOUBLING_LIMIT = 365.25 / 12, 30.4375, 3650
SPOTLIGHT, NEAR_TAIL, NEAR_DEFAULT = 3, 30, 120
FAR = "9999-12-31"


def bundle_releases(releases: DataFrame, labs: DataFrame) -> DataFrame:
    """Releases in the order of the bundle: date, then that of labs (lab, lab_pos), then id; sorted by ranges."""
    ordered = releases.join(labs.select("lab", "lab_pos"), "lab", "left")
    return ordered.orderBy("date", F.coalesce("lab_pos", F.lit(0)), "release_id")


def with_place(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds the place of each row in a total order: a sort by ranges, then the rows of the ranges before are added, one number for each range."""
    numbered = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_in")).persist()
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_in") - F.col("_from") + F.col("_before") + 1).alias("place"))


def recent_changes(changes: DataFrame, most: int = 100) -> DataFrame:
    return changes.orderBy(F.desc("at"), "release_id", "kind").limit(most)


def bundle(releases: DataFrame, labs: DataFrame, benches: DataFrame, changes: DataFrame, at: str, most: int = 100, backtest: DataFrame | None = None) -> DataFrame:
    """The published document, one row of JSON: a star of releases is small by contract (hundreds of rows). backtest: one row, or none."""
    packed = lambda df, name, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct("*").alias("row")))), lambda r: r["row"]).alias(name))
    parts = packed(releases.join(labs.select("lab", "lab_pos"), "lab", "left"), "releases", [F.col("date"), F.col("lab_pos"), F.col("release_id")])
    newest = recent_changes(changes, most)
    parts = parts.crossJoin(packed(labs, "labs", [F.col("lab_pos")])).crossJoin(packed(benches, "benchmarks", [F.col("basket_pos")])).crossJoin(newest.agg(F.sort_array(F.collect_list(F.struct("at", "release_id", "kind")), asc=False).alias("recent_changes")))  # one row each
    if backtest is not None:
        parts = parts.crossJoin(backtest.select(F.struct("*").alias("backtest")))  # one row each
    last = [] if backtest is None else ["backtest"]
    return parts.select(F.to_json(F.struct(F.lit(at).alias("generated_at"), F.lit(1).alias("version"), "labs", "benchmarks", "releases", "recent_changes", *last)).alias("value"))


def source_count(releases: DataFrame) -> DataFrame:
    """release_id and the number of distinct addresses behind it. releases: release_id, announcement_url, source_urls and score_urls (arrays)."""
    urls = F.concat(F.array("announcement_url"), F.coalesce("source_urls", F.array().cast("array<string>")), F.coalesce("score_urls", F.array().cast("array<string>")))
    return releases.select("release_id", F.size(F.array_compact(F.array_distinct(urls))).alias("sources"))


def best_provisional(models: DataFrame) -> DataFrame:
    """By asof: the unqualified model of the highest index, the first by id where equal."""
    order = F.struct((-F.col("index")).alias("low"), F.col("release_id"))
    return models.where(~F.col("qualified")).groupBy("asof").agg(F.min_by(F.struct("release_id", "lab", "index", "rating", "n"), order).alias("b")).select("asof", "b.*")


def next_up(predictions: DataFrame) -> DataFrame:
    """By asof: the soonest first release (lab, p50) that isn't past; labs in order where equal. predictions: asof, lab, k, p50."""
    # A condition in the aggregate: as a filter it would be pushed into the forecast, whose expressions then multiply.
    ahead = F.when((F.col("k") == 1) & (F.col("p50") >= F.col("asof")), F.struct("p50", "lab"))
    return predictions.groupBy("asof").agg(F.min(ahead).alias("n")).where("n is not null").select("asof", "n.lab", "n.p50")


def headline(knots: DataFrame, paces: DataFrame, coming: DataFrame, provisional: DataFrame) -> DataFrame:
    """By asof: the frontier's last knot, its pace, doubling time in months (null if very long), what comes next, and the provisional model if it out-scores the knot. paces: at."""
    top = knots.groupBy("asof").agg(F.max(F.struct("date", "release_id", "index")).alias("t"), F.count("*").alias("steps"))
    months = F.when(F.col("doubling_days") < DOUBLING_LIMIT, F.col("doubling_days") / DOUBLING_MONTH)
    rows = top.join(paces.select(F.col("at").alias("asof"), "logits_per_year", months.alias("doubling_months")), "asof", "left")
    rows = rows.join(coming.select("asof", F.col("lab").alias("next_lab"), F.col("p50").alias("next_date")), "asof", "left")
    rows = rows.join(provisional.select("asof", F.col("release_id").alias("_p"), F.col("index").alias("_i")), "asof", "left")
    return rows.select("asof", F.col("t.release_id").alias("top_id"), F.col("t.index").alias("top_index"), "steps", "logits_per_year", "doubling_months", "next_lab", "next_date", F.when(F.col("_i") > F.col("t.index"), F.col("_p")).alias("provisional_id"))


def known_at(retrieved_at: Column, date: Column) -> Column:
    """Day on which a release that isn't out became known."""
    return F.coalesce(F.when(F.length(retrieved_at) >= 10, F.try_to_date(F.substring(retrieved_at, 1, 10), "yyyy-MM-dd")), date)


def age_months(date: Column, asof: Column) -> Column:
    """Whole months of age; null under one."""
    months = F.floor(F.datediff(asof, date) / MONTH_DAYS).cast("int")
    return F.when(months >= 1, months)


def score_use(scores: DataFrame, used: DataFrame, benches: DataFrame) -> DataFrame:
    """Scores with their use: used (the fit took this value of this benchmark), not used, off-index. used: release_id, benchmark, value."""
    took = used.select("release_id", "benchmark", "value").distinct().withColumn("_used", F.lit(True))
    rows = scores.join(took, ["release_id", "benchmark", "value"], "left").join(benches.select("benchmark", "in_index"), "benchmark", "left")
    use = F.when(F.col("_used"), "used").when(F.coalesce("in_index", F.lit(False)), "not used").otherwise("off-index")
    return rows.select(*scores.columns, use.alias("use"))


def ordered_scores(scores: DataFrame, benches: DataFrame) -> DataFrame:
    """Scores with their place within the release: the basket's order, those off the index last, then list order."""
    rank = F.when(F.coalesce("in_index", F.lit(False)), 0).otherwise(1000) + F.coalesce("basket_pos", F.lit(500))
    rows = scores.join(benches.select("benchmark", "in_index", "basket_pos"), "benchmark", "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("release_id").orderBy(rank, "score_pos"))).select(*scores.columns, "place")


def hit_badge(predicted: Column, actual: Column, in68: Column, in90: Column) -> Column:
    return F.when(predicted.isNull(), "no forecast").when(actual.isNull(), "no release yet").when(in68, "68").when(in90, "90").otherwise("miss")


def backtest_order(rows: DataFrame) -> DataFrame:
    """Place of each row of a replay (asof, lab, p50, actual) within its asof: by the predicted date, else the actual one, then lab."""
    day = F.coalesce(F.col("p50").cast("string"), F.col("actual").cast("string"), F.lit(FAR))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("asof").orderBy(day, "lab")))


def watch_order(labs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labs (lab, name) by asof with the place of their card: the first prediction's date, labs without one last, then name."""
    first = predictions.groupBy("asof", "lab").agg(F.min_by("p50", "k").alias("p50"))
    rows = predictions.select("asof").distinct().crossJoin(labs)  # a card for each date and lab
    order = Window.partitionBy("asof").orderBy(F.asc_nulls_last("p50"), "name", "lab")
    return rows.join(first, ["asof", "lab"], "left").withColumn("place", F.row_number().over(order))


def spotlight(forecasts: DataFrame, focus: Column | None = None) -> DataFrame:
    """(asof, lab) of the labs in the spotlight: the three of the highest p30, all where there are four at most, and the focused one."""
    by = Window.partitionBy("asof")
    rows = forecasts.withColumn("_n", F.row_number().over(by.orderBy(F.desc("p30"), "lab"))).withColumn("_all", F.count("*").over(by))
    focused = F.lit(False) if focus is None else F.coalesce(F.col("lab") == focus, F.lit(False))
    return rows.where((F.col("_all") <= SPOTLIGHT + 1) | (F.col("_n") <= SPOTLIGHT) | focused).select("asof", "lab")


def rank_groups(ranking: DataFrame) -> DataFrame:
    """Tie groups of a ranking (block, place, release_id, qualified, rating, se): ranks go on from the qualified to the provisional rows; pos and size within the group."""
    of = F.col("block").cast("string")
    ranked = tie_groups(ranking.withColumn("block", F.struct(of.alias("of"), (~F.coalesce("qualified", F.lit(False))).alias("later"))))
    first = ranking.groupBy(of.alias("of")).agg(F.count_if("qualified").alias("ahead"))
    part = ranked.join(first, F.col("block.of").eqNullSafe(F.col("of")))
    return part.select("of", "release_id", (F.col("rank") + F.when(F.col("block.later"), F.col("ahead")).otherwise(0)).cast("long").alias("rank"), "tied", "pos", "size").withColumnRenamed("of", "block")


def level_at(points: DataFrame, knots: DataFrame, value: str) -> DataFrame:
    """Points (point_id, asof, date) with the value of the last knot (asof, date, value) on or before their date, null before the first."""
    return asof.last_before(points, knots, ("asof",), "date", value)


def nearest(points: DataFrame, samples: DataFrame, value: str) -> DataFrame:
    """Points (point_id, date) with the value of the nearest sample (date, value), the earlier where equally near."""
    met, day = asof.around(points, samples, (), "date", value), F.unix_date("date")
    closer = F.when(F.col("after").isNull() | (day - F.col("before.at") <= F.col("after.at") - day), F.col("before.v")).otherwise(F.col("after.v"))
    return met.select("point_id", "date", closer.alias(value))


def density_at(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Points (lab, day) with p between the samples (lab, day, p) around them, by straight lines; 0 outside."""
    a, b = F.col("before"), F.col("after")
    t = F.coalesce(F.try_divide(F.col("day") - a["at"], b["at"] - a["at"]), F.lit(0.0))
    met = asof.around(points.select("lab", "day"), samples, ("lab",), "day", "p")
    return met.select("lab", "day", F.coalesce(a["v"] + (b["v"] - a["v"]) * t, F.lit(0.0)).alias("p"))


def slice_samples(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """The part of each lab's samples (lab, day, p) within its window (lab, low, high), with points of their own on the edges; a window without inner width has none."""
    wide = windows.where("high > low")
    inner = samples.select("lab", "day", "p").join(wide, "lab").where((F.col("day") > F.col("low")) & (F.col("day") < F.col("high"))).select("lab", "day", "p")
    edges = wide.select("lab", F.explode(F.array(F.col("low").cast("double"), F.col("high").cast("double"))).alias("day"))
    return inner.unionByName(density_at(samples, edges))


def near_end(forecasts: DataFrame, hard_end: Column) -> DataFrame:
    """asof, lab and the end of its near fan: the first prediction's late end (p95) and a tail, or a default span, within ``hard_end``."""
    stop = F.coalesce(F.date_add("p95", NEAR_TAIL), F.date_add("asof", NEAR_DEFAULT))
    return forecasts.select("asof", "lab", F.least(stop, hard_end).alias("end"))


def theta_extent(values: DataFrame, low: str = "theta_low", high: str = "theta_high", step: float = 0.25) -> DataFrame:
    """lo and hi of the padded range of the values, and both rounded outwards to quarter logits; the defaults of an empty or flat table are -1 and 4."""
    ends = values.agg((F.min(low) - 0.45).alias("lo"), (F.max(high) + 0.15).alias("hi"))
    fits = F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))
    return ends.select("lo", "hi", F.when(fits, F.floor(F.col("lo") / step) * step).otherwise(-1.0).alias("nice_lo"), F.when(fits, F.ceil(F.col("hi") / step) * step).otherwise(4.0).alias("nice_hi"))


def index_extent(models: DataFrame) -> DataFrame:
    """The padded range of the models' index bands, within 0 and 100."""
    ends = models.agg(F.min("index_low").alias("a"), F.max("index_high").alias("b"))
    pad = F.greatest(F.lit(2.0), (F.col("b") - F.col("a")) * 0.12)
    return ends.select(F.coalesce(F.greatest(F.lit(0.0), F.col("a") - pad), F.lit(0.0)).alias("lo"), F.coalesce(F.least(F.lit(100.0), F.col("b") + pad), F.lit(100.0)).alias("hi"))


def projected_era(trend: DataFrame) -> DataFrame:
    """at and the regime that the trend's slope (logits a day) would be."""
    return trend.select("at", regime(F.col("slope") * 365).alias("regime"))


def stages_panel(predicted: DataFrame, eras: DataFrame, past: DataFrame) -> DataFrame:
    """Rows of a panel with their place: what is predicted, eras, what is past; the latest first. predicted and past: name, date; eras: regime, start."""
    part = lambda df, section, name, date: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(date).alias("date"))
    rows = part(predicted, 0, "name", "date").unionByName(part(eras, 1, "regime", "start")).unionByName(part(past, 2, "name", "date"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("date"), "name")))


def marker_level(markers: DataFrame, announced: DataFrame, predictions: DataFrame, qualified: DataFrame, knots: DataFrame) -> DataFrame:
    """Markers (release_id, lab, asof, date) with an indicative index: that of its own announced prediction, of its lab's next one for a date ahead, of the lab's last
    qualified model up to the date, of its last one, of the frontier up to the date, of the frontier's end; else 50.

    announced: release_id, index; predictions: lab, index; qualified: lab, date, release_id, index; knots: asof, date, index.
    """
    own = announced.select("release_id", F.col("index").alias("_own"))
    coming = predictions.select("lab", F.col("index").alias("_next"))
    days = qualified.groupBy("lab", "date").agg(F.max_by("index", "release_id").alias("_before"))
    rows = asof.last_before(markers, days, ("lab",), "date", "_before")
    rows = asof.last_before(rows, knots.select("asof", "date", F.col("index").alias("_front")), ("asof",), "date", "_front")
    newest = qualified.groupBy("lab").agg(F.max_by("index", F.struct("date", "release_id")).alias("_last"))
    end = knots.groupBy("asof").agg(F.max_by("index", "date").alias("_end"))
    rows = rows.join(own, "release_id", "left").join(coming, "lab", "left").join(newest, "lab", "left").join(end, "asof", "left")
    level = F.coalesce("_own", F.when(F.col("date") > F.col("asof"), F.col("_next")), "_before", "_last", "_front", "_end", F.lit(50.0))
    return rows.select(*markers.columns, level.alias("level"))
