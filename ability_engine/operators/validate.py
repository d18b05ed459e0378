"""Checks of the data and of extractions, as tables of issues: one projection or join for each rule, put together by union.

An issue is (tab, row, rule, severity). ``extraction`` gives each row of a response the first rule that it breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.functions.text import quote_matches
from ability_engine.operators.ingest import quote_contains_value, valid_release_id

#: Kinds that the data may have, and the longest quote.
STATUSES = ("released", "announced", "rumored", "cancelled")
TIERS = ("flagship", "mid", "small")
PRECISIONS = ("day", "month", "quarter", "year", "unknown")
REPORTERS = ("official", "maintainer")
CHANGE_KINDS = ("release_added", "release_updated", "score_added", "score_updated", "status_changed", "verified")
ACTORS = ("seed", "worker", "manual")
MAX_QUOTE = 300
MAX_VALUE = 4000


def _issues(df: DataFrame, tab: str, row: Column, rules: dict[str, Column], severity: str = "error") -> DataFrame:
    """The rules that rows break; a rule that is null for a row isn't broken."""
    broken = F.array_compact(F.array(*[F.when(when, F.lit(rule)) for rule, when in rules.items()]))
    return df.select(F.lit(tab).alias("tab"), row.cast("string").alias("row"), F.explode(broken).alias("rule"), F.lit(severity).alias("severity"))


def _among(column: str, values: tuple[str, ...]) -> Column:
    """The column is missing or none of the values."""
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def _missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _repeated(df: DataFrame, tab: str, key: list[str], rule: str, row: Column | None = None) -> DataFrame:
    found = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(tab).alias("tab"), (F.concat_ws("|", *key) if row is None else row).alias("row"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"))


def _orphans(df: DataFrame, tab: str, row: Column, column: str, known: DataFrame, key: str, rule: str, severity: str = "error") -> DataFrame:
    lost = df.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return lost.select(F.lit(tab).alias("tab"), row.cast("string").alias("row"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def check_labs(labs: DataFrame) -> DataFrame:
    """labs: id, name, color, website, n_sources."""
    rules = {"name missing": _missing("name"), "color is no #rrggbb": ~F.col("color").rlike("^#[0-9a-fA-F]{6}$"), "website is no address": ~F.col("website").rlike("^https?://[^/]+"), "no sources": F.col("n_sources") < 1}
    return all_of(_issues(labs, "labs", F.col("id"), rules), _repeated(labs, "labs", ["id"], "duplicate lab id"))


def check_benchmarks(benches: DataFrame) -> DataFrame:
    """benches: id, unit, min, max, elo_reference, weight, generation, introduced."""
    percent = F.col("unit") == "%"
    rules = {
        "id is no slug": ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "unknown unit": _among("unit", ("%", "elo")), "elo benchmarks need elo_reference": (F.col("unit") == "elo") & F.col("elo_reference").isNull(),
        "percentage benchmarks are 0-100": percent & ((F.col("min") != 0) | (F.col("max") != 100)), "max must exceed min": ~(F.col("max") > F.col("min")), "weight isn't positive": ~(F.col("weight") > 0),
        "generation below 1": F.col("generation") < 1, "introduced out of range": ~F.col("introduced").between(2016, 2030),
    }
    return all_of(_issues(benches, "benchmarks", F.col("id"), rules), _repeated(benches, "benchmarks", ["id"], "duplicate benchmark id"))


def check_releases(releases: DataFrame, labs: DataFrame, today: Column) -> DataFrame:
    """releases: file (the lab of its file), lab, id, name, date (ISO), date_precision, status, tier, window_start, window_end, quote, n_scores."""
    day = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    out = F.col("status") == "released"
    errors = {
        "id is no slug": ~valid_release_id(F.col("id")), "name missing": _missing("name"), "date is no day": F.col("date").isNull() | ~day, "unknown status": _among("status", STATUSES),
        "unknown precision": _among("date_precision", PRECISIONS), "unknown tier": F.col("tier").isNotNull() & ~F.col("tier").isin(*TIERS), "lab isn't that of the file": F.col("lab") != F.col("file"),
        "id must start with the lab": ~F.col("id").startswith(F.concat("file", F.lit("-"))), "released models need a known date": out & (F.col("date_precision") == "unknown"),
        "released in the future": out & (F.col("date") > today.cast("string")), "window starts after its end": F.col("window_start") > F.col("window_end"), "quote too long": F.length("quote") > MAX_QUOTE,
    }
    warnings = {"released model with no scores": out & (F.coalesce("n_scores", F.lit(0)) == 0), "announcement has no quote": _missing("quote")}
    across = releases.groupBy("id").agg(F.count_distinct("file").alias("files")).where("files > 1")
    return all_of(
        _issues(releases, "releases", F.col("id"), errors), _issues(releases, "releases", F.col("id"), warnings, "warning"), _orphans(releases, "releases", F.col("id"), "file", labs, "id", "unknown lab"),
        _repeated(releases, "releases", ["file", "id"], "duplicate id", F.col("id")), across.select(F.lit("releases").alias("tab"), F.col("id").alias("row"), F.lit("id defined in several files").alias("rule"), F.lit("error").alias("severity")),
    )


def unknown_benchmarks(scores: DataFrame, benches: DataFrame) -> DataFrame:
    """Distinct benchmark ids of scores that no benchmark has."""
    return scores.join(benches.select(F.col("id").alias("benchmark")), "benchmark", "left_anti").select("benchmark").distinct()


def out_of_range(scores: DataFrame, benches: DataFrame) -> DataFrame:
    """Scores outside their benchmark's range."""
    ranges = benches.select(F.col("id").alias("benchmark"), F.col("min").alias("_min"), F.col("max").alias("_max"))
    return scores.join(ranges, "benchmark").where(~F.col("value").between(F.col("_min"), F.col("_max"))).select(*scores.columns)


def check_scores(scores: DataFrame, benches: DataFrame) -> DataFrame:
    """scores: release_id, benchmark, value, config, reported_by, quote."""
    row = F.concat_ws(" ", "release_id", "benchmark")
    errors = {"value out of all ranges": ~F.col("value").between(0, MAX_VALUE), "unknown reporter": _among("reported_by", REPORTERS)}
    warnings = {"score without quote": _missing("quote"), "quote does not contain the value": ~_missing("quote") & ~quote_contains_value(F.col("quote"), F.col("value"))}
    wide = out_of_range(scores, benches).select(F.lit("scores").alias("tab"), row.alias("row"), F.lit("value outside the benchmark range").alias("rule"), F.lit("error").alias("severity"))
    keyed = scores.withColumn("config", F.coalesce("config", F.lit("")))
    return all_of(_issues(scores, "scores", row, errors), _issues(scores, "scores", row, warnings, "warning"), _orphans(scores, "scores", row, "benchmark", benches, "id", "unknown benchmark"), wide, _repeated(keyed, "scores", ["release_id", "benchmark", "config"], "duplicate score", F.concat_ws(" ", "release_id", "benchmark")))


def check_changes(changes: DataFrame, labs: DataFrame, releases: DataFrame) -> DataFrame:
    """changes: line, at, actor, lab, release_id, kind."""
    rules = {"at is no UTC time": F.col("at").isNull() | ~F.col("at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), "unknown actor": _among("actor", ACTORS), "unknown kind": _among("kind", CHANGE_KINDS)}
    return all_of(_issues(changes, "changes", F.col("line"), rules), _orphans(changes, "changes", F.col("line"), "lab", labs, "id", "unknown lab"), _orphans(changes, "changes", F.col("line"), "release_id", releases, "id", "release not found", "warning"))


def counters(releases: DataFrame, scores: DataFrame, sources: DataFrame, index: DataFrame) -> DataFrame:
    """One row: files, releases, scores, those of the index (benchmark), quoted scores, sources and verified ones."""
    one = scores.join(index.select("benchmark").distinct().withColumn("_in", F.lit(1)), "benchmark", "left").agg(F.count("*").alias("scores"), F.count("_in").alias("index_scores"), F.count_if(~_missing("quote")).alias("quoted_scores"))
    two = releases.agg(F.count_distinct("file").alias("files"), F.count("*").alias("releases"))
    three = sources.agg(F.count("*").alias("sources"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_sources"))
    return two.crossJoin(one).crossJoin(three)  # one row each


def _with_held(rows: DataFrame, pages: DataFrame, compose: bool) -> DataFrame:
    """``rows`` (page_id, quote) with ``_held``: the page has the quote. Each quote of a page is looked for once, by tasks of their own, however many rows repeat it."""
    own = rows.withColumn("_quote", F.trim(F.coalesce("quote", F.lit(""))))
    asked = own.where((F.col("_quote") != "") & (F.length("_quote") <= MAX_QUOTE)).select("page_id", "_quote").distinct()
    held = asked.join(pages.select("page_id", F.col("text").alias("_text")), "page_id").where(quote_matches(F.col("_text"), F.col("_quote"), compose))
    found = held.select("page_id", "_quote").distinct().withColumn("_held", F.lit(True))
    return own.join(found.hint("merge"), ["page_id", "_quote"], "left").drop("_quote").withColumn("_held", F.coalesce("_held", F.lit(False)))


def extraction(releases: DataFrame, scores: DataFrame, pages: DataFrame, benches: DataFrame, today: Column, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """(releases, scores) of responses with the reason why each is dropped, null for those kept.

    releases: page_id, pos, name, quote, status, date (resolved, or null); scores: page_id, pos, score_pos, benchmark, value, config, quote; pages:
    page_id, text; benches: id, min, max, community. A name is a duplicate only after one that was kept; so is a score.
    """
    quote = F.trim(F.coalesce("quote", F.lit("")))
    seen = _with_held(releases, pages, compose)
    own = (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name")
        .when(F.length(quote) > MAX_QUOTE, "announcement quote too long")
        .when(~F.col("_held"), "announcement quote not found on page")
        .when(F.col("date").isNull(), "no usable date")
        .when((F.col("status") == "released") & (F.col("date") > today.cast("string")), "released date is in the future")
    )
    judged = seen.withColumn("_own", own)
    same = Window.partitionBy("page_id", F.lower(F.trim("name")))
    first = F.min(F.when(F.col("_own").isNull(), F.col("pos"))).over(same)
    reason = F.when(F.col("_own") == "empty name", F.col("_own")).when(F.col("pos") > first, "duplicate in response").otherwise(F.col("_own"))
    out = judged.withColumn("reason", reason).select(*releases.columns, "reason")

    # By size of file either side may look small enough to be broadcast, whatever its rows: so this join is a merge. The basket is small by contract.
    kept = out.where("reason is null").select("page_id", "pos")
    basket = benches.select(F.col("id").alias("benchmark"), F.col("min").alias("_min"), F.col("max").alias("_max"), F.coalesce("community", F.lit(False)).alias("_community"))
    theirs = scores.withColumn("benchmark", F.trim("benchmark")).join(kept.hint("merge"), ["page_id", "pos"]).join(F.broadcast(basket), "benchmark", "left")
    rows = _with_held(theirs, pages, compose)
    value = F.col("value")
    broken = (
        F.when(F.col("_min").isNull(), "benchmark not in basket")
        .when(F.col("_community"), "community benchmark: maintainer only")
        .when(~F.coalesce(value.between(F.col("_min"), F.col("_max")) & ~F.isnan(value), F.lit(False)), "value out of range")
        .when(F.length(quote) > MAX_QUOTE, "quote too long")
        .when(~F.col("_held"), "quote not found on page")
        .when(~quote_contains_value(quote, value), "quote does not contain the value")
    )
    checked = rows.withColumn("_broken", broken)
    key = Window.partitionBy("page_id", "pos", "benchmark", F.trim(F.coalesce("config", F.lit(""))))
    earlier = F.min(F.when(F.col("_broken").isNull(), F.col("score_pos"))).over(key)
    again = F.when(F.col("_broken").isNull() & (F.col("score_pos") > earlier), "duplicate benchmark and config in response").otherwise(F.col("_broken"))
    return out, checked.withColumn("reason", again).select(*scores.columns, "reason")
