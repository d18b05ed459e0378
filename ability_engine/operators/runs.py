"""Whole runs, put together from the operators: verification of quotes, a poll of sources, discovery, and a leaderboard's update. Pages and answers come as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.functions.text import quote_matches
from ability_engine.operators import leaderboard, merge, screening, state


def verify(refs: DataFrame, pages: DataFrame, only_unverified: bool = False, compose: bool = True, match: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Sources (release_id, place, url, quote, verified) with ``status``: verified, quote not found on page, page not read, no quote; skipped if it was verified before and
    only others are wanted. pages: url, text. ``match`` (page, quote) is ``quote_matches``, with all its tolerances, unless given. A page of many sources is joined on its address; its text is not copied where there is no quote."""
    missing = F.coalesce(F.trim("quote"), F.lit("")) == ""
    skip = F.lit(only_unverified) & F.coalesce("verified", F.lit(False))
    asked = refs.where(~missing & ~skip).join(pages.select("url", F.col("text").alias("_text")), "url", "left")
    held = match(F.col("_text"), F.col("quote")) if match else quote_matches(F.col("_text"), F.col("quote"), compose)
    status = F.when(F.col("_text").isNull(), "page not read").when(held, "verified").otherwise("quote not found on page")
    rest = refs.where(missing | skip).withColumn("status", F.when(missing, "no quote").otherwise("skipped"))
    return asked.withColumn("status", status).select(*refs.columns, "status").unionByName(rest.select(*refs.columns, "status"))


def verify_counters(verified: DataFrame) -> DataFrame:
    """By release_id: checked, ok, failed and sources without a quote."""
    status = F.col("status")
    return verified.groupBy("release_id").agg(F.count_if(~status.isin("no quote", "skipped")).alias("checked"), F.count_if(status == "verified").alias("ok"), F.count_if(status.isin("page not read", "quote not found on page")).alias("failed"), F.count_if(status == "no quote").alias("no_quote"))


def poll(items: DataFrame, hashes: DataFrame, old: DataFrame, hints: DataFrame, now: Column, budget: int, compose: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next state, candidates to extract, counters) of a poll.

    items: source, lab, pos, key, title, link; hashes: source, hash; old: the state (see ``state.diff_sources``). Sources that are new only set their state.
    """
    keys = items.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))
    after, new = state.diff_sources(old, hashes.join(keys, "source", "left"), now)
    fresh = items.join(new.select("source", "key").distinct(), ["source", "key"], "left_semi")
    ranked = screening.rank_candidates(screening.candidates(fresh, hints, compose))
    counters = hashes.agg(F.count("*").alias("polled")).crossJoin(new.agg(F.count_distinct("source").alias("changed"), F.count("*").alias("new_items"))).crossJoin(ranked.agg(F.count("*").alias("candidates")))  # one row each
    return after, state.within_budget(ranked, budget, "place", "lab", "source"), counters


def discover(found: DataFrame, hosts: DataFrame, done: DataFrame, failed: DataFrame, known: DataFrame, today: Column, incremental: bool = True) -> DataFrame:
    """Found models that pass the host filter, with what a plan does with them, and how they may be extracted: those of the press as rumours without scores."""
    kept = screening.plan_status(screening.screen(found, hosts), done, failed, known, today, incremental)
    return kept.withColumns({"force_status": F.when(~F.col("official"), "rumored"), "drop_scores": ~F.col("official")})


def update_leaderboard(pages: DataFrame, releases: DataFrame, labs: DataFrame, published: DataFrame, benchmark: str) -> DataFrame:
    """The published scores (release_id, benchmark, value) after the page's ratings are put in: value, old and action.

    pages: page_id, text (a table, or lines of a flattened one); releases: known_id, known_pos, name, lab; labs: lab, names (array). A row whose organisation
    isn't the release's lab is left out.
    """
    flat = leaderboard.flattened_rows(pages).withColumn("_form", F.lit(0))
    both = flat.unionByName(leaderboard.table_rows(pages).select("page_id", "rank", "model", "score").withColumn("_form", F.lit(1)))
    # A page with lines of a flattened table has no other; its rows are few.
    rows = both.withColumn("_own", F.min("_form").over(Window.partitionBy("page_id"))).where("_form = _own").drop("_form", "_own")
    named = rows.withColumn("row_id", F.concat_ws("|", "page_id", leaderboard.name_key(F.col("model"))))
    best = leaderboard.best_rows(named, releases.select("known_id", "known_pos", "name")).join(named.select("row_id", "model", "score"), "row_id")
    labelled = best.join(releases.select("known_id", "lab"), "known_id").join(labs, "lab", "left")
    organisation = F.nullif(F.regexp_extract("model", r"^([A-Za-z. ]+):", 1), F.lit(""))
    fits = labelled.where(leaderboard.organisation_fits(organisation, F.coalesce("names", F.array().cast("array<string>"))))
    return merge.replace_scores(published, fits.select(F.col("known_id").alias("release_id"), F.lit(benchmark).alias("benchmark"), F.col("score").alias("value")))
