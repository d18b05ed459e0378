"""Matching found rows with known ones: scores within a tolerance, and names by a cascade of keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerances of a score by unit.
TOLERANCE = {"%": 1.0, "elo": 15.0}


def match_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Found scores with the first gold score (by score_pos) of their release and benchmark: delta, and whether it is within the tolerance.

    Both: release_id, benchmark, score_pos, value; found also unit. Found scores without a gold one are left out.
    """
    first = gold.groupBy("release_id", "benchmark").agg(F.min_by("value", "score_pos").alias("gold_value"))
    both = found.join(first.hint("merge"), ["release_id", "benchmark"])
    delta = F.abs(F.col("gold_value") - F.col("value"))
    tolerance = F.when(F.col("unit") == "elo", TOLERANCE["elo"]).otherwise(TOLERANCE["%"])
    return both.select("release_id", "benchmark", "score_pos", "value", "gold_value", delta.alias("delta"), (delta <= tolerance).alias("matched"))


def match_names(rows: DataFrame, known: DataFrame, stages: Sequence[tuple[Column, Column]]) -> DataFrame:
    """The known row of each row by the earliest stage at which their keys agree, the first by known_pos at that stage.

    ``rows``: row_id and what the stages read; ``known``: known_id, known_pos. A stage is (key of rows, key of known); null keys match
    nothing. Known keys are reduced to one row first, so a common key can't multiply rows: one equi-join for all stages.
    """
    staged = lambda k, key: F.struct(F.lit(k).alias("stage"), key.alias("key"))
    left = rows.select("row_id", F.explode(F.array(*(staged(k, key) for k, (key, _) in enumerate(stages)))).alias("s")).select("row_id", "s.*").where("key is not null and key <> ''")
    right = known.select("known_id", "known_pos", F.explode(F.array(*(staged(k, key) for k, (_, key) in enumerate(stages)))).alias("s")).select("known_id", "known_pos", "s.*").where("key is not null and key <> ''")
    right = right.groupBy("stage", "key").agg(F.min_by("known_id", "known_pos").alias("known_id"))
    return left.join(right, ["stage", "key"]).groupBy("row_id").agg(F.min_by("known_id", "stage").alias("known_id"), F.min("stage").alias("stage"))


def one_row_each(matched: DataFrame) -> DataFrame:
    """One row for each known one: the best ranked plain row, or else the best ranked. matched: known_id, row_id, rank, plain."""
    best = F.struct((~F.col("plain")).alias("spelled"), "rank", "row_id")
    return matched.groupBy("known_id").agg(F.min(best).alias("b")).select("known_id", "b.row_id", "b.rank", (~F.col("b.spelled")).alias("plain"))


#: Fixed value: the first signs of a key that are looked up before the whole of it.
HEAD = 4


def held_keys(texts: DataFrame, keys: DataFrame, by: Sequence[str], text: str, key: str, fits: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of ``texts`` with each ``key`` of ``keys`` that has the same ``by`` and is a part of their ``text``; with its text after the key, ``fits`` may refuse a place.

    Places of a text are looked up by their first signs for the lengths of keys that begin so, and only parts of these lengths meet keys, by an equi-join.
    So rows grow with the texts' lengths and with what is found, not with pairs. A key found at several places gives one row. Nulls and empty keys meet nothing.
    """
    whole = keys.select(*by, key).where(F.col(key) != "").distinct()
    heads = whole.groupBy(*by, F.substring(key, 1, HEAD).alias("_head")).agg(F.collect_set(F.length(key)).alias("_lengths"))
    widths = heads.agg(F.array_sort(F.collect_set(F.length("_head"))).alias("_widths"))  # at most HEAD numbers
    size, at = F.length(text), F.col("_at")
    starts = F.transform(F.sequence(F.lit(1), size), lambda k: F.transform(F.col("_widths"), lambda n: F.struct(k.alias("at"), F.substr(text, k, n).alias("head"))))
    placed = texts.where(size > 0).crossJoin(F.broadcast(widths)).withColumn("_s", F.explode(F.flatten(starts)))  # one row
    placed = placed.select(*texts.columns, F.col("_s.at").alias("_at"), F.col("_s.head").alias("_head"))
    long = placed.join(heads, [*by, "_head"]).withColumn("_n", F.explode("_lengths")).where((F.col("_n") >= F.length("_head")) & (at + F.col("_n") <= size + 1))
    if fits is not None:
        long = long.where(fits(F.substr(text, at + F.col("_n"))))
    parts = long.select(*texts.columns, F.substr(text, at, F.col("_n")).alias(key))
    return parts.join(whole.hint("merge"), [*by, key], "left_semi").select(*texts.columns, key).distinct()
