"""State that polls and runs carry: what sources showed, what runs cost and did, and what is due. States are tables keyed by source or run; a new state is a join of the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a source that are remembered, steps of a summary in their order, what joins its segments, hours after which a success is late.
MAX_SEEN = 1200
STEPS = ("arena", "backfill", "eval")
JOINER = " · "
LAG_MINUTES = 5
RETAIN_DAYS = 14


def source_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def diff_sources(state: DataFrame, polled: DataFrame, now: Column, most: int = MAX_SEEN) -> tuple[DataFrame, DataFrame]:
    """(next state, new items). state: source, hash, checked_at, changed_at, seen (array, oldest first); polled: source, hash, keys (array, in page order).

    The first sight of a source gives no new items, only its state. Sources that weren't polled keep their state. ``seen`` keeps its newest ``most`` keys.
    """
    empty = F.array().cast("array<string>")
    old = state.select("source", F.col("hash").alias("_hash"), F.col("checked_at").alias("_checked"), F.col("changed_at").alias("_changed"), F.col("seen").alias("_seen"))
    rows = old.join(polled, "source", "full_outer")
    was, came = F.col("_hash").isNotNull(), F.col("hash").isNotNull()
    new = F.array_except(F.coalesce("keys", empty), F.coalesce("_seen", empty))
    changed = came & ~F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    rows = rows.withColumns({"_new": F.when(came, new).otherwise(empty), "_moved": changed})
    merged = F.concat(F.coalesce("_seen", empty), "_new")
    kept = F.slice(merged, F.greatest(F.lit(1), F.size(merged) - most + 1), F.lit(most))
    after = rows.select("source", F.coalesce("hash", "_hash").alias("hash"), F.when(came, now).otherwise(F.col("_checked")).alias("checked_at"), F.when(F.col("_moved"), now).otherwise(F.col("_changed")).alias("changed_at"), F.when(F.size(merged) > 0, kept).otherwise(empty).alias("seen"))
    items = rows.where(was & F.col("_moved")).select("source", F.posexplode("_new").alias("pos", "key"))
    return after, items


def within_budget(items: DataFrame, budget: int, *order: Column | str) -> DataFrame:
    """The first ``budget`` items in the given order: what one run may spend. Spark keeps only that many rows of each task before the last step."""
    return items.orderBy(*order).limit(budget)


def resume(work: DataFrame, progress: DataFrame) -> DataFrame:
    """Work (lab, name) that is neither done nor failed. progress: lab, name, state."""
    return work.withColumn("_low", F.lower("name")).join(progress.select("lab", F.lower("name").alias("_low")).distinct(), ["lab", "_low"], "left_anti").drop("_low")


def usage_totals(runs: DataFrame, by: str) -> DataFrame:
    """Calls, tokens in and out, and USD to six digits, over the runs of each ``by``."""
    return runs.groupBy(by).agg(F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 6).alias("usd"))


def usage_deltas(snapshots: DataFrame, by: str, order: str) -> DataFrame:
    """What each snapshot of lifetime counters adds to the one before it; the first adds itself."""
    before = Window.partitionBy(by).orderBy(order)
    delta = lambda c: F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))
    return snapshots.select(by, order, delta("calls").alias("calls"), delta("tokens_in").alias("tokens_in"), delta("tokens_out").alias("tokens_out"), F.round(delta("usd"), 6).alias("usd"))


def estimate_usd(tokens_in: Column, tokens_out: Column, in_per_million: Column, out_per_million: Column) -> Column:
    return F.round(tokens_in / 1e6 * in_per_million + tokens_out / 1e6 * out_per_million, 6)


def month_to_date(snapshots: DataFrame) -> DataFrame:
    """day and what was spent in its month so far: the lifetime total less that at the month's first snapshot, 0 at least. snapshots: day, total; a row for each day."""
    month = Window.partitionBy(F.trunc("day", "month")).orderBy("day")  # the days of a month
    return snapshots.select("day", F.greatest(F.lit(0.0), F.round(F.col("total") - F.first("total").over(month), 6)).alias("spent"))


def merge_summary(previous: Column, line: Column) -> Column:
    """The summary with the segment of the line's step replaced; a backfill drops the evaluation's; a line of no known step stands alone.

    A piece that names no step goes on the segment before it.
    """
    steps = F.array(*[F.lit(s) for s in STEPS])
    step_of = lambda piece: F.get(F.filter(steps, lambda s: F.startswith(piece, F.concat(s, F.lit(":")))), 0)
    kind = "struct<step:string,text:string>"
    start = F.struct(F.lit(None).cast("string").alias("step"), F.array().cast(f"array<{kind}>").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        step = F.coalesce(step_of(piece), acc["step"])
        return F.struct(step.alias("step"), F.when(step.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(step.alias("step"), piece.alias("text"))))).alias("out"))

    pieces = F.aggregate(F.split(F.coalesce(previous, F.lit("")), JOINER), start, add)["out"]
    # The last segment of a step is the one that counts: pieces from its own beginning on.
    mine = step_of(line)
    latest = lambda s: F.filter(pieces, lambda p: p["step"] == s)
    begins = lambda s: F.greatest(F.array_size(latest(s)) - F.array_position(F.reverse(F.transform(latest(s), lambda p: F.startswith(p["text"], F.concat(s, F.lit(":"))))), F.lit(True)) + 1, F.lit(1))
    text = lambda s: F.when(F.array_size(latest(s)) > 0, F.array_join(F.transform(F.slice(latest(s), begins(s).cast("int"), F.array_size(latest(s))), lambda p: p["text"]), JOINER))
    segments = F.array(*[F.when(mine == s, line).when((mine == "backfill") & F.lit(s == "eval"), F.lit(None)).otherwise(text(F.lit(s))) for s in STEPS])
    return F.when(mine.isNull(), line).otherwise(F.array_join(F.array_compact(segments), JOINER))


def llm_status(status: Column, last_run: Column, last_success: Column, calls: Column) -> Column:
    """Label of the worker's state, decided in this order; times are timestamps."""
    lag = F.unix_timestamp(last_run) - F.unix_timestamp(last_success)
    return (
        F.when(status == "running", "run in progress")
        .when(last_run.isNull(), "not run yet")
        .when(last_success.isNull() | (lag > 60 * LAG_MINUTES), "last run failed")
        .when(F.coalesce(calls, F.lit(0)) > 0, "LLM OK")
        .otherwise("no calls yet")
    )


def schedule(next_research: Column, research_hours: Column, last_research: Column, next_run: Column, run_minutes: Column, last_run: Column) -> Column:
    """Struct of kind, next and start of the wait that is shown: research if it has a time, else the check; null without either. Times are seconds."""
    long = F.greatest(F.lit(1), research_hours) * 3600
    short = F.greatest(F.lit(1), run_minutes) * 60
    made = lambda kind, at, start: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("next"), start.cast("long").alias("start"))
    return F.when(next_research.isNotNull(), made("research", next_research, F.coalesce(last_research, next_research - long))).when(next_run.isNotNull(), made("check", next_run, F.coalesce(last_run, next_run - short)))


def worker_state(run: DataFrame) -> DataFrame:
    """What of the run state is published: all but the traffic and the time of the last discovery."""
    return run.drop("traffic", "last_discover_at")


def retained(days: DataFrame, asof: Column, keep: int = RETAIN_DAYS) -> DataFrame:
    """The newest ``keep`` closed days (day, ...) before ``asof``; one row for each day."""
    closed = days.where(F.col("day") < asof)
    return closed.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("_n") <= keep).drop("_n")  # a row for each day


def run_summary(events: DataFrame, by: str) -> DataFrame:
    """Counters of a run's events (by, kind) and their line of text."""
    sums = events.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("polled", "changed", "added", "failed")])
    return sums.withColumn("line", F.format_string("poll: %d polled, %d changed, %d added, %d failed", "polled", "changed", "added", "failed"))
