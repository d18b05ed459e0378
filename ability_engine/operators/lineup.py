"""Views of what is current: latest releases, rankings with ties, lineup bands, benchmark lifetimes, comparability.

Bands and ribbons are first reduced to one row for each lab, date (and tier), so a lab with most of the releases costs no more than its days.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.functions.scalar import RATING_STEP


def released(releases: DataFrame, asof: Column, statuses: tuple[str, ...] = ("released",)) -> DataFrame:
    return releases.where(F.col("status").isin(*statuses) & (F.col("date") <= asof)).withColumn("tier", F.coalesce("tier", F.lit("flagship")))


def latest_per_lab(releases: DataFrame, asof: Column, tiers: tuple[str, ...] = ("flagship",)) -> DataFrame:
    top = F.max(F.struct("date", "release_id")).alias("top")
    return released(releases, asof).where(F.col("tier").isin(*tiers)).groupBy("lab").agg(top).select("lab", "top.release_id", "top.date")


def current_ranking(releases: DataFrame, models: DataFrame, asof: Column) -> DataFrame:
    """The latest flagships that are fitted: qualified ones first, then by index and id. One row for each lab."""
    both = latest_per_lab(releases, asof).select("release_id").join(models, "release_id")
    order = Window.orderBy(F.desc("qualified"), F.desc("index"), "release_id")  # one row for each lab
    return both.withColumn("place", F.row_number().over(order))


def rank_ties(ranking: DataFrame, z: float = 1.0) -> DataFrame:
    """rank of each row of ``ranking`` (block, place, release_id, rating, se): rows tie with the leader while their upper margin reaches its lower one."""
    return tie_groups(ranking, z).select("block", "release_id", "rank", "tied")


def tie_groups(ranking: DataFrame, z: float = 1.0) -> DataFrame:
    """``rank_ties`` with the pos of each row in its group and the group's size.

    A block is walked in the order of place, cut into sorted partitions. Where a walk begins depends on the leader that the partition before ends with, so
    partitions are walked side by side with a leader taken for granted, and again until each begins with the one that the walk before it ends with. The first
    round gives each partition's last leader for every lower margin that it may begin with, where these are few, so that is the second round unless groups
    are large; it is at most one round for each partition. A partition whose rows all reach the leader hands it on.
    """
    margin = z * RATING_STEP / 2.302585092994046 * F.col("se")
    order = ("block", "place", "release_id")
    rows = ranking.select(*order, F.to_json(F.struct("block")).alias("_key"), (F.col("rating") - margin).alias("_low"), (F.col("rating") + margin).alias("_high"))
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    offset, total = {}, 0
    for r in walked.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition, as are those below
        offset[r["_part"]], total = total, total + r["n"]

    before, follows, tables = dict.fromkeys(offset), {}, {}
    while offset:
        ends = {r["part"]: r for r in walked.mapInArrow(partial(_walk_ends, offset, before, 0 if tables else LEADERS), _ENDS).collect()}
        tables = tables or {part: r["table"] for part, r in ends.items()}
        taken, carry, settled = before, None, True
        before = {}
        for part in offset:
            before[part], end, table = carry, ends[part], tables[part]
            settled = settled and (carry and carry[2:]) == (taken[part] and taken[part][2:])
            if carry is None or not carry[0] == end["first_key"] == end["key"]:
                carry = (end["key"], end["low"], end["start"], end["leader"])
            elif table is not None:
                k = _last_below([t["high"] for t in table], carry[1])
                carry = carry if k < 0 else (carry[0], table[k]["low"], carry[2], table[k]["leader"])
            elif _below(end["least"], carry[1]):
                carry = (carry[0], end["low"], carry[2], end["leader"])
        if settled:
            nearest = total
            for part in reversed(offset):
                follows[part] = nearest
                nearest = nearest if ends[part]["first"] is None else ends[part]["first"]
            break

    kept = [ranking.schema["block"], ranking.schema["release_id"]]
    schema = T.StructType([*kept, T.StructField("rank", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("size", T.LongType())])
    return walked.mapInArrow(partial(_walk_rows, offset, before, follows), schema).select("block", "release_id", "rank", (F.col("size") > 1).alias("tied"), "pos", "size")


_TABLE = pa.list_(pa.struct({"high": pa.float64(), "low": pa.float64(), "leader": pa.int64()}))
_ENDS = "part int, first_key string, key string, low double, start long, leader long, first long, least double, table array<struct<high: double, low: double, leader: long>>"
#: The longest table of last leaders that a partition gives.
LEADERS = 1000


def _below(high: float | None, low: float | None) -> bool:
    """high < low as Spark has it: false for nulls, and NaN is above all numbers."""
    return high is not None and low is not None and (high < low or (low != low and high == high))


def _last_below(highs: list, low: float | None) -> int:
    """Place of the last of rising numbers that is below ``low``, or -1."""
    return -1 if low is None else len(highs) - 1 if low != low else bisect_left(highs, low) - 1


def _last_leaders(highs: list, lows: list, at: int, most: int) -> list | None:
    """The last leader of rows of one block, whose first is the ``at``-th of all, by the lower margin they begin with: that of the last entry whose high is below it. None if these are more than ``most``."""
    ahead, below, last = [], [], [0] * len(highs)  # rows whose high is below all between them and the one at hand, the nearest at the end
    for j in range(len(highs) - 1, -1, -1):
        k = _last_below(below, lows[j])
        last[j] = last[ahead[k]] if k >= 0 else j
        if highs[j] is None or highs[j] != highs[j]:
            continue
        while below and below[-1] >= highs[j]:
            below.pop()
            ahead.pop()
        below.append(highs[j])
        ahead.append(j)
    table = []
    for high, j in zip(below, ahead, strict=True):
        if not table or table[-1]["leader"] != at + last[j]:
            table.append({"high": high, "low": lows[last[j]], "leader": at + last[j]})
    return table if len(table) <= most else None


def _walk(batch: pa.RecordBatch, at: int, carry: tuple | None, leaders: list) -> tuple | None:
    """Adds (leader, start of its block) of each group that begins in the batch, whose first row is the ``at``-th of all; gives the last leader (key, low, start, leader)."""
    key, low, start, leader = carry or (None, None, 0, 0)
    for k, high, own in zip(batch.column("_key").to_pylist(), batch.column("_high").to_pylist(), batch.column("_low").to_pylist(), strict=True):
        if k != key or _below(high, low):
            key, low, start, leader = k, own, start if k == key else at, at
            leaders.append((leader, start))
        at += 1
    return key, low, start, leader


def _walk_ends(offset: dict, before: dict, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's walk ends with: its first and last block, the last leader, the first group that begins in it, its least upper margin, and its table of last leaders."""
    part = first_key = carry = None
    leaders, highs, lows, at = [], [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if part is None:
            part, first_key = batch.column("_part")[0].as_py(), batch.column("_key")[0].as_py()
            carry, at = before[part], offset[part]
        carry = _walk(batch, at, carry, leaders)
        at += batch.num_rows
        highs += batch.column("_high").to_pylist()
        lows += batch.column("_low").to_pylist()
        del leaders[1:]
    if part is not None:
        least = min((x for x in highs if x is not None and x == x), default=None)
        table = _last_leaders(highs, lows, offset[part], most) if most and first_key == carry[0] else None
        columns = (part, first_key, *carry, leaders[0][0] if leaders else None, least, table)
        types = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), _TABLE)
        names = ["part", "first_key", "key", "low", "start", "leader", "first", "least", "table"]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names)


def _walk_rows(offset: dict, before: dict, follows: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the rank, place and size of their group. A group's size is known at the next one, so a partition's rows are held."""
    held, leaders, carry, at, part = [], [], None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if part is None:
            part = batch.column("_part")[0].as_py()
            carry, at = before[part], offset[part]
            leaders += [(carry[3], carry[2])] if carry else []
        carry = _walk(batch, at, carry, leaders)
        at += batch.num_rows
        held.append(batch.select(["block", "release_id"]))
    if part is None:
        return
    begins, starts = np.array(leaders, dtype=np.int64).T
    sizes = np.diff(begins, append=follows[part])
    at = offset[part]
    for batch in held:
        rows = np.arange(at, at + batch.num_rows)
        of = np.searchsorted(begins, rows, side="right") - 1
        at += batch.num_rows
        columns = [pa.array((begins - starts + 1)[of], pa.int32()), pa.array(rows - begins[of], pa.int32()), pa.array(sizes[of], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["block", "release_id", "rank", "pos", "size"])


def evidence(rows: DataFrame, community: Column, releases: DataFrame | None = None) -> DataFrame:
    """Of what a release's fit rests on: official, mixed or community scores only, with the label of the last; none for rows of ``releases`` (release_id) that aren't fitted."""
    one = rows.groupBy("release_id").agg(F.count("*").alias("n"), F.count_if(community).alias("community"))
    if releases is not None:
        one = releases.select("release_id").join(one, "release_id", "left").na.fill(0, ["n", "community"])
    kind = F.when(F.col("n") == 0, "none").when(F.col("community") == F.col("n"), "community-only").when(F.col("community") > 0, "mixed").otherwise("official")
    label = F.when(F.col("n") == 0, "no index benchmarks").when(F.col("community") < F.col("n"), "").when(F.col("n") == 1, "community Elo only").otherwise("community scores only")
    return one.withColumn("kind", kind).withColumn("label", label)


def lab_lineup(models: DataFrame, asof: Column) -> DataFrame:
    """Latest fitted release of each lab and tier."""
    top = F.max_by(F.struct("release_id", "theta"), F.struct("date", "release_id")).alias("top")
    return models.where(F.col("date") <= asof).groupBy("lab", "tier").agg(top).select("lab", "tier", "top.release_id", "top.theta")


def lineup_band(models: DataFrame) -> DataFrame:
    """By lab and date: the current flagship (before the first one, the best model) and the weakest of the lineup."""
    tiers = ("flagship", "mid", "small")
    days = models.groupBy("lab", "date").agg(*[F.max_by(F.when(F.col("tier") == t, F.struct("theta", "release_id")), F.when(F.col("tier") == t, F.col("release_id"))).alias(t) for t in tiers])
    so_far = Window.partitionBy("lab").orderBy("date")  # one row for each date
    state = days.select("lab", "date", *[F.last(t, ignorenulls=True).over(so_far).alias(t) for t in tiers])
    hi = F.coalesce("flagship", F.greatest("mid", "small"))
    # Least by theta; the first tier in order where equal.
    ranked = F.array(*[F.when(F.col(t).isNotNull(), F.struct(F.col(t)["theta"].alias("theta"), F.lit(k).alias("k"), F.col(t)["release_id"].alias("release_id"))) for k, t in enumerate(tiers)])
    lo = F.array_min(F.filter(ranked, lambda r: r.isNotNull()))
    return state.select("lab", "date", hi["theta"].alias("hi_theta"), lo["theta"].alias("lo_theta"), hi["release_id"].alias("hi_id"), lo["release_id"].alias("lo_id"))


def family_ribbon(models: DataFrame, asof: Column, window: int = 365) -> DataFrame:
    """By lab and date: best and weakest theta of what was released within ``window`` days; once more at ``asof``, where the latest release stands for an empty window."""
    known = models.where(F.col("date") <= asof)
    # Ties keep the earliest row.
    days = known.groupBy("lab", "date").agg(F.min(F.struct((-F.col("theta")).alias("v"), "date", "release_id")).alias("hi"), F.min(F.struct(F.col("theta").alias("v"), "date", "release_id")).alias("lo"), F.max_by(F.struct("theta", "release_id"), "release_id").alias("last"))
    trailing = Window.partitionBy("lab").orderBy(F.unix_date("date")).rangeBetween(-window, 0)
    knots = days.select("lab", "date", F.min("hi").over(trailing).alias("hi"), F.min("lo").over(trailing).alias("lo"))
    ends = days.groupBy("lab").agg(F.max("date").alias("latest"), F.max_by("last", "date").alias("last"), F.min(F.when(F.datediff(asof, "date") <= window, F.col("hi"))).alias("hi"), F.min(F.when(F.datediff(asof, "date") <= window, F.col("lo"))).alias("lo")).where(F.col("latest") < asof)
    flat = lambda df, d, hi, lo, hi_id, lo_id: df.select("lab", d.alias("date"), hi.alias("hi_theta"), lo.alias("lo_theta"), hi_id.alias("hi_id"), lo_id.alias("lo_id"))
    inner = flat(knots, F.col("date"), -F.col("hi.v"), F.col("lo.v"), F.col("hi.release_id"), F.col("lo.release_id"))
    outer = flat(ends, asof, F.coalesce(-F.col("hi.v"), F.col("last.theta")), F.coalesce(F.col("lo.v"), F.col("last.theta")), F.coalesce(F.col("hi.release_id"), F.col("last.release_id")), F.coalesce(F.col("lo.release_id"), F.col("last.release_id")))
    return inner.unionByName(outer)


def lifetimes(scores: DataFrame, releases: DataFrame, benches: DataFrame, deltas: DataFrame, asof: Column, saturation: float = 95.0, fresh: int = 365, recent: int = 365) -> DataFrame:
    """A benchmark's first score, scores, date of saturation, state and coverage of recent flagships."""
    out = released(releases, asof)
    reported = scores.join(out.select("release_id", "date", "tier"), "release_id").groupBy("benchmark", "release_id", "date", "tier").agg(F.max(F.when(F.col("reported_by") == "official", F.col("value"))).alias("best"))
    new = (F.col("tier") == "flagship") & (F.datediff(asof, "date") <= recent)
    sums = reported.groupBy("benchmark").agg(F.min("date").alias("first_score"), F.count("*").alias("n_scores"), F.min(F.when(F.col("best") >= saturation, F.col("date"))).alias("saturated_at"), F.count_if(new).alias("covered"))
    flagships = out.agg(F.count_if(new).alias("flagships"))
    age = F.datediff(asof, F.make_date("introduced", F.lit(7), F.lit(1)))
    both = benches.join(sums, "benchmark", "left").join(deltas.select("benchmark", "delta"), "benchmark", "left").join(F.broadcast(flagships))  # one row
    state = F.when(F.col("legacy"), "legacy").when(F.col("saturated_at").isNotNull(), "saturated").when(age.between(0, fresh), "fresh").otherwise("active")
    scored = F.coalesce("n_scores", F.lit(0)).cast("long")
    share = F.coalesce(F.try_divide(F.coalesce("covered", F.lit(0)), F.col("flagships")), F.lit(0.0))
    return both.where((age >= 0) | (scored > 0)).select("benchmark", "first_score", scored.alias("n_scores"), "saturated_at", state.alias("state"), "delta", share.alias("coverage"))


def comparability(rows: DataFrame, window: int = 548) -> DataFrame:
    """neighbours (flagships within ``window`` days) and shared (benchmarks that any of them has too) of each fitted release.

    Counts by day and by benchmark and day take the place of a join of all pairs.
    """
    near = lambda *by: Window.partitionBy(*by).orderBy("day").rangeBetween(-window, window)
    flag = (F.col("tier") == "flagship").cast("int")
    used = rows.select("release_id", F.unix_date("date").alias("day"), flag.alias("flag"), "benchmark")
    one = used.select("release_id", "day", "flag").distinct()
    days = one.groupBy("day").agg(F.sum("flag").alias("flags")).select("day", F.sum("flags").over(near()).alias("around"))
    per_bench = used.groupBy("benchmark", "day").agg(F.sum("flag").alias("flags")).select("benchmark", "day", F.sum("flags").over(near("benchmark")).alias("around"))
    shared = used.join(per_bench, ["benchmark", "day"]).groupBy("release_id").agg(F.count_if(F.col("around") > F.col("flag")).alias("shared"))
    return one.join(days, "day").join(shared, "release_id").select("release_id", "shared", (F.col("around") - F.col("flag")).alias("neighbours"))
