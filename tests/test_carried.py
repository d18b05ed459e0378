"""What carries state or looks back: replays, as-of lookups, cadence, access logs."""

import json
import os
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ability_engine.operators import asof, fit, forecast, replay, views
from ability_engine.streaming import cadence, logsource


def moments(spark, n, lab_of, seed=3):
    rng = random.Random(seed)
    start = date(2024, 1, 1)
    rows = [(k, lab_of(rng), start + timedelta(rng.randrange(300))) for k in range(n)]
    return spark.createDataFrame(rows, "point_id long, lab string, date date"), rows


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_lookups_by_brute_force(spark, ranges):
    hot = lambda rng: None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else rng.choice("abc")
    points, rows = moments(spark, 600, hot)
    knots, marks = moments(spark, 90, hot, 5)
    knots = knots.select("lab", "date", F.col("point_id").alias("v"))
    best = {}
    for v, lab, day in marks:
        best[lab, day] = max(v, best.get((lab, day), -1))
    got = {r.point_id: r for r in asof.around(points, knots, ("lab",), "date", "v", ranges).collect()}
    assert len(got) == 600
    for k, lab, day in rows:
        before = max((d for x, d in best if x == lab and d <= day), default=None) if lab else None
        after = min((d for x, d in best if x == lab and d >= day), default=None) if lab else None
        assert (got[k].before and got[k].before.v) == (best[lab, before] if before else None)
        assert (got[k].after and got[k].after.v) == (best[lab, after] if after else None)


def test_lookups_have_no_join_of_pairs(spark):
    points, _ = moments(spark, 50, lambda rng: "x")
    found = asof.around(points, points.select("lab", "date", F.col("point_id").alias("v")), ("lab",), "date", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    none = asof.last_before(points, points.limit(0).select("lab", "date", F.col("point_id").alias("v")), ("lab",), "date", "v")
    assert {r.v for r in none.collect()} == {None}


def test_samples_are_cut_at_the_window(spark):
    samples = spark.createDataFrame([("a", float(d), float(d)) for d in range(0, 50, 10)], "lab string, day double, p double")
    windows = spark.createDataFrame([("a", 15.0, 32.0), ("b", 1.0, 2.0), ("a", 7.0, 7.0)], "lab string, low double, high double")
    got = sorted((r.lab, r.day, r.p) for r in views.slice_samples(samples, windows).collect())
    assert got == [("a", 15.0, 15.0), ("a", 20.0, 20.0), ("a", 30.0, 30.0), ("a", 32.0, 32.0), ("b", 1.0, 0.0), ("b", 2.0, 0.0)]


def star(spark, n=40, seed=2):
    rng = random.Random(seed)
    releases = [(f"r{k:02}", "hot" if k % 3 else "cold", date(2023, 1, 1) + timedelta(rng.randrange(500)), rng.choice(["flagship", "flagship", None, "small"]), "announced" if k % 13 == 12 else "released") for k in range(n)]
    benches = [(f"b{k}", k, 1.0 + k % 2, k == 0, True, "x") for k in range(6)]
    scores = [(r[0], b[0], rng.uniform(5, 95), "official", None, 0) for r in releases for b in benches if rng.random() < 0.5]
    return (
        spark.createDataFrame(scores, "release_id string, benchmark string, value double, reported_by string, config string, score_pos int"),
        spark.createDataFrame(releases, "release_id string, lab string, date date, tier string, status string"),
        spark.createDataFrame(benches, "benchmark string, basket_pos int, weight double, legacy boolean, in_index boolean, preferred_config string"),
    )


def test_prefix_sums_give_the_fit_of_each_date(spark):
    scores, releases, benches = star(spark)
    days = [date(2022, 1, 1), *(date(2023, 3, 1) + timedelta(60 * k) for k in range(7))]
    grid = spark.createDataFrame([(d,) for d in days], "asof date")
    models, deltas, _ = fit.fit(scores, releases, benches, grid)
    want = {(r.asof, r.benchmark): r.delta for r in deltas.collect()}
    sigma = {r.asof: r.sigma for r in models.select("asof", "sigma").distinct().collect()}
    found = {r.k: r for r in replay.fits(replay.score_rows(scores, releases, benches, grid), F.lit(len(days))).collect()}
    for k, day in enumerate(days):
        known = {b: x for (d, b), x in want.items() if d == day}
        if not known:
            assert k not in found
            continue
        assert dict(zip(found[k].names, found[k].deltas, strict=True)) == pytest.approx(known, abs=1e-9)
        assert found[k].sigma == pytest.approx(sigma[day], abs=1e-9)


def test_replay_by_hand(spark):
    scores, releases, benches = star(spark)
    days = [date(2022, 1, 1), *(date(2023, 3, 1) + timedelta(60 * k) for k in range(7))]
    grid = spark.createDataFrame([(d,) for d in days], "asof date")
    labs = spark.createDataFrame([("hot",), ("cold",), ("none",)], "lab string")
    rows = {(r.asof, r.lab): r for r in replay.backtest(scores, releases, benches, grid, labs=labs).collect()}
    assert len(rows) == 3 * len(days)
    today, _, _ = fit.fit(scores, releases, benches, spark.createDataFrame([(date(2030, 1, 1),)], "asof date"))
    theta = {r.release_id: r.theta for r in today.collect()}
    out = [r for r in releases.collect() if r.status == "released" and (r.tier or "flagship") == "flagship"]
    for (day, lab), r in rows.items():
        ahead = min(((x.date, x.release_id) for x in out if x.lab == lab and x.date > day), default=(None, None))
        assert (r.actual, r.actual_id) == ahead
        assert r.actual_theta == (pytest.approx(theta[ahead[1]], abs=1e-9) if ahead[1] in theta else None)
        known = [x for x in out if x.lab == lab and x.date <= day]
        assert (r.p50 is not None) == bool(known) == (r.predicted_theta is not None)
        if known and r.actual:
            assert r.error_days == (r.actual - r.p50).days and r.in68 == (r.p16 <= r.actual <= r.p84)


def ticks(n=40, seed=1):
    rng = random.Random(seed)
    out, usage = [], 0.0
    for k in range(1, n + 1):
        usage += rng.uniform(0, 3)
        day = date(2024, 1, 20) + timedelta(k // 2)  # two ticks of each day
        out.append({"tick": k, "day": str(day), "mean": rng.choice([0.0, 2.0, 5.0, 12.0, 40.0, 150.0]), "usage": usage, "budget": 15.0, "last_research": None if k % 9 == 0 else 1.7e9 + k, "at": 1705795200.0 + 43200 * k})
    return out


def test_cadence_steps():
    one = lambda mean, day: {"tick": 0, "day": day, "mean": mean, "usage": 0.0, "budget": 0.0, "last_research": None, "at": 0.0}
    state, levels = cadence.START[1:6], []
    for mean, day in ((40, "a"), (5, "b"), (5, "b"), (5, "c"), (150, "d"), (0, "e"), (150, "f"), (0, "g"), (2, "h")):
        state, row = cadence.step(state, one(mean, day))
        levels.append(row["level"])
    assert levels == [3, 3, 3, 1, 4, 4, 4, 4, 0]


@pytest.mark.parametrize("cut", [1, 3, 40])
def test_cadence_stream_equals_the_walk(spark, tmp_path, cut):
    """Ticks of two sites, split into files of any size, out of order and repeated, in two runs of the query."""
    made = {"a": ticks(), "b": ticks(25, 7)}
    flat = [(s, t) for s, ts in made.items() for t in ts]
    random.Random(cut).shuffle(flat)
    flat += flat[:20]

    def start():
        stream = cadence.cadence(spark.readStream.schema(cadence.TICKS).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for half in (flat[: len(flat) // 2], flat[len(flat) // 2 :]):
        for at in range(0, len(half), max(cut, 6)):
            rows = [(s, t["tick"], date.fromisoformat(t["day"]), t["mean"], t["usage"], t["budget"], t["last_research"], t["at"]) for s, t in half[at : at + max(cut, 6)]]
            df = spark.createDataFrame(rows, "site string, tick long, day date, mean double, usage double, budget double, last_research double, at double")
            df.withColumns({c: F.timestamp_micros((F.col(c) * 1e6).cast("long")) for c in ("last_research", "at")}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 65
    for site, ts in made.items():
        mine = sorted((r for r in got if r.site == site), key=lambda r: r.tick)
        for r, want in zip(mine, cadence.walk(ts), strict=True):
            assert (r.level, r.tier, r.interval_hours, r.capped) == (want["level"], want["tier"], want["interval_hours"], want["capped"])
            assert r.month_usd == pytest.approx(want["month_usd"]) and (r.next_research is None) == (want["next_research"] is None)
            if r.next_research:
                assert pd.Timestamp(r.next_research).tz_localize("UTC").timestamp() == pytest.approx(want["next_research"])


def append(path, lines):
    with open(path, "a") as f:
        f.write("".join(x + "\n" for x in lines))


def run_logs(spark, tmp_path):
    spark.dataSource.register(logsource.AccessLogs)
    lines = spark.readStream.format("access_logs").option("path", str(tmp_path / "logs")).load()
    run = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return logsource.read_offset(run)


def test_access_logs_lose_and_double_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    want, a, b = [], logs / "a.log", logs / "b.log"

    def grow(path, n, tag):
        lines = [f"{tag}-{k}-é" + "x" * (k % 50) for k in range(n)]
        append(path, lines)
        want.extend(lines)

    grow(a, 40_000, "one")  # over two ranges
    grow(b, 3, "two")
    with open(b, "a") as f:
        f.write("half a line")
    offset = run_logs(spark, tmp_path)
    grow_late = [f"late-{k}" for k in range(5)]
    append(a, grow_late)  # after it was read: this log stays
    want.extend(grow_late)
    assert logsource.settle(str(logs), offset) == [] and a.stat().st_size > 0
    append(b, [" ended"])
    want.append("half a line ended")
    offset = run_logs(spark, tmp_path)
    assert logsource.settle(str(logs), offset) == ["a.log", "b.log"] and a.stat().st_size == b.stat().st_size == 0
    grow(a, 7, "new")
    # The process dies after the mark is written, before the log is cut.
    offset = run_logs(spark, tmp_path)
    size = a.stat().st_size
    (logs / "a.log.offset").write_text(json.dumps({"base": logsource.base(str(a)) + size, "cut": size, "digest": logsource._digest(str(a), size)}))
    grow(a, 2, "after")
    offset = run_logs(spark, tmp_path)
    assert logsource.settle(str(logs), offset) == ["a.log"]
    got = [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)
    assert logsource.settle(str(logs), offset) == []


def test_a_large_log_is_cut_though_it_grows(tmp_path):
    path = tmp_path / "x.log"
    append(path, ["a" * 10] * 20)
    read = os.path.getsize(path)
    append(path, ["b"])
    assert not logsource.truncate(str(path), read) and logsource.truncate(str(path), read, most=100) and os.path.getsize(path) == 0
    assert logsource.base(str(path)) == read + 2


def test_summary_without_rows(spark):
    """No rows give a total of zeros, and a row of lab null stays apart from it."""
    schema = "lab string, p50 date, actual date, error_days int, in68 boolean, in90 boolean, theta_error double"
    made = (date(2024, 1, 3), date(2024, 1, 1), -2, True, True, 0.5)
    none, one, open_ = ([tuple(r) for r in forecast.summary(spark.createDataFrame(rows, schema)).orderBy("total").collect()] for rows in ([], [(None, *made)], [("a", made[0], *[None] * 5)]))
    zeros = (None, True, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    assert none == open_ == [zeros]
    assert one == [(None, total, 1, 0, 1.0, 1.0, 2.0, 2.0, -2.0, 0.5) for total in (False, True)]
