"""Steps that compare names: their joins are by equal keys alone, and their results are those of a comparison of all pairs."""

import datetime
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ability_engine.functions import scalar
from ability_engine.operators import evaluate, fit, forecast, lineup, merge, screening, views
from ability_engine.plans import ability, data, registry, runs, views as view_plans  # noqa: F401
from ability_engine.sources import adapters


def joins(df):
    """The plan's lines of joins."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]


def test_launch_posts_of_one_stem(spark):
    rng = random.Random(3)
    names = [(k, "ab"[k % 2], rng.choice(("Nova ", "no", "")) + str(rng.randrange(30)) + rng.choice(("", ".5", "x"))) for k in range(60)]
    items = [("ab"[k % 2], k, f"The Nova-{rng.randrange(30)}{rng.choice(('', '.5', 'x', ' 7'))} and no{rng.randrange(30)}", f"https://x.example/{k // 3}/", str(k)) for k in range(120)]
    seen = [(rng.randrange(60), f"https://x.example/{rng.randrange(40)}") for _ in range(900)] + [(0, None)]
    found = screening.launch_posts(spark.createDataFrame(names, "name_id int, lab string, name string"), spark.createDataFrame(items, "lab string, pos int, title string, link string, date string"), spark.createDataFrame(seen, "name_id int, url_key string"))
    key = lambda text: re.sub(r"[^a-z0-9.]+", "", text.lower())
    want = {}
    for k, lab, name in names:
        fits = [i for i in items if i[0] == lab and re.search(re.escape(key(name)) + r"(?![0-9.])", key(i[2])) and (k, i[3].rstrip("/")) not in seen]
        if fits:
            want[k] = fits[0][4]
    assert {r.name_id: r.date for r in found.collect()} == want and len(want) > 20
    assert not any(word in line for line in joins(found) for word in ("RLIKE", "Contains(", "regexp"))


def test_official_hosts_are_no_array_of_a_lab(spark):
    rows = spark.createDataFrame([(1, "a", "https://news.A.example/x"), (2, "a", "https://xa.example/"), (3, "b", "https://a.example/"), (4, "a", None), (5, "a", "https://a.example:80/")], "k int, lab string, url string")
    hosts = spark.createDataFrame([("a", "a.Example"), ("a", "a.example"), ("b", "a.b.example"), ("c", None)], "lab string, host string")
    found = screening.with_official(rows, hosts)
    assert {r.k: r.official for r in found.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_list(spark):
    """Sixty rows with one list of candidates took sixty rounds; the rest is random, against the walk row by row."""
    rng = random.Random(5)
    rows = [("a", g, g, f, f) for g in range(60) for f in range(70)]
    lists = [sorted(rng.sample(range(25), rng.randrange(1, 9))) for _ in range(8)]
    rows += [("b", g, g, f, f) for g in range(30) for f in lists[rng.randrange(8)]]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pairs", "pairs")
    got = {tuple(r) for r in evaluate.pair(spark.createDataFrame([r for r in rows if r[0] == "a"], "lab string, gold_id int, gold_pos int, found_id int, found_pos int")).collect()}
    assert len(jobs.getJobIdsForGroup("pairs")) < 40
    spark.sparkContext.setJobGroup("", "")
    got |= {tuple(r) for r in evaluate.pair(spark.createDataFrame([r for r in rows if r[0] == "b"], "lab string, gold_id int, gold_pos int, found_id int, found_pos int")).collect()}
    want, used = set(), set()
    for lab, g in dict.fromkeys((r[0], r[1]) for r in rows):
        free = sorted(r[3] for r in rows if r[:2] == (lab, g) and (lab, r[3]) not in used)
        if free:
            used.add((lab, free[0]))
            want.add((lab, g, free[0]))
    assert got == want


def test_pair_lists_take_by_place(spark):
    gold = spark.createDataFrame([("a", 1, g, 9 - g) for g in range(3)] + [("a", 2, 7, 1)], "lab string, list int, gold_id int, gold_pos int")
    found = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "z", 1)], "lab string, list int, found_id string, found_pos int")
    assert {tuple(r) for r in evaluate.pair_lists(gold, found).collect()} == {("a", 2, "x"), ("a", 1, "y")}


def test_candidates_hold_each_other(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("aB-c") for _ in range(rng.randrange(7)))
    side = [[(rng.choice("xy"), k, k, name(), f"2024-0{rng.randrange(1, 5)}-{rng.randrange(10, 29)}") for k in range(150)] for _ in range(2)]
    gold, found = (spark.createDataFrame(s, "lab string, id int, pos int, name string, date string").withColumn("date", F.col("date").cast("date")) for s in side)
    key = lambda text: re.sub(r"[^a-z0-9.]+", "", text.lower())
    day = datetime.date.fromisoformat
    fits = lambda a, b: a and b and (a == b or (len(a) >= 4 and (a in b or b in a)))
    want = sorted((g[0], g[1], g[2], f[1], f[2]) for g in side[0] for f in side[1] if g[0] == f[0] and fits(key(g[3]), key(f[3])) and abs((day(g[4]) - day(f[4])).days) <= 45)
    df = evaluate.candidates(gold, found)
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 300
    assert not any("Contains(" in line or "contains(" in line.lower() for line in joins(df))


def test_verify_run_follows_its_sql(spark, tmp_path):
    """A quote that only a tolerance finds, a gap in the ids, and white space that isn't ASCII."""
    words = "athawh, thonre was is anly hend and, oftionnten. Enti a"
    rows = [(1, "x"), (9, "a b " + words), (10, "c d athawh thonre\n was is anly hend and oftionnten Enti a"), (11, f"{words.upper()} y"), (13, "p q " + words), (15, "u\u00a0v w x y"), (16, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.QUERIES["verify_run"](spark, str(tmp_path))
    found = con.execute(registry.ORACLES["verify_run"])
    at = [[c[0] for c in found.description].index(n) for n in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in found.fetchall())


def test_responses_are_not_broadcast(spark, sf_dir):
    """Files of a few MB hold millions of rows; sorted by columns, either side of this join was broadcast."""
    df = registry.QUERIES["extraction_scores"](spark, sf_dir)
    assert any("SortMergeJoin [page_id" in line for line in joins(df)) and not any("BroadcastHashJoin [page_id" in line and "pos#" in line for line in joins(df))


def test_pages_of_one_file_are_spread(spark, sf_dir):
    df = registry.QUERIES["leaderboard_tables"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def test_ids_of_a_stem_cost_no_call_of_their_own(spark):
    """Against a walk row by row; a stem was a call with tables of its own, 3 ms each."""
    rng = random.Random(6)
    new = [(rng.choice("ab"), k, f"Nova {rng.choice(('', '1', '2', '2-2', '123', '123-4'))}".strip()) for k in range(200)] + [("a", 900, "!"), (None, 901, "Nova")]
    used = [(rng.choice("ab"), f"{lab}-nova{rng.choice(('', '-1', '-2', '-2-2', '-123', '-123-2'))}") for lab in "ab" for _ in range(6)] + [("a", None), (None, "a-nova")]
    given = merge.allocate_ids(spark.createDataFrame(new, "lab string, pos int, name string"), spark.createDataFrame(used, "lab string, id string"))
    assert given.columns == ["lab", "pos", "name", "id"] and "FlatMapGroups" not in given._jdf.queryExecution().executedPlan().toString()
    gone, want = {u for u in used if u[1]}, {}
    for lab, pos, name in new:
        base = "-".join(x for x in (lab, *re.findall("[a-z0-9]+", name.lower())) if x)
        ids = [x for x in (base, *(f"{base}-{n}" for n in range(2, 20))) if (lab, x) not in gone] if lab and name != "!" else []
        want[pos] = ids[0] if ids else None
        gone.add((lab, want[pos]))
    assert {r.pos: r.id for r in given.collect()} == want and None in {want[k] for k in range(200)}


LAWS = [(k, 4.0 + k % 7 / 3, (0.0, 0.3, 0.9, 2.0)[k % 4], float((k * 13) % 400 - 20)) for k in range(200)]


@pytest.fixture(scope="module")
def law_rows(spark):
    return spark.createDataFrame(LAWS + [(200, None, 0.5, 3.0)], "lab int, mu double, sigma double, t0 double").withColumn("asof", F.lit("2020-01-01").cast("date"))


def test_quantiles_are_no_generated_code(law_rows):
    """As columns, five quantiles were more code than the JVM takes; the results are those of the columns."""
    found = forecast.wait_quantiles(law_rows, forecast.QUANTILES, F.lit(1.5))
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 20_000 and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.lab: r for r in found.collect()}
    gone = law_rows.withColumn("g", scalar.lognormal_cdf("mu", "sigma", "t0"))
    for n, q in (*forecast.QUANTILES.items(), ("mid", 0.5)):
        gone = gone.withColumn(f"p_{n}", scalar.clamp(F.col("g") + q * (1 - F.col("g")), 1e-12, 1 - 1e-12)).withColumn(f"w_{n}", F.exp(F.col("mu") + F.when(F.col("sigma") > 0, F.col("sigma") * scalar.normal_quantile(f"p_{n}")).otherwise(0.0)))
    for r in gone.where("mu is not null").collect():
        plain = {n: r[f"w_{n}"] if 1 - r.g >= 1e-9 else r.t0 + 1 for n in (*forecast.QUANTILES, "mid")}
        assert [got[r.lab][n] for n in forecast.QUANTILES] == pytest.approx([w if plain["mid"] <= 0 or w <= 0 else plain["mid"] * (w / plain["mid"]) ** 1.5 for n, w in plain.items() if n != "mid"], rel=1e-9)
    assert [got[200][n] for n in forecast.QUANTILES] == [None] * 5


@pytest.mark.parametrize("stretch", [1.0, 1.7])
def test_density_has_no_window(law_rows, stretch):
    """Samples meet their mode in the law's own task; the results are those of the columns."""
    found = forecast.density(law_rows, 7, stretch)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    ends = forecast.wait_quantiles(law_rows, {"lo": 0.02, "hi": 0.98, "_m": 0.5}, F.lit(stretch))
    points = ends.join(found.select("lab", "i", "day", "p"), "lab")
    for n, side in (("a", -0.5), ("b", 0.5)):
        at = F.col("day") + side
        points = points.withColumn(n, F.greatest(F.when((F.col("_m") > 0) & (at > 0), F.col("_m") * F.pow(at / F.col("_m"), F.lit(1 / stretch))).otherwise(at), "t0")).withColumn(f"c_{n}", scalar.lognormal_cdf("mu", "sigma", n))
    by = {}
    for r in points.where("lab < 200").collect():
        assert r.day == pytest.approx(r.lo + (r.hi - r.lo) * r.i / 6)
        by.setdefault(r.lab, []).append((r.i, r.c_b - r.c_a, r.hi - r.lo, r.p))
    assert len(by) == 200
    for rows in by.values():
        top = max(r[1] for r in rows)
        assert sorted(r[0] for r in rows) == list(range(7)) and [r[3] for r in rows] == pytest.approx([1.0 if r[2] < 1 or not top > 0 else r[1] / top for r in rows], abs=1e-6)
    assert [r.p for r in found.where("lab = 200").collect()] == [None] * 7


@pytest.mark.parametrize("name", ["level_at_dates", "crossings", "headline"])
def test_the_fit_broadcasts_no_parts_or_releases(spark, sf_dir, name):
    """Small files of keys hold millions of rows: what grows with the input is met by merges."""
    spark.catalog.clearCache()
    df = registry.QUERIES[name](spark, sf_dir)
    assert any("SortMergeJoin [l_partkey" in line for line in joins(df)) and not any(f"BroadcastHashJoin [{key}" in line for line in joins(df) for key in ("l_partkey", "release_id", "point_id"))
    spark.catalog.clearCache()


def test_fit_keeps_the_partitions_of_its_scores(spark, sf_dir):
    """The dates' own partitions multiplied those of the scores, which were read again for each."""
    known = ("2019-06-30", "2019-09-30", "2025-02-01")
    days = ability.dates(spark, *known)
    assert days.rdd.getNumPartitions() > 1
    rows = fit.observations(adapters.scores(spark, sf_dir), adapters.releases(spark, sf_dir), adapters.benches(spark, sf_dir), days)
    assert "CartesianProduct" not in rows._jdf.queryExecution().executedPlan().toString()
    by_date = {r.asof.isoformat(): r["count"] for r in rows.groupBy("asof").count().collect()}
    one = {d: fit.observations(adapters.scores(spark, sf_dir), adapters.releases(spark, sf_dir), adapters.benches(spark, sf_dir), ability.dates(spark, d)).count() for d in known}
    assert by_date == one and len(set(one.values())) == 3


@pytest.mark.parametrize("name", ["evaluation_gates", "full_evaluation"])
def test_evaluation_broadcasts_no_rows_of_gold_or_found(spark, sf_dir, name):
    """Of what is joined, only the first signs of keys and the numbers of their lengths may go to the driver."""
    spark.catalog.clearCache()
    held = [line for line in joins(registry.QUERIES[name](spark, sf_dir)) if "Broadcast" in line and "_head" not in line and "BroadcastNestedLoopJoin" not in line]
    assert not held, held
    spark.catalog.clearCache()


def tied_groups(rows):
    """rank, pos and size of rows (block, place, release_id, rating, se) by a walk in order."""
    out, low = {}, None
    for block in {r[0] for r in rows}:
        groups = []
        for _, place, release_id, rating, se in sorted((r for r in rows if r[0] == block), key=lambda r: r[1:3]):
            margin = None if se is None else 400 / math.log(10) * se
            high = None if margin is None else rating + margin
            # As in SQL: nothing is below a null, and NaN is above all numbers.
            if not groups or (high is not None and low is not None and (high < low or (low != low and high == high))):
                groups.append([])
                low = None if margin is None else rating - margin
            groups[-1].append(release_id)
        rank = 1
        for g in groups:
            out |= {(block, x): (rank, pos, len(g)) for pos, x in enumerate(g)}
            rank += len(g)
    return out


@pytest.mark.parametrize("leaders", [lineup.LEADERS, 0])
@pytest.mark.parametrize("se", ["none", "all tie", "equal", "random", "odd"])
def test_ties_across_partitions(spark, monkeypatch, se, leaders):
    """Groups that begin in one partition and end in another, with and without tables of last leaders; the plan folds no block in an array or a window."""
    monkeypatch.setattr(lineup, "LEADERS", leaders)
    rng = random.Random(5)
    wide = {"none": lambda: 0.0, "all tie": lambda: 1e3, "equal": lambda: 0.03, "random": lambda: rng.random() * 0.05, "odd": lambda: rng.choice([None, float("nan"), 0.0, 0.02, 0.05])}[se]
    rows = [(rng.choice(["x", "y", None]) if se == "odd" else "x", k, f"r{k:03d}", 1000.0 - k, wide()) for k in range(200)]
    rng.shuffle(rows)
    found = lineup.tie_groups(spark.createDataFrame(rows, "block string, place long, release_id string, rating double, se double"))
    want = tied_groups(rows)
    assert {(r["block"], r["release_id"]): (r["rank"], r["pos"], r["size"]) for r in found.collect()} == want and found.where("tied <> (size > 1)").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_rank_groups_go_on_from_the_qualified(spark):
    rows = [(1, k, f"r{k}", k < 5, 100.0 - k // 2, 0.0) for k in range(8)]
    ranking = spark.createDataFrame(rows, "block int, place long, release_id string, qualified boolean, rating double, se double")
    found = views.rank_groups(ranking)
    assert {r["release_id"]: (r["rank"], r["tied"], r["pos"], r["size"]) for r in found.collect()} == {
        "r0": (1, True, 0, 2), "r1": (1, True, 1, 2), "r2": (3, True, 0, 2), "r3": (3, True, 1, 2), "r4": (5, False, 0, 1), "r5": (6, False, 0, 1), "r6": (7, True, 0, 2), "r7": (7, True, 1, 2)
    }
    assert found.schema["block"].dataType.simpleString() == "string"


def test_rank_groups_places_rows_without_one_task_for_all(spark, sf_dir):
    spark.catalog.clearCache()
    plan = registry.QUERIES["rank_groups"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "collect_list" not in plan
    spark.catalog.clearCache()
