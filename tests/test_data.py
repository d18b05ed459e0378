"""Merging, validation and state against known answers."""

from pyspark.sql import functions as F

from ability_engine.operators import evaluate, leaderboard, merge, screening, state, validate, views

REL = "lab string, name string, status string, date string, date_precision string, tier string"


def test_merge_folds_rows_of_one_model_in_order(spark):
    old = spark.createDataFrame([("l", "GPT 5", "rumored", "2024-01-01", "year", None, "l-gpt-5"), ("l", "Gone", "cancelled", "2024-01-01", "day", "mid", "l-gone")], REL + ", id string")
    new = [
        ("l", "gpt-5", "announced", "2024-03-01", "month", "flagship", 1), ("l", "GPT5", "released", "2024-03-09", "day", "mid", 2), ("l", "GPT-5", "announced", "2024-03-10", "month", "small", 3),
        ("l", "Gone", "released", "2025-01-01", "day", "small", 4), ("l", "Nova", "announced", "2024-05-01", "unknown", None, 5), ("l", "nova", "released", "2024-05-02", "unknown", "mid", 6), ("l", "!!!", "released", "2024-05-02", "day", None, 7),
    ]
    after, changes = merge.merge_releases(old, spark.createDataFrame(new, REL + ", pos long"))
    assert {tuple(r) for r in after.select("id", "status", "date", "date_precision", "tier").collect()} == {("l-gpt-5", "released", "2024-03-09", "day", "mid"), ("l-gone", "cancelled", "2024-01-01", "day", "mid"), ("l-nova", "announced", "2024-05-01", "unknown", "mid")}
    assert sorted((r.id, r.pos, r.kind, r.summary) for r in changes.collect()) == [
        ("l-gpt-5", 1, "release_updated", "date 2024-01-01 (year) -> 2024-03-01 (month)"), ("l-gpt-5", 1, "status_changed", "rumored -> announced"),
        ("l-gpt-5", 2, "release_updated", "date 2024-03-01 (month) -> 2024-03-09 (day)"), ("l-gpt-5", 2, "release_updated", "tier mid"), ("l-gpt-5", 2, "status_changed", "announced -> released"),
        ("l-nova", 5, "release_added", "Nova announced 2024-05-01"), ("l-nova", 6, "release_updated", "tier mid"),
    ]


def test_ids_step_aside(spark):
    new = spark.createDataFrame([("l", 1, "Nova"), ("l", 2, "Nova 2"), ("l", 3, "日本"), ("m", 1, "Nova")], "lab string, pos long, name string")
    used = spark.createDataFrame([("l", "l-nova"), ("l", "l-nova-3")], "lab string, id string")
    assert {(r.lab, r.pos): r.id for r in merge.allocate_ids(new, used).collect()} == {("l", 1): "l-nova-2", ("l", 2): "l-nova-2-2", ("l", 3): None, ("m", 1): "m-nova"}


def test_first_sight_and_capped_memory(spark):
    old = spark.createDataFrame([("a", "h1", "t0", "t0", ["1", "2"]), ("b", "h", "t0", "t0", ["x"]), ("z", "h", "t0", None, [])], "source string, hash string, checked_at string, changed_at string, seen array<string>")
    polled = spark.createDataFrame([("a", "h2", ["3", "2", "4"]), ("b", "h", ["x", "y"]), ("c", "h", ["n"])], "source string, hash string, keys array<string>")
    after, new = state.diff_sources(old, polled, F.lit("t1"), most=3)
    assert [(r.source, r.pos, r.key) for r in new.orderBy("pos").collect()] == [("a", 0, "3"), ("a", 1, "4")]
    rows = {r.source: (r.hash, r.checked_at, r.changed_at, r.seen) for r in after.collect()}
    assert rows == {"a": ("h2", "t1", "t1", ["2", "3", "4"]), "b": ("h", "t1", "t0", ["x", "y"]), "c": ("h", "t1", "t1", ["n"]), "z": ("h", "t0", None, [])}


def test_pairs_move_on(spark):
    rows = [("l", "g1", 1, "a", 1), ("l", "g1", 1, "b", 2), ("l", "g2", 2, "a", 1), ("l", "g2", 2, "b", 2), ("l", "g2", 2, "c", 3), ("l", "g3", 3, "a", 1)]
    found = evaluate.pair(spark.createDataFrame(rows, "lab string, gold_id string, gold_pos int, found_id string, found_pos int"))
    assert {(r.gold_id, r.found_id) for r in found.collect()} == {("g1", "a"), ("g2", "b")}


def test_summary_keeps_the_other_steps(spark):
    line = lambda old, new: spark.range(1).select(state.merge_summary(F.lit(old).cast("string"), F.lit(new))).first()[0]
    assert line(None, "eval: 1") == "eval: 1" and line("eval: 1", "arena: 2") == "arena: 2 · eval: 1"
    assert line("arena: 1 · x · eval: 2", "backfill: 3 · y") == "arena: 1 · x · backfill: 3 · y" and line("arena: 1", "free") == "free"


def test_variants_and_organisations(spark):
    one = lambda f, *a: spark.range(1).select(f(*map(F.lit, a))).first()[0]
    assert one(leaderboard.without_variants, "gemini-3-flash (thinking-minimal)") == "gemini-3-flash" and one(leaderboard.without_variants, "deepseek-v4-pro-high-20260813") == "deepseek-v4-pro"
    assert one(leaderboard.without_organisation, "GPT-5.1 (OpenAI)") == "GPT-5.1" and one(leaderboard.without_safe_organisation, "Mistral Large 3") == "Mistral Large 3"


def test_links_of_a_page(spark):
    html = '<a href="/news/a">x</a><a href=\'https://l.example/blog/b/\'>y</a><a href="/models/c">z</a><a href="/news/a/#t">again</a>'
    pages = spark.createDataFrame([(1, "https://www.l.example/models", html, "[p](https://l.example/2024/05/d) https://else.example/news")], "page_id int, url string, html string, text string")
    assert [r.link for r in screening.announcement_links(pages, ("l.example",)).orderBy("n").collect()] == ["https://www.l.example/news/a", "https://l.example/blog/b/", "https://l.example/2024/05/d"]


def test_issues_of_rows(spark):
    changes = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "seed", "l", "l-1", "release_added"), (2, "2024", "me", "k", "l-9", "moved")], "line int, at string, actor string, lab string, release_id string, kind string")
    found = validate.check_changes(changes, spark.createDataFrame([("l",)], "id string"), spark.createDataFrame([("l-1",)], "id string"))
    assert {(r.row, r.rule, r.severity) for r in found.collect()} == {("2", "at is no UTC time", "error"), ("2", "unknown actor", "error"), ("2", "unknown kind", "error"), ("2", "unknown lab", "error"), ("2", "release not found", "warning")}


def test_places_across_partitions(spark):
    rows = spark.range(1000).repartition(7).withColumn("x", (F.col("id") * 37) % 1000)
    assert all(r.place == r.x + 1 for r in views.with_place(rows, "x").collect())


def test_headline_has_its_pace_and_its_next_release(spark, sf_dir):
    """The query joins the four figures of the operator: nothing stands in for a forecast, and a date takes the pace of its own knots."""
    from ability_engine.operators import forecast, frontier
    from ability_engine.plans import ability, registry, views as plans  # noqa: F401
    from ability_engine.sources import adapters

    spark.catalog.clearCache()
    row = registry.QUERIES["headline"](spark, sf_dir).first()
    coming = views.next_up(forecast.chain(forecast.laws(adapters.releases(spark, sf_dir), ability.dates(spark, ability.NOW)), 1)).first()
    assert coming is not None and (row.next_lab, row.next_date) == (coming.lab, coming.p50) and {"logits_per_year", "doubling_months"} <= set(row.asDict())

    days = [("2021-01-01", "2020-03-01", "a", 0.0), ("2021-01-01", "2020-09-01", "b", 1.0), ("2024-01-01", "2020-03-01", "a", 0.0), ("2024-01-01", "2023-06-01", "c", 2.0), ("2024-01-01", "2023-12-01", "d", 2.5)]
    knots = spark.createDataFrame(days, "asof string, date string, release_id string, theta double").selectExpr("to_date(asof) as asof", "to_date(date) as date", "release_id", "theta", "100 / (1 + exp(-theta)) as index")
    now = knots.select("asof").distinct().withColumn("at", F.col("asof"))
    none = [spark.createDataFrame([], f"asof date, {rest}") for rest in ("lab long, p50 date", "release_id string, index double")]
    pace = frontier.pace(knots, now)
    found = {str(r.asof): r for r in views.headline(knots, pace, *none).collect()}
    assert {k: (r.top_id, r.steps) for k, r in found.items()} == {"2021-01-01": ("b", 2), "2024-01-01": ("d", 3)} and pace.count() == 2
    for r in pace.collect():
        assert found[str(r["at"])].logits_per_year == r.logits_per_year > 0 and found[str(r["at"])].doubling_months == r.doubling_days / 30.4375
    spark.catalog.clearCache()
