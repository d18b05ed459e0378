"""Feeds, the star on disk, log lines and folding of text against known answers."""

import json

import pytest
from pyspark.sql import functions as F

from ability_engine.functions import text
from ability_engine.operators import matching
from ability_engine.sources import feeds, star
from ability_engine.streaming import traffic


def bodies(spark, *rows):
    return spark.createDataFrame([(k, "https://a.org/x/", b) for k, b in enumerate(rows)], "id int, base string, body string")


def found(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("id", "pos").collect()]


def test_feed(spark):
    rss = "<rss><channel><title>c</title><item><title>A &amp; B</title><guid>g1</guid><dc:date>d</dc:date></item><item><title>no link</title></item><item></item></channel></rss>"
    atom = '<feed><entry><title>T</title><link rel="self" href="s"/><link href="h" rel="alternate"/><updated>u</updated></entry></feed>'
    assert found(feeds.feed_items(bodies(spark, rss, atom, "<rss", "", None)), "id", "key", "title", "date") == [(0, "g1", "A & B", "d"), (0, "t:no link", "no link", None), (1, "h", "T", "u")]


def test_markdown(spark):
    body = "![img alt](i.png) [Link 2: Some title](../y#z) [ab](q) [mail me](mailto:x@y.z)\n# A heading #\n##### too deep\n"
    assert found(feeds.markdown_items(bodies(spark, body, None)), "key", "title") == [("https://a.org/y", "Some title"), ("t:A heading", "A heading")]


def test_json(spark):
    listed = [json.dumps({"posts": [{"title": 5, "name": " n ", "href": "/p"}, {"x": 1}, 3]}), json.dumps([{"slug": "s"}]), "not json", None]
    assert found(feeds.json_items(bodies(spark, *listed)), "id", "key", "title") == [(0, "https://a.org/p", "n"), (1, "t:s", "s")]


def test_items_are_distinct_and_limited(spark):
    items = spark.createDataFrame([(1, k, f"k{k % 5}", "t", None, None) for k in range(20)], "id int, pos int, key string, title string, link string, date string")
    assert found(feeds.distinct_items(items, 3), "pos", "key") == [(0, "k0"), (1, "k1"), (2, "k2")]


@pytest.mark.parametrize(
    ("line", "kind"),
    [("1.2.3.4, 9.9.9.9|2024-01-02T03:04:05Z|GET|/latest.json|200|Firefox|x", "visit"), ("::1|2024-01-02T03:04:05Z|GET|/latest.json|304|Firefox", "visit"), ("1.2.3.4|2024-01-02T03:04:05Z|GET|/|200|x", "ignored"), ("1.2.3.4|2024-01-02T03:04:05Z|GET|/latest.json|200|curl/8", "bot"), ("-|2024-01-02T03:04:05Z|GET|/latest.json|200|x", "malformed"), ("a|b", "malformed"), ("1.2.3.4|never|GET|/latest.json|200|x", "malformed"), ("1.2.3.4|2024-01-02T03:04:05Z|GET|/latest.json|x|x", "malformed"), (" ", "ignored"), (None, "ignored")],
)
def test_log_line(spark, line, kind):
    assert spark.range(1).select(traffic.parse_line(F.lit(line).cast("string")).alias("v")).first().v["class"] == kind


@pytest.mark.parametrize(
    ("page", "quote", "holds"),
    [("It’s “80.9” — new", "it's \"80.9\" - NEW", True), ("a 1,234 b", "1234", True), ("see [GPT five](http://x) now", "gpt five now", True), ("| MMLU | 81.3% | 86.2% |", "mmlu 81.3 86.2 x", False), ("| MMLU-Pro | 81.3% | 86.2% | 90% |", "MMLU-Pro: 81.3, 86.2, 90", True), ("", "x", False), ("x", "", False), (None, None, False), ("ﬁne", "fine", True)],
)
def test_quotes(spark, page, quote, holds):
    row = spark.createDataFrame([(page, quote)], "page string, quote string").select(text.quote_matches(F.col("page"), F.col("quote")).alias("m")).first()
    assert row.m is holds


def test_star_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rel = lambda i, d: {"id": i, "lab": "l", "name": i, "date": d, "status": "released", "scores": [{"benchmark": "b", "value": 1.5}]}
    (tmp_path / "in/l.json").write_text(json.dumps({"lab": "l", "updated_at": "t", "releases": [rel("l-2", "2024-02-01"), rel("l-1", "2024-01-01")]}))
    (tmp_path / "in/_skipped.json").write_text("{}")
    files = star.lab_files(spark, str(tmp_path / "in"))
    assert star.scores(files).count() == 2
    out = str(tmp_path / "out")
    assert star.write_lab_files(files, out) and not star.write_lab_files(files, out)
    assert [r.id for r in star.releases(star.lab_files(spark, out)).collect()] == ["l-1", "l-2"]


def test_changes(spark, tmp_path):
    log = str(tmp_path / "log")
    event = spark.createDataFrame([("2024", "a", "l", "r", "added", "s", None)], star.CHANGE)
    star.append_changes(event, log)
    star.append_changes(event.withColumn("at", F.lit("2025")), log)
    assert [r.at for r in star.newest_changes(star.changes(spark, log), 1).collect()] == ["2025"]
    with pytest.raises(Exception, match="a change needs"):
        star.append_changes(event.withColumn("kind", F.lit(None).cast("string")), log)


def test_one_row_each(spark):
    rows = spark.createDataFrame([(1, 10, 1, False), (1, 11, 2, True), (2, 12, 3, False), (2, 13, 4, False)], "known_id int, row_id int, rank int, plain boolean")
    assert sorted(map(tuple, matching.one_row_each(rows).collect())) == [(1, 11, 2, True), (2, 12, 3, False)]


def test_publishing_is_checked(spark, tmp_path):
    from ability_engine.operators import validate

    source = '{"url":"https://x.example/a","quote":"said","retrieved_at":"2024-01-01T00:00:00Z"}'
    release = lambda id_, date: f'{{"id":"{id_}","lab":"l","name":"N","date":"{date}","date_precision":"day","status":"released","announcement":{source},"scores":[]}}'
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "l.json").write_text(f'{{"lab":"l","updated_at":"t","releases":[{release("l-2", "2024-02-01")},{release("l-1", "2024-01-01")}]}}')
    (tmp_path / "labs.json").write_text('[{"id":"l","name":"L","color":"#123456","website":"https://l.example","sources":[{"label":"a","url":"https://l.example/f","kind":"rss"}]}]')
    (tmp_path / "benchmarks.json").write_text('[{"id":"b","unit":"%","min":0,"max":100}]')
    (tmp_path / "changes.jsonl").write_text('{"at":"2024","actor":"seed","lab":"l","release_id":"l-1","kind":"release_added"}\n')
    data = star.read_all(spark, str(tmp_path))
    assert data["labs"].count() == 1 and star.lab_sources(data["labs"]).first().kind == "rss" and spark.table("benchmarks").count() == 1
    assert star.lab_files_or_none(spark, str(tmp_path / "none")).count() == 0
    assert sorted(r.place for r in star.source_refs(data["lab_files"]).collect()) == ["announcement", "announcement"]
    assert [r.release_id for r in star.seed_changes(star.releases(data["lab_files"]), data["changes"], "2025").collect()] == ["l-2"]

    def check(day):
        def rules(files):
            flat = star.releases(files).select(F.col("lab").alias("file"), "lab", "id", "name", "date", "date_precision", "status", "tier", F.col("expected_window.start").alias("window_start"), F.col("expected_window.end").alias("window_end"), F.col("announcement.quote").alias("quote"), F.size("scores").alias("n_scores"))
            return validate.check_releases(flat, data["labs"].select("id"), F.lit(day).cast("date"))

        return rules

    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        star.write_lab_files(data["lab_files"], out, check("2024-01-15"))
    assert [p.name for p in tmp_path.glob("out*")] == []
    assert star.write_lab_files(data["lab_files"], out, check("2025-01-01")) and not star.write_lab_files(data["lab_files"], out)
    again = star.lab_files(spark, out).withColumn("updated_at", F.lit("u"))
    assert star.write_lab_files(again, out)  # it may read the folder that it replaces
    assert star.lab_files(spark, out).first().updated_at == "u" and [p.name for p in tmp_path.glob("out*")] == ["out"]


def test_entities():
    from ability_engine.operators.ingest import ENTITIES

    assert len(ENTITIES) == 23


@pytest.mark.parametrize("text, want", [("a&#8217;s &mdash; &AMP; &bogus; &#0;x &amp;lt;", "a’s — & &bogus; x &lt;"), ("&#x1F600;&#xD800;", "😀"), ("plain", "plain"), (None, None)])
def test_decoding(spark, text, want):
    from ability_engine.operators.ingest import decode_entities

    assert spark.createDataFrame([(text,)], "t string").select(decode_entities(F.col("t")).alias("t")).first().t == want


def test_small_laws(spark):
    from ability_engine.functions import scalar

    row = spark.range(1).select(scalar.lognormal_quantile(1.0, 0.0, 0.0), scalar.lognormal_quantile(1.0, 1.0, 0.0), scalar.lognormal_quantile(1.0, 1.0, 1.0), scalar.lognormal_quantile(1.0, 1.0, 0.5), scalar.theta_of_rating(scalar.rating_of(1.5)), scalar.normal_pdf(0.0)).first()
    assert [pytest.approx(x) for x in row] == [2.718281828459045, 0.0, float("inf"), 2.718281828459045, 1.5, 0.3989422804014327]


def test_malformed_files_count_as_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"lab":"a","updated_at":"t","releases":[]}')
    (tmp_path / "b.json").write_text('{"lab":')
    assert [r.lab for r in star.readable_lab_files(spark, str(tmp_path)).collect()] == ["a"]


def test_dates_are_strict(spark):
    from ability_engine.operators import ingest

    assert str(spark.range(1).select(ingest.iso_date(F.lit("2024-02-29"))).first()[0]) == "2024-02-29"
    with pytest.raises(Exception, match="no date"):
        spark.range(1).select(ingest.iso_date(F.lit("29.2.2024"))).collect()
    assert spark.range(1).select(ingest.iso_time(F.lit("2024-02-29T01:02:03Z").cast("timestamp"))).first()[0] == "2024-02-29T01:02:03Z"
