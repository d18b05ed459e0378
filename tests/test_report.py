"""The report over a data folder, and the document that it gates."""

import json

import pytest
from pyspark.sql import functions as F

from ability_engine.sources import report

SOURCE = {"url": "https://x.example/a", "quote": "said 61.5", "retrieved_at": "2024-01-01T00:00:00Z", "verified": True}


def release(lab, n, date, **more):
    return {"id": f"{lab}-{n}", "lab": lab, "name": f"N{n}", "date": date, "date_precision": "day", "status": "released", "announcement": SOURCE, "scores": [{"benchmark": "b", "value": 61.5, "reported_by": "official", "source": SOURCE}], **more}


def folder(path, **more):
    dates = {"l": ["2022-01-01", "2022-06-01", "2022-12-01", "2023-05-01", "2023-11-01", "2024-03-01"], "m": ["2022-02-01", "2022-05-01", "2022-09-01", "2023-01-01", "2023-08-01", "2024-01-01"]}
    lab = lambda x: {"id": x, "name": x.upper(), "color": "#123456", "website": f"https://{x}.example", "sources": [{"label": "a", "url": "https://l.example/f", "kind": "rss"}], "flagship_hints": ["nova"]}
    bench = {"id": "b", "unit": "%", "min": 0, "max": 100, "weight": 1, "generation": 1, "introduced": 2020, "in_index": True}
    change = {"at": "2024-01-01T00:00:00Z", "actor": "seed", "lab": "l", "release_id": "l-0", "kind": "release_added"}
    files = {f"models/{x}.json": json.dumps({"lab": x, "updated_at": "t", "releases": [release(x, n, d) for n, d in enumerate(days)]}) for x, days in dates.items()}
    files |= {"labs.json": json.dumps([lab("l"), lab("m")]), "benchmarks.json": json.dumps([bench]), "changes.jsonl": json.dumps(change) + "\n"}
    (path / "models").mkdir()
    for name, text in (files | more).items():
        if text is not None:
            (path / name).write_text(text)
    return str(path)


def found(spark, at, **more):
    issues, counters = report.report(spark, at, F.lit("2025-01-01").cast("date"), **more)
    return sorted((r.tab, r.row, r.rule, r.severity) for r in issues.collect()), counters.first().asDict()


def test_a_sound_folder_is_published(spark, tmp_path):
    at, out = folder(tmp_path), str(tmp_path / "latest")
    issues, counters = found(spark, at)
    assert issues == []
    assert counters == {"labs": 2, "benchmarks": 1, "files": 2, "releases": 12, "scores": 12, "index_scores": 12, "quoted_scores": 12, "sources": 24, "verified_sources": 24, "changes": 1}
    assert found(spark, at, only=["m.json"])[1]["releases"] == 6 and found(spark, at, only=["m.json"])[0] == []
    launches = spark.createDataFrame([(x, d, "released", "flagship") for x in "lm" for d in ("2022-01-01", "2022-06-01", "2022-12-01", "2023-05-01", "2023-11-01", "2024-03-01")], "lab string, date string, status string, tier string")
    backtest = report.calibration(launches.withColumn("date", F.col("date").cast("date")), F.lit("2024-03-01").cast("date"))
    report.publish(spark, at, out, F.lit("2025-01-01").cast("date"), "2025-01-01T00:00:00Z", backtest)
    document = json.loads(spark.read.text(out).first().value)
    assert [r["release_id"] for r in document["releases"]][:3] == ["l-0", "m-0", "m-1"] and len(document["recent_changes"]) == 1
    assert document["backtest"]["n"] > 0 and 1 <= document["backtest"]["sigma_scale"] <= 3 and len(document["backtest"]["curve"]) == 9 and "rows" not in document["backtest"]


def test_every_kind_of_file_can_be_wrong(spark, tmp_path):
    wrong = json.dumps({"lab": "l", "updated_at": "t", "releases": [release("l", 0, "2030-01-01"), release("l", 1, "2024-01-01", announcement={"url": "u"}, scores=[])]})
    at = folder(tmp_path, **{"models/l.json": "{", "models/x.json": wrong, "benchmarks.json": None, "changes.jsonl": 'no json\n{"at":"2024","actor":"seed","lab":"q","release_id":"m-9","kind":"release_added"}\n\n'})
    labs = json.loads((tmp_path / "labs.json").read_text())
    (tmp_path / "labs.json").write_text(json.dumps([labs[0] | {"flagship_hints": ["("]}, labs[1], labs[1]]))
    issues, counters = found(spark, at)
    rules = {(tab, rule) for tab, _, rule, _ in issues}
    assert rules >= {
        ("files", "file can't be read"), ("files", "file name isn't that of its lab"), ("benchmarks", "file is missing"), ("labs", "hint is no pattern"), ("labs", "duplicate lab id"), ("changes", "line can't be read"), ("changes", "unknown lab"),
        ("changes", "at is no UTC time"), ("changes", "release not found"), ("releases", "released in the future"), ("releases", "announcement has no quote"), ("releases", "released model with no scores"), ("scores", "unknown benchmark"),
    }
    assert ("files", "l.json", "file can't be read", "error") in issues and ("labs", "m", "duplicate lab id", "error") in issues
    assert (counters["files"], counters["releases"], counters["changes"], counters["benchmarks"]) == (3, 8, 2, 0)
    with pytest.raises(ValueError, match="file can't be read: 1"):
        report.publish(spark, at, str(tmp_path / "latest"), F.lit("2025-01-01").cast("date"), "t")
    assert not (tmp_path / "latest").exists()


def test_an_empty_folder(spark, tmp_path):
    issues, counters = found(spark, str(tmp_path))
    assert issues == [("benchmarks", "benchmarks.json", "file is missing", "error"), ("labs", "labs.json", "file is missing", "error")] and set(counters.values()) == {0}
