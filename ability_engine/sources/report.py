"""Report over a data folder, and the published document that it gates.

A folder has labs.json, benchmarks.json, models/<lab>.json and changes.jsonl. Files are read permissively: what can't be read is an issue of its
own, and the rest is still checked. Each table is read once and kept while the rules of ``validate`` run over it. Missing files count as empty, labs.json
and benchmarks.json with an issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ability_engine.operators import forecast, validate, views
from ability_engine.operators.screening import readable_pattern
from ability_engine.sources import star

ISSUE = "tab string, row string, rule string, severity string"


def _issue(df: DataFrame, tab: str, row: Column, rule: str, severity: str = "error") -> DataFrame:
    return df.select(F.lit(tab).alias("tab"), row.cast("string").alias("row"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with the name of their file; _bad holds what is no JSON of the schema."""
    if not star._exists(spark, path):
        return spark.createDataFrame([], f"{schema}, _bad string, _name string")
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("_name", F.element_at(F.split("_metadata.file_path", "/"), -1))


def _array(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a dimension in the order of its file, and the issue if it is missing or can't be read."""
    rows = _read(spark, f"{folder}/{name}.json", schema).persist()
    bad = _issue(rows.where("_bad is not null"), name, F.col("_name"), "file can't be read")
    if not star._exists(spark, f"{folder}/{name}.json"):
        bad = spark.createDataFrame([(name, f"{name}.json", "file is missing", "error")], ISSUE)
    return rows.where("_bad is null").drop("_bad", "_name"), bad


def report(spark: SparkSession, folder: str, today: Column, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, counters) of a folder. Issues: tab, row, rule, severity; counters: one row. ``only``: names of the lab files to look at; changes are then not held against releases."""
    labs, bad_labs = _array(spark, folder, "labs", star.LAB)
    benches, bad_benches = _array(spark, folder, "benchmarks", star.BENCHMARK)
    files = _read(spark, f"{folder}/models", star.LAB_FILE)
    files = (files if only is None else files.where(F.col("_name").isin(only))).persist()
    whole = files.where("_bad is null")
    models = whole.select(F.col("lab").alias("file"), "_name", F.explode("releases").alias("r")).select("file", "_name", "r.*")
    shaped = models.select("file", "lab", "id", "name", "date", "date_precision", "status", "tier", F.col("expected_window.start").alias("window_start"), F.col("expected_window.end").alias("window_end"), F.col("announcement.quote").alias("quote"), F.when(F.col("scores").isNull(), 0).otherwise(F.size("scores")).alias("n_scores"))
    scored = star.scores(whole).select("release_id", "benchmark", "value", "config", "reported_by", F.col("source.quote").alias("quote"))
    known_labs, ranges = labs.select("id"), benches.select("id", "min", "max")
    named = whole.where(F.col("_name").endswith(".json") & (F.col("_name") != F.concat("lab", F.lit(".json"))))

    hints = labs.select("id", F.explode("flagship_hints").alias("hint")).where(~readable_pattern("hint"))
    log = f"{folder}/changes.jsonl"
    lines = (spark.read.text(log) if star._exists(spark, log) else spark.createDataFrame([], "value string")).where("trim(value) <> ''")
    parsed = lines.select(F.substring("value", 1, 200).alias("line"), F.from_json("value", f"{star.CHANGE}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("c")).select("line", "c.*").persist()
    changed = validate.check_changes(parsed.where("_bad is null"), known_labs, shaped)
    issues = validate.all_of(
        bad_labs, bad_benches, _issue(files.where("_bad is not null"), "files", F.col("_name"), "file can't be read"), _issue(named, "files", F.col("_name"), "file name isn't that of its lab"),
        validate.check_labs(labs.withColumn("n_sources", F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources")))), _issue(hints, "labs", F.col("id"), "hint is no pattern"), validate.check_benchmarks(benches),
        validate.check_releases(shaped, known_labs, today), validate.check_scores(scored, ranges), _issue(parsed.where("_bad is not null"), "changes", F.col("line"), "line can't be read"),
        changed if only is None else changed.where("rule <> 'release not found'"),
    )
    found = validate.counters(shaped, scored, star.source_refs(whole), benches.where("in_index").select(F.col("id").alias("benchmark"))).drop("files")
    rows = (labs.agg(F.count_distinct("id").alias("labs")), benches.agg(F.count_distinct("id").alias("benchmarks")), files.agg(F.count_distinct("_name").alias("files")), parsed.agg(F.count("*").alias("changes")))
    for one in rows:
        found = found.crossJoin(one)  # one row each
    return issues, found


def calibration(launches: DataFrame, to: Column) -> DataFrame:
    """One row: what the replay up to ``to`` says with the stretch of the least loss (n, coverages, errors, sigma_scale) and the curve of calibration, without the replay's rows."""
    grid = forecast.replay_grid(launches, to)
    laws, actual = forecast.laws(launches, grid), forecast.actuals(launches, grid)
    scale = forecast.best_scale(forecast.calibrate(laws, actual)).select(F.col("scale").alias("sigma_scale"))
    total = forecast.summary(forecast.backtest(laws.crossJoin(F.broadcast(scale)), actual, F.col("sigma_scale"))).where("total").drop("lab", "total")  # the scale is one row
    curve = forecast.calibration_curve(laws, actual).agg(F.array_sort(F.collect_list(F.struct("nominal", "observed"))).alias("curve"))  # nine rows
    return total.crossJoin(scale).crossJoin(curve)


def publish(spark: SparkSession, folder: str, target: str, today: Column, at: str, backtest: DataFrame | None = None) -> DataFrame:
    """Write the document of a folder to ``target`` if the report has no errors; else raise ValueError, and ``target`` stays as it was. Returns the counters."""
    issues, found = report(spark, folder, today)
    broken = issues.where("severity = 'error'").groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in broken))
    data = star.read_all(spark, folder)
    released = star.releases(data["lab_files"]).withColumnRenamed("id", "release_id")
    labs = data["labs"].withColumnRenamed("id", "lab")
    star.write_document(views.bundle(released, labs, data["benchmarks"], data["changes"], at, backtest=backtest), target)
    return found
