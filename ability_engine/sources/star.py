"""The star on disk: JSON dimensions, one JSON file for each lab, and a log of changes as JSON lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<url:string,title:string,quote:string,retrieved_at:string,verified:boolean,verified_at:string,via:string,note:string>"
SCORE = f"struct<benchmark:string,value:double,config:string,reported_by:string,source:{SOURCE}>"
RELEASE = f"struct<id:string,lab:string,name:string,family:string,date:string,date_precision:string,status:string,tier:string,origin:string,expected_window:struct<start:string,end:string,source:{SOURCE}>,announcement:{SOURCE},sources:array<{SOURCE}>,scores:array<{SCORE}>,notes:string>"
LAB_FILE = f"lab string, updated_at string, releases array<{RELEASE}>"
BENCHMARK = "id string, name string, unit string, min double, max double, elo_reference double, weight double, generation int, community boolean, in_index boolean, legacy boolean, preferred_config string, human_baseline double, introduced int"
LAB = "id string, name string, short string, color string, color_note string, website string, sources array<struct<label:string,url:string,kind:string>>, flagship_hints array<string>, name_prefixes array<struct<match:string,prefix:string>>"
CHANGE = "at string, actor string, lab string, release_id string, kind string, summary string, source_url string"


def labs(spark: SparkSession, path: str) -> DataFrame:
    """Labs in the order of the file (lab_pos). A bad row ends the read."""
    rows = spark.read.schema(LAB).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("lab_pos", F.monotonically_increasing_id())  # a file of one array is one partition


def lab_sources(labs_: DataFrame) -> DataFrame:
    return labs_.select(F.col("id").alias("lab"), F.posexplode("sources").alias("source_pos", "s")).select("lab", "source_pos", "s.*")


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmarks in the order of the file, which is that of the basket. A bad row ends the read."""
    rows = spark.read.schema(BENCHMARK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("basket_pos", F.monotonically_increasing_id())  # a file of one array is one partition


def lab_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file of a lab; names that begin with an underscore are left out by the reader."""
    return spark.read.schema(LAB_FILE).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def readable_lab_files(spark: SparkSession, folder: str) -> DataFrame:
    """The lab files that can be read; a malformed one counts as empty, as gold and candidates may."""
    rows = spark.read.schema(f"{LAB_FILE}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.where("_bad is null and lab is not null").drop("_bad")


def lab_files_or_none(spark: SparkSession, folder: str) -> DataFrame:
    """The lab files of a folder; none where there is no folder yet."""
    return lab_files(spark, folder) if _exists(spark, folder) else spark.createDataFrame([], LAB_FILE)


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The catalog of a data folder: labs, benchmarks, files and changes, each also as a temporary view."""
    found = {"labs": labs(spark, f"{folder}/labs.json"), "benchmarks": benchmarks(spark, f"{folder}/benchmarks.json"), "lab_files": lab_files_or_none(spark, f"{folder}/models"), "changes": changes(spark, f"{folder}/changes.jsonl")}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def source_refs(files: DataFrame) -> DataFrame:
    """release_id, place (announcement, source, score or window) and the source itself, of every source that a release names."""
    one = lambda place, source: F.array(F.struct(F.lit(place).alias("place"), source.alias("source")))
    many = lambda place, sources: F.transform(F.coalesce(sources, F.array().cast(f"array<{SOURCE}>")), lambda s: F.struct(F.lit(place).alias("place"), s.alias("source")))
    every = F.concat(one("announcement", F.col("announcement")), many("source", F.col("sources")), many("score", F.transform("scores", lambda s: s["source"])), one("window", F.col("expected_window.source")))
    return releases(files).select(F.col("id").alias("release_id"), F.explode(every).alias("r")).where("r.source is not null").select("release_id", "r.place", "r.source.*")


def releases(files: DataFrame) -> DataFrame:
    """The canonical order: date, then id."""
    return files.select(F.explode("releases").alias("r")).select("r.*")


def scores(files: DataFrame) -> DataFrame:
    return releases(files).select(F.col("id").alias("release_id"), F.posexplode("scores").alias("score_pos", "s")).select("release_id", "score_pos", "s.*")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def canonical(files: DataFrame) -> DataFrame:
    """lab and the file's text: keys in the order of the contract, releases by date and id, missing values left out."""
    before = lambda a, b: F.struct(a["date"], a["id"]) < F.struct(b["date"], b["id"])
    ordered = files.withColumn("releases", F.array_sort("releases", lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)))
    shaped = ordered.withColumn("releases", F.col("releases").cast(f"array<{RELEASE}>"))
    return shaped.select("lab", F.to_json(F.struct("lab", "updated_at", "releases")).alias("value"))


def write_lab_files(files: DataFrame, folder: str, check: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Publish lab files: write them beside ``folder``, check them there, and put them in its place. False, and nothing changed, if it holds the same rows.

    ``check`` gives issues of the staged files (see ``validate``); errors leave ``folder`` as it was and raise ValueError. A reader sees the old
    folder or the new one, but for the moment between two renames.
    """
    spark, text = files.sparkSession, canonical(files)
    if _exists(spark, folder):
        old = spark.read.text(folder).select("value")
        if text.select("value").exceptAll(old).isEmpty() and old.exceptAll(text.select("value")).isEmpty():
            return False
    stage, away = (f"{folder.rstrip('/')}.{what}-{uuid.uuid4().hex}" for what in ("stage", "old"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    text.write.partitionBy("lab").text(stage)
    if check is not None and not check(lab_files(spark, stage)).where("severity = 'error'").isEmpty():
        store.delete(path(stage), True)
        raise ValueError("the files break rules; nothing was published")
    if _exists(spark, folder):
        store.rename(path(folder), path(away))
    store.rename(path(stage), path(folder))
    store.delete(path(away), True)
    return True


def write_document(document: DataFrame, folder: str) -> None:
    """The published document (one row of text) as one file."""
    document.coalesce(1).write.mode("overwrite").text(folder)


def seed_changes(releases_: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """``release_added`` events of releases (lab, id, name, status, date, announcement) that the log has none of."""
    known = log.where("kind = 'release_added'").select(F.col("release_id").alias("id")).distinct()
    fresh = releases_.join(known, "id", "left_anti")
    return fresh.select(F.lit(at).alias("at"), F.lit("seed").alias("actor"), "lab", F.col("id").alias("release_id"), F.lit("release_added").alias("kind"), F.concat_ws(" ", "name", "status", "date").alias("summary"), F.col("announcement.url").alias("source_url"))


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The log of changes; rows that can't be read are left out."""
    return spark.read.schema(CHANGE).option("mode", "DROPMALFORMED").json(path)


def append_changes(events: DataFrame, path: str) -> None:
    """Add events to the log. An event without time, actor or kind ends the write before anything is added."""
    whole = F.col("at").isNotNull() & F.col("actor").isNotNull() & F.col("kind").isNotNull()
    checked = events.withColumn("at", F.when(whole, F.col("at")).otherwise(F.raise_error(F.lit("a change needs at, actor and kind")).cast("string")))
    checked.write.mode("append").json(path)


def newest_changes(log: DataFrame, most: int = 100) -> DataFrame:
    return log.orderBy(F.desc("at"), "release_id", "kind").limit(most)
