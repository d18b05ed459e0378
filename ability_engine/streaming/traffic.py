"""Traffic: access log lines into visits, and their fold by day as a stream.

A batch's distinct (day, visitor) pairs are written under its own number, so a batch that runs again overwrites itself. A visitor is a hash of the address
under a random salt of the day. ``compact`` closes days: their counts are all that stays, hashes and salts go, and lines of closed days are ignored from then
on. Days are closed by the date that it is told, not by the newest event.

A folder holds ``pairs/batch=n``, ``salts/day=d`` and ``state/n`` (``days``: closed days, ``pairs``: those of open days when it was written). The highest state with a
``DONE`` counts, so a compaction that fails leaves the last one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Agents that are no people, and the path that a visit asks for.
BOTS = r"(?i)bot|crawl|spider|curl|wget|python-requests|Go-http|HeadlessChrome"
VISIT_PATH = "/latest.json"


def parse_line(line: Column) -> Column:
    """Struct of class (visit, ignored, bot, malformed), day and address of ``addresses|time|method|path|status|agent``."""
    part = F.split(F.trim(F.coalesce(line, F.lit(""))), r"\|", 6)
    address = F.trim(F.split(F.get(part, 0), ",")[0])
    at = F.try_to_timestamp(F.get(part, 1))
    status = F.regexp_extract(F.coalesce(F.get(part, 4), F.lit("")), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    served = status.between(200, 299) | (status == 304)
    readable = (F.size(part) == 6) & address.rlike("^[0-9a-fA-F:.]+$") & at.isNotNull() & status.isNotNull()
    kind = (
        F.when(F.trim(F.coalesce(line, F.lit(""))) == "", "ignored")
        .when(~F.coalesce(readable, F.lit(False)), "malformed")
        .when((F.get(part, 2) != "GET") | (F.get(part, 3) != VISIT_PATH) | ~served, "ignored")
        .when(F.get(part, 5).rlike(BOTS), "bot")
        .otherwise("visit")
    )
    return F.struct(kind.alias("class"), at.cast("date").alias("day"), address.alias("address"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder; a temporary one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="traffic-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def _state(spark: SparkSession, folder: str) -> int:
    """Number of the last whole state; -1 if there is none."""
    return max((int(n) for n in _names(spark, f"{folder}/state") if "DONE" in _names(spark, f"{folder}/state/{n}")), default=-1)


def closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """day and visitors of the days that are closed."""
    n = _state(spark, folder)
    return spark.read.schema("day date, visitors long").parquet(f"{folder}/state/{n}/days") if n >= 0 else spark.createDataFrame([], "day date, visitors long")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (day, visitor) of open days."""
    n, schema = _state(spark, folder), "day date, visitor string"
    parts = [spark.read.schema(schema + ", batch int").parquet(f"{folder}/pairs").select("day", "visitor")] if _names(spark, f"{folder}/pairs") else []
    parts += [spark.read.schema(schema).parquet(f"{folder}/state/{n}/pairs")] if n >= 0 else []
    every = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(closed_days(spark, folder).select("day"), "day", "left_anti").distinct()


def _salts(days: DataFrame, folder: str) -> DataFrame:
    """day and salt of each day; new days get one, which is written down first."""
    spark = days.sparkSession
    read = lambda: spark.read.schema("salt string, day date").parquet(f"{folder}/salts").select("day", "salt")
    known = read() if _names(spark, f"{folder}/salts") else spark.createDataFrame([], "day date, salt string")
    days.join(known, "day", "left_anti").select("day", F.sha2(F.expr("uuid()"), 256).alias("salt")).coalesce(1).write.mode("append").partitionBy("day").parquet(f"{folder}/salts")
    return read()


def fold(lines: DataFrame, folder: str, checkpoint: str, closed: DataFrame | None = None):
    """Start the fold of a stream with a column ``value`` into ``folder``; it ends when what is there has been read. ``closed``: further days that take no visitors."""

    def put(batch: DataFrame, number: int) -> None:
        seen = batch.select(parse_line(F.col("value")).alias("v")).select("v.*").where("class = 'visit'")
        shut = closed_days(batch.sparkSession, folder).select("day")
        seen = seen.join(shut if closed is None else shut.unionByName(closed.select("day")), "day", "left_anti").select("day", "address").distinct().persist()
        salts = _salts(seen.select("day").distinct(), folder)
        visitor = F.substring(F.sha2(F.concat_ws(":", "salt", "address").cast("binary"), 256), 1, 12)
        seen.join(salts, "day").select("day", visitor.alias("visitor")).distinct().write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")
        seen.unpersist()

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str, today: str, keep: int | None = 14) -> None:
    """Close the days before ``today`` and keep the newest ``keep`` closed ones (all, if None). Running it again changes nothing."""
    n, pairs, batches = _state(spark, folder), _pairs(spark, folder).persist(), _names(spark, f"{folder}/pairs")
    day = F.lit(today).cast("date")
    counted = pairs.where(F.col("day") < day).groupBy("day").agg(F.count("*").alias("visitors")).unionByName(closed_days(spark, folder))
    kept = counted if keep is None else counted.orderBy(F.desc("day")).limit(keep)
    kept.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/{n + 1}/days")  # a row for each day
    pairs.where(F.col("day") >= day).write.mode("overwrite").parquet(f"{folder}/state/{n + 1}/pairs")
    files, done = _files(spark, f"{folder}/state/{n + 1}/DONE")
    files.create(done).close()
    pairs.unpersist()
    # What is left of a failed clean-up is of closed days, or known already.
    for name in batches:
        _delete(spark, f"{folder}/pairs/{name}")
    for name in _names(spark, f"{folder}/salts"):
        if name.startswith("day=") and name[4:] < today:
            _delete(spark, f"{folder}/salts/{name}")
    if n >= 0:
        _delete(spark, f"{folder}/state/{n}")


def visitors(spark: SparkSession, folder: str) -> DataFrame:
    """Visitors of each day: the counts of closed days, and the distinct visitors of open ones."""
    return closed_days(spark, folder).unionByName(_pairs(spark, folder).groupBy("day").agg(F.count("*").alias("visitors")))
