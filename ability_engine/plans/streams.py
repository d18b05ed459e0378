"""Queries of streams that carry state, on events: the cadence of three sites, and access logs read by offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ability_engine.operators import ingest
from ability_engine.plans import oracle as o
from ability_engine.plans.documents import _CLASS, _LINE
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a
from ability_engine.streaming import cadence, logsource, traffic

BUDGET = 25.0

_SITES = {
    "perday": "SELECT 'site-' || CAST(user_id % 3 AS VARCHAR) AS site, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS visitors, count(*) AS n FROM events GROUP BY 1, 2",
    "ticks": f"""SELECT *, CASE WHEN mean >= 100 THEN 4 WHEN mean >= 30 THEN 3 WHEN mean >= 10 THEN 2 WHEN mean >= 3 THEN 1 ELSE 0 END AS target FROM (SELECT site, day, CAST(row_number() OVER w AS BIGINT) AS tick, CAST(sum(n) OVER w AS DOUBLE) / 16 AS usage,
        round(avg(visitors * (1 + day(day) % 4) / 4.0::DOUBLE) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS mean FROM perday WINDOW w AS (PARTITION BY site ORDER BY day))""",
    "walked": """SELECT * FROM (WITH RECURSIVE f AS (SELECT site, 0::BIGINT AS tick, 0 AS level, 0 AS below FROM (SELECT DISTINCT site FROM ticks) UNION ALL SELECT t.site, t.tick, CASE WHEN t.target >= f.level OR f.below + 1 >= 2 THEN t.target ELSE f.level END,
        CASE WHEN t.target >= f.level OR f.below + 1 >= 2 THEN 0 ELSE f.below + 1 END FROM f JOIN ticks t ON t.site = f.site AND t.tick = f.tick + 1) SELECT * FROM f WHERE tick > 0)""",
    "spent": "SELECT *, usage - first_value(usage) OVER (PARTITION BY site, date_trunc('month', day + 1) ORDER BY tick) AS month_usd FROM ticks",
    "published": f"SELECT w.site, w.tick, w.level, s.mean AS visitors_per_day, month_usd, month_usd >= {BUDGET} AS capped, day, CASE WHEN month_usd >= {BUDGET} THEN 0 ELSE w.level END AS shown FROM walked w JOIN spent s ON s.site = w.site AND s.tick = w.tick",
}


@query(
    "cadence_stream",
    o.sql(
        f"SELECT site, tick, CAST(level AS INT) AS level, CASE shown {' '.join(f'WHEN {k} THEN {t[0]!r}' for k, t in enumerate(ingest.TIERS))} END AS tier, CAST(CASE shown {' '.join(f'WHEN {k} THEN {t[2]}' for k, t in enumerate(ingest.TIERS))} END AS INT) AS interval_hours, {o.r6('visitors_per_day')} AS visitors_per_day, {o.r6('month_usd')} AS month_usd, capped, strftime(CAST(day AS TIMESTAMP) + to_hours(CASE shown {' '.join(f'WHEN {k} THEN {t[2]}' for k, t in enumerate(ingest.TIERS))} END), '%Y-%m-%d %H:%M') AS next_research FROM published",
        _SITES,
    ),
)
def cadence_stream(spark, sf_dir):
    by_day = a.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("site-"), F.col("user_id") % 3).alias("site"), F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("visitors"), F.count("*").alias("n"))
    order = Window.partitionBy("site").orderBy("day")  # a row for each day
    mean = F.round(F.avg(F.col("visitors") * (1 + F.dayofmonth("day") % 4) / 4).over(order.rowsBetween(-6, 0)), 2)
    ticks = by_day.select("site", F.row_number().over(order).cast("long").alias("tick"), "day", mean.alias("mean"), (F.sum("n").over(order) / 16).alias("usage"), F.lit(BUDGET).alias("budget"), F.col("day").cast("timestamp").alias("last_research"), F.date_add("day", 1).cast("timestamp").alias("at"))
    folder = traffic.shared_folder(spark, "cadence")
    for part in (2, 0, 1, 0):  # out of order, and one part twice
        ticks.where(F.col("tick") * 7 % 3 == part).write.mode("append").parquet(f"{folder}/ticks")
    stream = cadence.cadence(spark.readStream.schema(cadence.TICKS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/ticks"))
    stream.writeStream.format("parquet").option("path", f"{folder}/cadence").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(cadence.CADENCE).parquet(f"{folder}/cadence")
    return found.withColumns({"visitors_per_day": F.round("visitors_per_day", 6) + 0.0, "month_usd": F.round("month_usd", 6) + 0.0, "next_research": F.date_format("next_research", "yyyy-MM-dd HH:mm")})


@query("traffic_log_source", f"SELECT CAST(ts AS DATE) AS day, {_CLASS} AS class, count(*) AS lines FROM events GROUP BY 1, 2")
def traffic_log_source(spark, sf_dir):
    """Two runs over logs that grow in between and are truncated after each run."""
    spark.dataSource.register(logsource.AccessLogs)
    folder, events = traffic.shared_folder(spark, "logs"), a.table(spark, sf_dir, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).select(F.expr(_LINE).alias("value")).write.mode("append").text(f"{folder}/access")
        lines = spark.readStream.format("access_logs").option("path", f"{folder}/access".removeprefix("file:")).load()
        run = lines.writeStream.format("parquet").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        logsource.settle(f"{folder}/access".removeprefix("file:"), logsource.read_offset(run))
    parsed = spark.read.schema("log string, value string").parquet(f"{folder}/lines").select(traffic.parse_line(F.col("value")).alias("v"))
    return parsed.groupBy("v.day", "v.class").agg(F.count("*").alias("lines"))
