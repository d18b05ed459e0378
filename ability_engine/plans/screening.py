"""Queries of candidate screening, on parts (items and names), suppliers (labs) and orders (dates).

The expressions that make titles, links and dates of the driver's tables are the same text for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ability_engine.operators import ingest, screening
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

_LAB = "concat('lab-', p_size % 5)"
_TITLE = "CASE p_partkey % 7 WHEN 0 THEN concat('Introducing ', p_name) WHEN 1 THEN concat('We launched  “', p_name, '”') WHEN 2 THEN concat('Pricing of ', p_name) WHEN 3 THEN concat('A remodelled ', p_name) WHEN 4 THEN '' WHEN 5 THEN concat('New Grok and ', p_brand) ELSE p_name END"
_LINK = "CASE p_partkey % 3 WHEN 0 THEN concat('https://x.example/news/', lower(p_type), '/the_new-model/') WHEN 1 THEN concat('https://x.example/blog/', p_partkey, '?q=1') END"
_HINTS = [("lab-0", 0, r"\bbrand#1\d"), ("lab-0", 1, "red"), ("lab-1", 0, "("), ("lab-1", 1, "blue|green"), ("lab-2", 0, r"\bpart\b")]
_HINT_SQL = " ".join(f"WHEN lab = '{lab}' AND regexp_matches(text, '(?i){p}') THEN 'hint:{p}'" for lab, _, p in _HINTS if p != "(")
_GENERIC_SQL = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN 'keyword:{p}'" for p in screening.GENERIC_PATTERNS)
_SEGMENT = r"regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(link, '[?#].*$', ''), '^https?://[^/]*', ''), '/+$', ''), '([^/]*)$', 1), '[-_]+', ' ', 'g')"
_CANDIDATES = f"""SELECT * FROM (SELECT *, CASE {_HINT_SQL} {_GENERIC_SQL} END AS reason FROM (SELECT *, trim(regexp_replace(lower(translate(concat_ws(' ', title, nullif({_SEGMENT}, '')), '“”', '""')), '\\s+', ' ', 'g')) AS text
    FROM (SELECT p_partkey, {_LAB} AS lab, {_TITLE} AS title, {_LINK} AS link FROM part))) WHERE reason IS NOT NULL"""


@query("candidate_rank", f"SELECT p_partkey, lab, reason, CAST(row_number() OVER (PARTITION BY lab ORDER BY NOT starts_with(reason, 'hint:'), p_partkey) AS INT) AS place FROM ({_CANDIDATES})")
def candidate_rank(spark, sf_dir):
    items = a.table(spark, sf_dir, "part").select("p_partkey", F.expr(_LAB).alias("lab"), F.col("p_partkey").alias("pos"), F.expr(_TITLE).alias("title"), F.expr(_LINK).alias("link"))
    hints = spark.createDataFrame(_HINTS, "lab string, hint_pos int, pattern string")
    return screening.rank_candidates(screening.candidates(items, hints, compose=False)).select("p_partkey", "lab", "reason", "place")


_NAMED = "concat('Nova ', p_size, '.', p_partkey % 4, ' Max')"
_NAME_LINK = "CASE p_partkey % 5 WHEN 0 THEN concat('https://x.example/news/nova-', p_size, '-', p_partkey % 4, '-max') WHEN 1 THEN concat('https://x.example/max/', p_size, p_partkey % 4, '/new') WHEN 2 THEN concat('https://x.example/max-', p_size, '-', p_partkey % 4) WHEN 3 THEN concat('https://x.example/nova/', p_size, '9') ELSE 'no address' END"


@query("link_name_rank", """WITH s AS (SELECT p_brand AS name_id, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 5 IN (1, 2) THEN 1 ELSE 0 END AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY score DESC, pos) AS n FROM s WHERE score > 0)
    SELECT name_id, pos, CAST(score AS INT) AS score, CAST(n AS INT) AS place FROM r WHERE n <= 3""")
def link_name_rank(spark, sf_dir):
    links = a.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name_id"), F.expr(_NAMED).alias("name"), F.col("p_partkey").alias("pos"), F.expr(_NAME_LINK).alias("url"))
    return screening.rank_links(links).select("name_id", "pos", "score", "place")


_FOUND_URL = "CASE s_suppkey % 4 WHEN 0 THEN concat('https://www.nation', s_nationkey, '.example/a') WHEN 1 THEN 'https://news.ft.com/b' WHEN 2 THEN 'https://other.example/c' ELSE concat('https://blog.nation', s_nationkey, '.example/d') END"
_FOUND_NAME = "concat('Model ', s_suppkey % 3)"
_CONFIDENCE = "(s_suppkey % 6) / 10.0"


@query("screen_candidates", f"""SELECT s_nationkey AS lab, name, pos, official FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, name ORDER BY c DESC, pos) AS n FROM (SELECT s_nationkey, s_suppkey AS pos, {_FOUND_NAME} AS name, CAST({_CONFIDENCE} AS DOUBLE) AS c, s_suppkey % 4 IN (0, 3) AS official FROM supplier WHERE s_suppkey % 4 <> 2)) WHERE n = 1""")
def screen_candidates(spark, sf_dir):
    found = a.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lab"), F.col("s_suppkey").alias("pos"), F.expr(_FOUND_NAME).alias("name"), F.expr(_FOUND_URL).alias("url"), F.expr(f"cast({_CONFIDENCE} as double)").alias("confidence"))
    hosts = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lab"), F.expr("concat('nation', n_nationkey, '.example')").alias("host"))
    return screening.screen(found, hosts).select("lab", "name", "pos", "official")


@query("launch_post_lookup", """WITH names AS (SELECT s_suppkey AS name_id, s_nationkey % 5 AS lab, 'nova' || s_suppkey AS k FROM supplier), items AS (SELECT p_size % 5 AS lab, p_partkey AS pos, 'nova' || p_partkey % 150 || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 'ishere' AS t, 'https://x.example/p/' || p_partkey AS link FROM part)
    SELECT name_id, min(pos) AS pos FROM names n JOIN items i ON n.lab = i.lab AND regexp_matches(t, k || '([^0-9.]|$)') WHERE pos % 3 <> 0 GROUP BY 1""")
def launch_post_lookup(spark, sf_dir):
    names = a.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as name_id", "s_nationkey % 5 as lab", "concat('Nova ', s_suppkey) as name")
    items = a.table(spark, sf_dir, "part").selectExpr("p_size % 5 as lab", "p_partkey as pos", "concat('NOVA-', p_partkey % 150, if(p_partkey % 2 = 0, '.5', ''), ' is here') as title", "concat('https://x.example/p/', p_partkey, '/') as link", "cast(p_partkey as string) as date")
    seen = a.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey % 150 as name_id", "concat('https://x.example/p/', p_partkey) as url_key")
    return screening.launch_posts(names, items, seen).select("name_id", F.col("date").cast("bigint").alias("pos"))


_PLAN_NAME, _PLAN_DATE = "concat('M ', c_custkey)", "CASE c_custkey % 4 WHEN 0 THEN '2025-01-10' WHEN 1 THEN '2024-12' WHEN 2 THEN '2023-05-01' END"


@query("backfill_plan", f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'done' WHEN c_custkey % 5 = 0 THEN 'failed-before' WHEN c_custkey % 3 = 0 THEN 'already-in-models' WHEN c_custkey % 4 IN (2, 3) THEN 'too-old' ELSE 'pending' END AS status FROM customer")
def backfill_plan(spark, sf_dir):
    models = a.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PLAN_NAME).alias("name"), F.expr(_PLAN_DATE).alias("date"))
    some = lambda k, name: models.where(f"c_custkey % {k} = 0").select(F.expr(name).alias("name"))
    return screening.plan_status(models, some(7, "upper(name)"), some(5, "name"), some(3, "replace(name, ' ', '-')"), F.lit("2025-02-01").cast("date")).select("c_custkey", "status")


@query("url_classes", r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS key, regexp_matches(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '(?i)news|blog|announc|introduc|release|launch|(^|[/-])20\d{2}[/-]\d{1,2}([/-]|$)') AS announcement, regexp_matches(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '(?i)^/?$|/models?(/|$)|/docs?/|/pricing') AS overview FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+')")
def url_classes(spark, sf_dir):
    url = F.col("url")
    return a.table(spark, sf_dir, "pages").where(url.rlike("^https?://[^/?#]+")).select("page_id", screening.url_key(url).alias("key"), screening.is_announcement(url).alias("announcement"), screening.is_overview(url).alias("overview"))


_RAW_DATE = "CASE o_orderkey % 6 WHEN 0 THEN substr(d, 1, 10) WHEN 1 THEN substr(d, 1, 7) WHEN 2 THEN substr(d, 1, 4) WHEN 3 THEN concat(' ', d, ' ') WHEN 4 THEN 'soon' END"
_RAW = "SELECT o_orderkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders"


@query(
    "resolve_fields",
    f"""SELECT o_orderkey, CASE WHEN m = 0 OR m = 3 THEN d WHEN m = 1 THEN substr(d, 1, 7) || '-01' WHEN m = 2 THEN substr(d, 1, 4) || '-01-01' WHEN o_orderstatus = 'F' THEN NULL ELSE '2025-01-01' END AS date,
    CASE WHEN m = 0 OR m = 3 THEN 'day' WHEN m = 1 THEN 'month' WHEN m = 2 THEN 'year' WHEN o_orderstatus = 'F' THEN NULL ELSE 'unknown' END AS precision, CASE WHEN o_orderkey % 4 = 0 THEN 'mid' WHEN o_orderkey % 4 = 1 THEN 'flagship' END AS tier,
    CASE WHEN o_orderkey % 4 = 1 THEN 'Nova Opus ' || o_orderkey ELSE 'Mini ' || o_orderkey END AS name, CASE WHEN m IN (0, 3) THEN 'day' WHEN m = 1 THEN 'month' WHEN m = 2 THEN 'year' END AS index_precision FROM (SELECT *, o_orderkey % 6 AS m FROM ({_RAW.replace('STRING', 'VARCHAR')}))""",
)
def resolve_fields(spark, sf_dir):
    a.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_raw")
    rows = spark.sql(_RAW.replace("FROM orders", "FROM _orders_raw"))
    name = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" Opus "), "o_orderkey")).otherwise(F.concat(F.lit("Mini "), "o_orderkey"))
    raw_tier = F.when(F.col("o_orderkey") % 4 == 0, F.lit("mid")).otherwise(F.lit("unknown"))
    rules = F.array(*[F.struct(F.lit(m).alias("match"), F.lit(p).alias("prefix")) for m, p in (("mini", "Nova 4 "), ("^opus", "Nova "))])
    raw = F.expr(_RAW_DATE)
    found = screening.resolve_date(raw, F.lit("unknown"), F.when(F.col("o_orderstatus") == "F", "released").otherwise("announced"), F.lit(None).cast("struct<date:string,precision:string>"), F.lit("2025-01-01"))
    return rows.select("o_orderkey", found["date"].alias("date"), found["precision"].alias("precision"), screening.resolve_tier(raw_tier, name, F.array(F.lit("opus"))).alias("tier"), screening.with_prefix(name, rules).alias("name"), screening.index_date(raw)["precision"].alias("index_precision"))


@query("due_steps", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 7 = 0 THEN true ELSE epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) >= 3600 * 168 END AS due FROM events")
def due_steps(spark, sf_dir):
    last = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return a.table(spark, sf_dir, "events").select("event_id", screening.due(last, F.lit("2024-01-15T00:00:00Z").cast("timestamp"), F.lit(168)).alias("due"))


@query("announcement_links")
def announcement_links(spark, sf_dir):
    pages = a.table(spark, sf_dir, "pages").select("page_id", "url", "html", ingest.html_to_text(F.col("html")).alias("text"))
    return screening.announcement_links(pages, ("example.com", "example.org"))
