"""Queries of ingestion, evaluation and traffic on pages, documents, conversations, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ability_engine.operators import ingest
from ability_engine.plans import oracle as o
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a

_DAILY = {"daily": "SELECT day, count(DISTINCT address) AS visitors FROM visits WHERE class = 'visit' GROUP BY 1"}
_MEAN = {"means": "SELECT *, round(avg(visitors) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS mean_visitors FROM daily"}


@query("traffic_daily_unique", o.sql("SELECT day, visitors FROM daily", _DAILY))
def traffic_daily_unique(spark, sf_dir):
    return ingest.daily_visitors(a.visits(spark, sf_dir))


@query("traffic_mean_tier", o.sql("SELECT day, visitors, mean_visitors, CASE WHEN mean_visitors >= 100 THEN 'frequent' WHEN mean_visitors >= 30 THEN 'twice-daily' WHEN mean_visitors >= 10 THEN 'daily' WHEN mean_visitors >= 3 THEN 'often' ELSE 'weekly' END AS tier, CASE WHEN mean_visitors >= 100 THEN 6 WHEN mean_visitors >= 30 THEN 12 WHEN mean_visitors >= 10 THEN 24 WHEN mean_visitors >= 3 THEN 72 ELSE 168 END AS hours FROM means", _DAILY, _MEAN))
def traffic_mean_tier(spark, sf_dir):
    return ingest.mean_visitors(ingest.daily_visitors(a.visits(spark, sf_dir))).withColumns({"tier": ingest.tier_for(F.col("mean_visitors")), "hours": ingest.interval_hours(F.col("mean_visitors"))})


_LEVELS = {
    "targets": "SELECT day, CAST(row_number() OVER (ORDER BY day) AS INT) AS k, CASE WHEN v >= 100 THEN 4 WHEN v >= 30 THEN 3 WHEN v >= 10 THEN 2 WHEN v >= 3 THEN 1 ELSE 0 END AS target FROM (SELECT day, visitors * (1 + day(day) % 5) / 5 AS v FROM daily)",
    "walked": "SELECT * FROM (WITH RECURSIVE f AS (SELECT day, k, target AS level, 0 AS below FROM targets WHERE k = 1 UNION ALL SELECT t.day, t.k, CASE WHEN t.target >= f.level OR f.below + 1 >= 2 THEN t.target ELSE f.level END, CASE WHEN t.target >= f.level OR f.below + 1 >= 2 THEN 0 ELSE f.below + 1 END FROM f JOIN targets t ON t.k = f.k + 1) SELECT * FROM f)",
}


@query("tier_hysteresis", o.sql("SELECT day, level FROM walked", _DAILY, _LEVELS))
def tier_hysteresis(spark, sf_dir):
    daily = ingest.daily_visitors(a.visits(spark, sf_dir))
    return ingest.hysteresis(daily.select("day", ingest.tier_level(F.col("visitors") * (1 + F.dayofmonth("day") % 5) / 5).alias("target")))


@query("month_to_date", "SELECT CAST(o_orderdate AS DATE) AS day, round(sum(sum(o_totalprice)) OVER (PARTITION BY date_trunc('month', CAST(o_orderdate AS DATE)) ORDER BY CAST(o_orderdate AS DATE)), 2) AS spent FROM orders GROUP BY CAST(o_orderdate AS DATE)")
def month_to_date(spark, sf_dir):
    from pyspark.sql import Window

    daily = a.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    so_far = Window.partitionBy(F.trunc("day", "month")).orderBy("day")  # the days of a month
    return daily.select("day", F.round(F.sum("total").over(so_far), 2).alias("spent"))


@query("incremental_new_items", "SELECT source AS source, lang, min(doc_id) AS pos FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.source = d.source AND s.lang = d.lang AND s.doc_id < 50) AND source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def incremental_new_items(spark, sf_dir):
    docs = a.table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("source", "lang", F.col("doc_id").alias("pos"))
    return ingest.new_items(docs, docs.where("pos < 50"), ["source", "lang"]).select("source", "lang", "pos")


@query("merge_upsert", "SELECT coalesce(p.p_partkey, q.p_partkey) AS p_partkey, coalesce(q.price, p.price) AS price, CASE WHEN p.price IS NULL THEN 'added' WHEN q.price IS NOT NULL AND q.price <> p.price THEN 'updated' ELSE 'kept' END AS action FROM (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_size < 40) p FULL OUTER JOIN (SELECT p_partkey, p_retailprice + p_size % 2 AS price FROM part WHERE p_size > 20) q ON p.p_partkey = q.p_partkey")
def merge_upsert(spark, sf_dir):
    part = a.table(spark, sf_dir, "part")
    old = part.where("p_size < 40").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = part.where("p_size > 20").select("p_partkey", (F.col("p_retailprice") + F.col("p_size") % 2).alias("price"))
    return ingest.merge_upsert(old, new, ["p_partkey"], "price")


@query("promote_insert_only", "SELECT c_custkey, 'published' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'researched' FROM customer WHERE NOT c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def promote_insert_only(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer")
    published = c.where("c_acctbal > 0").select("c_custkey", F.lit("published").alias("origin"))
    return ingest.promote(published, c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("researched").alias("origin")), ["c_custkey"])


@query("recent_changes_topk", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC, role LIMIT 100")
def recent_changes_topk(spark, sf_dir):
    return a.table(spark, sf_dir, "conversations").orderBy(F.desc("conv_id"), F.desc("turn"), "role").limit(100).select("conv_id", "turn", "role")


@query("page_links", r"""SELECT page_id, CAST(pos AS INT) AS pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) - 1 AS pos FROM pages)""")
def page_links(spark, sf_dir):
    return ingest.links(a.table(spark, sf_dir, "pages")).select("page_id", "pos", "href")


@query("page_fingerprint", r"""SELECT page_id, sha256(list_aggregate(list_sort(list_distinct(regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1))), 'string_agg', chr(10))) AS hash FROM pages WHERE regexp_matches(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>')""")
def page_fingerprint(spark, sf_dir):
    return ingest.fingerprint(ingest.links(a.table(spark, sf_dir, "pages")), "page_id", "href")


def _plain_text_sql() -> str:
    text = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "svg", "head"):
        text = rf"regexp_replace({text}, '(?is)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|br)[^>]*>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for name, sign in sorted(ingest.ENTITIES.items(), key=lambda e: e[0] == "amp"):  # the ampersand last: nothing is decoded twice
        text = f"regexp_replace({text}, '(?i)&{name};', '{sign.replace(chr(39), chr(39) * 2)}', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, {_plain_text_sql()} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", ingest.html_to_text(F.col("html")).alias("text"))


@query("slug_name_key", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9.]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug, regexp_replace(lower(p_name), '[^a-z0-9.]+', '', 'g') AS name_key FROM part")
def slug_name_key(spark, sf_dir):
    return a.table(spark, sf_dir, "part").select("p_partkey", ingest.slug(F.col("p_name")).alias("slug"), ingest.name_key(F.col("p_name")).alias("name_key"))


_HOSTS = ("example.com", "example.org")


@query("host_filter", r"""SELECT page_id, h AS host, h IN ('example.com', 'example.org') OR suffix(h, '.example.com') OR suffix(h, '.example.org') AS official FROM (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^https?://([^/:?#]+)', 1)) AS h FROM pages)""")
def host_filter(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", ingest.host(F.col("url")).alias("host"), ingest.host_matches(F.col("url"), _HOSTS).alias("official"))


@query("value_spellings", "SELECT p_partkey, CAST(CAST(floor(p_retailprice + 0.5) AS BIGINT) AS VARCHAR) AS whole, contains(p_name || ' ' || p_size, CAST(p_size AS VARCHAR)) AS named FROM part")
def value_spellings(spark, sf_dir):
    spelled = ingest.number_spellings(F.col("p_retailprice"))
    sizes = ingest.number_spellings(F.col("p_size").cast("double"))
    return a.table(spark, sf_dir, "part").select("p_partkey", spelled[0].alias("whole"), F.concat_ws(" ", "p_name", "p_size").contains(sizes[0]).alias("named"))


_EVAL = {
    "gold": "SELECT coalesce(source, '?') AS lab, l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1",
    "found": "SELECT coalesce(source, '?') AS lab, l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 0",
    "evals": "SELECT coalesce(g.lab, f.lab) AS lab, count(g.doc_id) AS gold, count(f.doc_id) AS found, count(*) FILTER (g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS matched FROM gold g FULL OUTER JOIN found f ON g.lab = f.lab AND g.doc_id = f.doc_id GROUP BY ROLLUP (coalesce(g.lab, f.lab))",
}


def _metrics(spark, sf_dir):
    marked = a.table(spark, sf_dir, "labels").join(a.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("lab", F.coalesce("source", F.lit("?")))
    found = ingest.evaluation(marked.where("quality = 1"), marked.where("toxic = 0"), ["doc_id"])
    return found.withColumns({n: F.round(n, 6) for n in ("precision", "recall")})


@query("eval_metrics", o.sql("SELECT lab, gold, found, matched, round(CASE WHEN found > 0 THEN matched / found ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN gold > 0 THEN matched / gold ELSE 0 END, 6)::DOUBLE AS recall FROM evals", _EVAL))
def eval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("gate_check", o.sql("SELECT lab, concat_ws(',', CASE WHEN r < 0.85 THEN 'recall' END, CASE WHEN p < 0.95 THEN 'precision' END) AS failed, r >= 0.85 AND p >= 0.95 AS passed FROM (SELECT lab, CASE WHEN found > 0 THEN matched / found ELSE 0 END AS p, CASE WHEN gold > 0 THEN matched / gold ELSE 0 END AS r FROM evals)", _EVAL))
def gate_check(spark, sf_dir):
    return ingest.gates(_metrics(spark, sf_dir)).select("lab", "failed", "passed")


@query("validation_report", "SELECT 'orders' AS tab, 'unknown customer' AS rule, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', 'discount out of range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05 UNION ALL SELECT 'customer', 'negative balance', count(*) FROM customer WHERE c_acctbal < 0")
def validation_report(spark, sf_dir):
    t = lambda n: a.table(spark, sf_dir, n)
    report = lambda df, tab, rule: df.agg(F.count("*").alias("rows")).select(F.lit(tab).alias("tab"), F.lit(rule).alias("rule"), "rows")
    orphans = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return report(orphans, "orders", "unknown customer").unionByName(report(t("lineitem").where(~F.col("l_discount").between(0, 0.05)), "lineitem", "discount out of range")).unionByName(report(t("customer").where("c_acctbal < 0"), "customer", "negative balance"))
