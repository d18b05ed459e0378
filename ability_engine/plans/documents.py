"""Queries of feeds, logs, streams, quotes and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ability_engine.functions import text
from ability_engine.operators import ingest, matching
from ability_engine.plans.registry import query
from ability_engine.sources import adapters as a
from ability_engine.sources import feeds
from ability_engine.streaming import traffic

_ITEM = "SELECT p_partkey AS id, 0 AS pos, 'https://example.com/' || p_partkey AS key, p_name AS title, 'https://example.com/' || p_partkey AS link, {} AS date FROM part"


def _bodies(spark, sf_dir, body):
    return a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("https://example.com/list/").alias("base"), F.expr(body).alias("body"))


@query("feed_items", _ITEM.format("p_brand"))
def feed_items(spark, sf_dir):
    body = "concat('<rss><channel><item><title><![CDATA[', p_name, ']]></title><link>https://example.com/', p_partkey, '</link><pubDate>', p_brand, '</pubDate></item></channel></rss>')"
    return feeds.distinct_items(feeds.feed_items(_bodies(spark, sf_dir, body)))


@query("markdown_items", _ITEM.format("CAST(NULL AS VARCHAR)") + " UNION ALL SELECT p_partkey, 2, 't:' || p_brand, p_brand, NULL, NULL FROM part")
def markdown_items(spark, sf_dir):
    body = r"concat('[Link 3: ', p_name, '](../', p_partkey, '#top) ![an image](x.png)\n## ', p_brand, ' ##\n')"
    return feeds.distinct_items(feeds.markdown_items(_bodies(spark, sf_dir, body)))


@query("json_items", _ITEM.format("p_brand"))
def json_items(spark, sf_dir):
    body = "to_json(named_struct('count', 1, 'data', array(named_struct('title', ' ', 'name', p_name, 'url', concat('/', p_partkey), 'date', p_brand))))"
    return feeds.distinct_items(feeds.json_items(_bodies(spark, sf_dir, body)))


@query("html_items", "SELECT p_partkey AS id, 0 AS pos, 'https://example.com/' || p_partkey AS key, p_name AS title, 'https://example.com/' || p_partkey AS link, p_brand AS date FROM part UNION ALL SELECT p_partkey, 3, 't:' || p_type, p_type, NULL, NULL FROM part")
def html_items(spark, sf_dir):
    html = "concat('<a class=\"x\" href=\"/', p_partkey, '#t\"><b>', p_name, '</b><time datetime=\"', p_brand, '\">now</time></a><a href=\"mailto:x\">mail us</a><a href=\"/q\">no</a><h2 id=\"h\">', p_type, '</h2><h5>deep heading</h5>')"
    bodies = _bodies(spark, sf_dir, html).withColumn("html", F.regexp_replace("body", "<time[^>]*>now</time>", "")).withColumn("html", F.regexp_replace("body", ">now<", "><"))
    return feeds.distinct_items(feeds.html_items(bodies, compose=False))


@query("extract_items", "SELECT p_partkey AS id, 0 AS pos, CASE p_partkey % 5 WHEN 3 THEN 'hf:' || p_name WHEN 4 THEN 't:' || p_name ELSE 'https://example.com/' || p_partkey END AS key FROM part WHERE p_partkey % 5 <> 4 OR length(p_name) BETWEEN 9 AND 199")
def extract_items(spark, sf_dir):
    raw = "case p_partkey % 5 when 0 then concat('<rss><channel><item><title>', p_name, '</title><link>https://example.com/', p_partkey, '</link></item></channel></rss>') when 1 then concat('<a href=\"/', p_partkey, '\">', p_name, '</a>') when 2 then '' when 3 then to_json(array(named_struct('id', p_name))) else '' end"
    text = "case p_partkey % 5 when 2 then concat('[', p_name, '](/', p_partkey, ')') when 4 then p_name else '' end"
    kind = "case p_partkey % 5 when 0 then 'rss' when 2 then 'json' when 3 then 'hf-org' else 'html' end"
    pages = a.table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{kind} as kind", "'https://example.com/list/' as base", f"{raw} as raw", f"{text} as text")
    return feeds.extract_items(pages, compose=False).select("id", "pos", "key")


@query("model_listing", "SELECT p_partkey AS id, 0 AS pos, 'hf:' || p_name AS key, p_name AS title, 'https://huggingface.co/' || p_name AS link, p_brand AS date FROM part")
def model_listing(spark, sf_dir):
    return feeds.model_items(_bodies(spark, sf_dir, "to_json(array(named_struct('modelId', p_name, 'createdAt', p_brand)))"))


_ANCHORS = r"""regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)"""


#: The oracle resolves what the pages have: links from the host's root, and absolute ones.
@query("relative_urls", f"SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(href, '#.*$', '') WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*$', '') END AS link FROM (SELECT page_id, url, unnest({_ANCHORS}) AS href, generate_subscripts({_ANCHORS}, 1) - 1 AS pos FROM pages)")
def relative_urls(spark, sf_dir):
    pages = a.table(spark, sf_dir, "pages")
    return ingest.links(pages).join(pages.select("page_id", "url"), "page_id").select("page_id", "pos", text.absolute_url("href", "url").alias("link"))


_LINE = "concat_ws('|', concat('10.0.', user_id, ', 10.9.9.9'), date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), if(event_type = 'click', 'POST', 'GET'), '/latest.json', if(user_id % 7 = 0, '304', if(user_id % 11 = 0, '500', '200')), if(event_type = 'error', 'Googlebot/2', 'Firefox | x'))"
_CLASS = "CASE WHEN event_type = 'click' OR (user_id % 11 = 0 AND user_id % 7 <> 0) THEN 'ignored' WHEN event_type = 'error' THEN 'bot' ELSE 'visit' END"


@query("traffic_log", f"SELECT CAST(ts AS DATE) AS day, {_CLASS} AS class, count(*) AS lines FROM events GROUP BY 1, 2")
def traffic_log(spark, sf_dir):
    lines = a.table(spark, sf_dir, "events").select(traffic.parse_line(F.expr(_LINE)).alias("v"))
    return lines.groupBy("v.day", "v.class").agg(F.count("*").alias("lines"))


def _folded(spark, sf_dir, closed=None):
    events = spark.readStream.schema(a.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern also takes a table of one file
    folder = traffic.shared_folder(spark, "visits")
    traffic.fold(events.select(F.expr(_LINE).alias("value")), f"{folder}/visits", f"{folder}/offsets", closed).awaitTermination()
    return f"{folder}/visits"


@query("traffic_stream", f"SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS visitors FROM events WHERE {_CLASS} = 'visit' AND CAST(ts AS DATE) <> DATE '2024-01-02' GROUP BY 1")
def traffic_stream(spark, sf_dir):
    return traffic.visitors(spark, _folded(spark, sf_dir, spark.sql("select date'2024-01-02' as day")))


@query("traffic_retained", f"WITH d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS visitors FROM events WHERE {_CLASS} = 'visit' GROUP BY 1) SELECT * FROM d WHERE day >= DATE '2024-01-20' UNION ALL (SELECT * FROM d WHERE day < DATE '2024-01-20' ORDER BY day DESC LIMIT 14)")
def traffic_retained(spark, sf_dir):
    folder = _folded(spark, sf_dir)
    traffic.compact(spark, folder, "2024-01-20")
    traffic.compact(spark, folder, "2024-01-20")  # closing twice changes nothing
    return traffic.visitors(spark, folder)


@query("quote_verification", "SELECT item_id, true AS verified, item_id % 3 = 2 AS altered FROM benchmark WHERE item_id % 3 <> 2 AND length(trim(text)) > 0 UNION ALL SELECT item_id, false, true FROM benchmark WHERE item_id % 3 = 2 AND length(trim(text)) > 0")
def quote_verification(spark, sf_dir):
    items = a.table(spark, sf_dir, "benchmark").where("length(trim(text)) > 0")
    quote = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   ")))).when(F.col("item_id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("zqx vqk 9999 "), F.col("text")))
    return items.select("item_id", text.quote_matches(F.concat(F.lit("[seen "), "text", F.lit("](x) end")), quote).alias("verified"), (F.col("item_id") % 3 == 2).alias("altered"))


_CELLS = "SELECT l_suppkey, p_brand, l_linestatus, l_linenumber % 2 AS odd, 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (7 * l_suppkey + 3 * CAST(substr(p_brand, 7) AS INT)) % 10 < 4 GROUP BY ALL"


@query("gold_match_scores", f"WITH cells AS ({_CELLS}), gold AS (SELECT l_suppkey, p_brand, arg_min(value, odd) AS g FROM cells WHERE l_linestatus = 'F' GROUP BY 1, 2) SELECT p_brand AS benchmark, count(*) AS compared, count(*) FILTER (abs(g - value) <= 1) AS matched, round(avg(abs(g - value)) FILTER (abs(g - value) <= 1), 6) AS mae FROM cells JOIN gold USING (l_suppkey, p_brand) WHERE l_linestatus <> 'F' GROUP BY 1")
def gold_match_scores(spark, sf_dir):
    cells = a.scores(spark, sf_dir)
    both = matching.match_scores(cells.where("reported_by = 'official'"), cells.where("reported_by <> 'official'").withColumn("unit", F.lit("%")))
    return both.groupBy("benchmark").agg(F.count("*").alias("compared"), F.count_if("matched").alias("matched"), F.round(F.avg(F.when(F.col("matched"), F.col("delta"))), 6).alias("mae"))


_ORG = r"(?i)^\s*acme(?: ai)?\s*:?\s+"


@query("leaderboard_match", "SELECT s_suppkey AS row_id, s_suppkey AS known_id, CAST(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INT) AS stage FROM supplier WHERE s_suppkey % 4 <> 3")
def leaderboard_match(spark, sf_dir):
    s = a.table(spark, sf_dir, "supplier")
    kind = F.col("s_suppkey") % 4
    shown = F.when(kind == 0, F.col("s_name")).when(kind == 1, F.concat(F.lit("Acme AI: "), "s_name")).when(kind == 2, F.concat(F.lit("Acme "), "s_name", F.lit(" (Feb 2026)"))).otherwise(F.concat(F.lit("No "), "s_name"))
    rows = s.select(F.col("s_suppkey").alias("row_id"), shown.alias("model"))
    known = s.select(F.col("s_suppkey").alias("known_id"), F.col("s_suppkey").alias("known_pos"), F.col("s_name").alias("name"))
    bare = F.regexp_replace("model", _ORG, "")
    name = ingest.name_key(F.col("name"))
    keys = (ingest.name_key(F.col("model")), ingest.name_key(bare), ingest.name_key(F.regexp_replace(bare, r"\([^)]*\)", " ")))
    return matching.match_names(rows, known, [(k, name) for k in keys])


@query("leaderboard_dedupe", "SELECT c_nationkey AS known_id, arg_min(c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END) * 1000000000 + c_custkey) AS row_id FROM customer GROUP BY 1")
def leaderboard_dedupe(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("known_id"), F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("rank"), (F.col("c_mktsegment") == "BUILDING").alias("plain"))
    return matching.one_row_each(rows).select("known_id", "row_id")
