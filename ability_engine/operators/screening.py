"""Screening of candidates: which items may announce a release, which links and posts name it, and what a plan leaves out.

Labs' hints and hosts are small dimensions, folded to one array for each lab; items meet them in one equi-join on the lab.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ability_engine.functions.text import absolute_url, folded
from ability_engine.operators.ingest import host, host_matches, name_key
from ability_engine.operators.matching import held_keys

#: Words of announcements, whatever the lab.
GENERIC_PATTERNS = (
    r"\bintroduc(?:ing|e|es)\b",
    r"\bannounc(?:ing|e|es|ed|ement)\b",
    r"\bunveil(?:ing|s|ed)?\b",
    r"\bmodels?\b",
    r"\brelease[sd]?\b",
    r"\blaunch(?:ing|es|ed)?\b",
    r"\bgpt\b|\bgpt-\d",
    r"\bclaude\b",
    r"\bgemini\b",
    r"\bgrok\b",
    r"\bllama\b",
    r"\bdeepseek\b",
    r"\bqwen\d*\b",
    r"\bkimi\b",
    r"\bglm\b",
    r"\bmistral\b|\bmagistral\b",
)
#: Publishers whose reports may found a rumour.
PRESS = ("reuters.com", "bloomberg.com", "theinformation.com", "techcrunch.com", "cnbc.com", "theverge.com", "wired.com", "ft.com", "wsj.com", "nytimes.com", "axios.com", "semafor.com")
#: Paths of overview pages, and what is in the address of an announcement.
OVERVIEW_PATHS = (r"/models?(/|$)", r"/docs?/", r"/pricing")
ANNOUNCEMENT = r"news|blog|announc|introduc|release|launch|(^|[/-])20\d{2}[/-]\d{1,2}([/-]|$)"
#: Days of an incremental plan; what the dates of sources look like after the ISO forms.
WINDOW_DAYS = 120
DATE_FORMATS = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd")


@F.pandas_udf(BooleanType())
def readable_pattern(pattern: pd.Series) -> pd.Series:
    def one(p: str | None) -> bool:
        try:
            return re.compile(p) is not None
        except (re.error, TypeError):
            return False

    return pattern.map(one)


def path(url: Column) -> Column:
    """Path of an absolute address; null for what is none."""
    return F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*://[^/?#]"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def haystack(title: Column, link: Column, compose: bool = True) -> Column:
    """The title and the words of the link's last path segment, folded and lowered."""
    segment = F.regexp_extract(F.regexp_replace(path(link), "/+$", ""), "([^/]*)$", 1)
    return F.lower(folded(F.concat_ws(" ", title, F.nullif(F.regexp_replace(segment, "[-_]+", " "), F.lit(""))), compose))


def candidates(items: DataFrame, hints: DataFrame, compose: bool = True) -> DataFrame:
    """The items (lab, pos, title, link) that a hint of their lab (lab, hint_pos, pattern) or a generic pattern matches, with the reason; unreadable hints are ignored."""
    usable = hints.where(readable_pattern("pattern")).groupBy("lab").agg(F.array_sort(F.collect_list(F.struct("hint_pos", "pattern"))).alias("_hints"))
    rows = items.join(usable, "lab", "left").withColumn("_text", haystack(F.col("title"), F.col("link"), compose))
    hint = F.get(F.filter("_hints", lambda h: F.regexp_like(F.col("_text"), F.concat(F.lit("(?i)"), h["pattern"]))), 0)["pattern"]
    generic = F.coalesce(*[F.when(F.col("_text").rlike(f"(?i){p}"), F.lit(f"keyword:{p}")) for p in GENERIC_PATTERNS])
    found = rows.withColumn("reason", F.coalesce(F.concat(F.lit("hint:"), hint), generic)).where("_text <> '' and reason is not null")
    return found.drop("_text", "_hints")


def rank_candidates(found: DataFrame) -> DataFrame:
    """Adds the place of each candidate of its lab: hints first, else in the order of pos."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("lab").orderBy(~F.col("reason").startswith("hint:"), "pos")))


def is_overview(url: Column) -> Column:
    p = path(url)
    return F.coalesce(p.isin("", "/") | F.lit(False), F.lit(False)) | F.coalesce(F.reduce(F.array(*[p.rlike(f"(?i){r}") for r in OVERVIEW_PATHS]), F.lit(False), lambda a, b: a | b), F.lit(False))


def is_announcement(url: Column) -> Column:
    return F.coalesce(F.concat(host(url), path(url)).rlike(f"(?i){ANNOUNCEMENT}"), F.lit(False))


def url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""))


def announcement_links(pages: DataFrame, hosts: tuple[str, ...], most: int = 40) -> DataFrame:
    """page_id, n and link: what a page (page_id, url, html, text) links to on the given hosts that looks like an announcement; a page's first ``most``."""
    quoted = [F.regexp_extract_all("html", F.lit(rf"(?i)\bhref\s*=\s*{q}([^{q}\s>]+){q}"), F.lit(1)) for q in ('"', "'")]
    marked = F.regexp_extract_all("text", F.lit(r"\]\((https?://[^\s)]+)\)"), F.lit(1))
    bare = F.regexp_extract_all("text", F.lit(r"https?://[^\s\"'<>()\]]+"), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(F.concat(*quoted, marked, bare)).alias("pos", "href"))
    rows = rows.withColumn("link", absolute_url("href", "url")).withColumn("key", url_key(F.col("link")))
    kept = rows.where((F.col("key") != url_key(F.col("url"))) & host_matches(F.col("link"), hosts) & is_announcement(F.col("link")) & ~is_overview(F.col("link")))
    first = kept.groupBy("page_id", "key").agg(F.min_by("link", "pos").alias("link"), F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= most).select("page_id", "n", "link")


def link_score(url: Column, name: Column) -> Column:
    """2: the path holds the name's key; 1: all its numbers, as whole segments, and a word of it; else 0."""
    low = F.lower(F.coalesce(path(url), F.lit("")))
    flat = F.regexp_replace(low, "[^a-z0-9]", "")
    segments = F.concat(F.lit("/"), F.regexp_replace(low, "[^a-z0-9]+", "/"), F.lit("/"))
    tokens = F.filter(F.split(F.lower(name), "[^a-z0-9.]+"), lambda t: t != "")
    number = lambda t: t.rlike("^[0-9.]+$")
    numbers = F.transform(F.filter(tokens, lambda t: number(t) & t.rlike("[0-9]")), lambda t: F.regexp_replace(F.regexp_replace(t, r"\.+", "."), r"^\.|\.$", ""))
    words = F.filter(F.transform(F.filter(tokens, lambda t: ~number(t)), lambda t: F.replace(t, F.lit("."), F.lit(""))), lambda t: F.length(t) >= 2)
    spelled = lambda n, by: F.concat(F.lit("/"), F.replace(n, F.lit("."), F.lit(by)), F.lit("/"))
    in_path = F.forall(numbers, lambda n: segments.contains(spelled(n, "")) | segments.contains(spelled(n, "/")))
    key = F.replace(name_key(name), F.lit("."), F.lit(""))
    partly = (F.size(numbers) > 0) & in_path & F.exists(words, lambda w: flat.contains(w))
    return F.when(key == "", 0).when(flat.contains(key), 2).when(partly, 1).otherwise(0)


def rank_links(links: DataFrame, most: int = 3) -> DataFrame:
    """The best ``most`` links (name_id, name, pos, url) of each name, with score and place; ties in page order."""
    scored = links.withColumn("score", link_score(F.col("url"), F.col("name"))).where("score > 0")
    best = Window.partitionBy("name_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def title_names(title: Column, key: Column) -> Column:
    """The title names the model of this key, and no newer sibling: no digit or dot follows the key."""
    return (key != "") & F.regexp_like(name_key(title), F.concat(F.lit(r"\Q"), key, F.lit(r"\E(?![0-9.])")))


def launch_posts(names: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """The first item (lab, pos, title, link, date) of its lab that names each model (name_id, lab, name) and isn't in ``seen`` (name_id, url_key).

    Titles meet the keys that they hold, and each key's addresses are put in order of pos once. A name needs only as many of them as it has seen, and one
    more, so neither names nor items of one key multiply.
    """
    keyed = names.withColumn("_key", name_key(F.col("name"))).where("_key <> ''")
    titled = items.where("link is not null").select("lab", "pos", "title", "link", "date", name_key(F.col("title")).alias("_text"))
    named = held_keys(titled, keyed, ["lab"], "_text", "_key", lambda rest: ~rest.rlike("^[0-9.]"))
    one = named.groupBy("lab", "_key", url_key(F.col("link")).alias("url_key")).agg(F.min("pos").alias("pos"), F.min_by(F.struct("link", "title", "date"), "pos").alias("post"))
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy("lab", "_key").orderBy("pos", "url_key")))
    known = seen.select("name_id", "url_key").distinct()
    turns = F.explode(F.sequence(F.lit(1), (F.coalesce("_seen", F.lit(0)) + 1).cast("int"))).alias("_rank")
    asked = keyed.join(known.groupBy("name_id").agg(F.count("*").alias("_seen")), "name_id", "left").select("name_id", "lab", "_key", turns)
    fresh = asked.join(ranked, ["lab", "_key", "_rank"]).join(known, ["name_id", "url_key"], "left_anti")
    return fresh.groupBy("name_id").agg(F.min_by("post", "pos").alias("post")).select("name_id", "post.*")


def with_official(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` (lab, url) with ``official``: the host of the address is one of its lab's (lab, host), or a subdomain of one.

    A host's endings at its dots meet the hosts by an equi-join, once for each host that occurs, so a lab may have any number of them.
    """
    at = host(F.col("url"))
    ends = F.transform(F.array_append(F.filter(F.sequence(F.lit(1), F.length("_host")), lambda k: F.substr("_host", k, F.lit(1)) == "."), F.lit(0)), lambda k: F.substr("_host", k + 1))
    own = hosts.select("lab", F.lower("host").alias("_end")).where("_end is not null").distinct()
    used = rows.select("lab", at.alias("_host")).where("_host is not null").distinct().select("lab", "_host", F.explode(ends).alias("_end"))
    fits = used.join(own, ["lab", "_end"], "left_semi").select("lab", "_host").distinct().withColumn("_official", F.lit(True))
    kept = [c for c in rows.columns if c != "official"]
    return rows.withColumn("_host", at).join(fits, ["lab", "_host"], "left").select(*kept, F.coalesce("_official", F.lit(False)).alias("official"))


def screen(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """Found models (lab, pos, name, url, confidence) on their lab's hosts (lab, host) or in the press: one for each name's key, of the highest confidence, the first where equal."""
    rows = with_official(found, hosts).where(F.col("official") | host_matches(F.col("url"), PRESS))
    best = Window.partitionBy("lab", "key").orderBy(F.desc("confidence"), "pos")
    keyed = rows.withColumn("key", name_key(F.col("name"))).where("key <> ''")
    return keyed.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def within_window(date: Column, today: Column, days: int = WINDOW_DAYS) -> Column:
    """The date (a day, or a month as its first day) is at most a day ahead and ``days`` old."""
    age = F.datediff(today, F.try_to_date(F.when(F.length(date) == 7, F.concat(date, F.lit("-01"))).otherwise(date), "yyyy-MM-dd"))
    return F.coalesce(age.between(-1, days), F.lit(False))


def plan_status(models: DataFrame, done: DataFrame, failed: DataFrame, known: DataFrame, today: Column, incremental: bool = True) -> DataFrame:
    """Models (name, date) with why a plan leaves them out: done, failed-before, already-in-models, too-old; else pending. done, failed, known: name."""
    low, key = F.lower("name"), name_key(F.col("name"))
    flag = lambda df, k, as_: df.select(k.alias(f"_{as_}_key")).distinct().withColumn(f"_{as_}", F.lit(True))
    rows = models.withColumns({"_low": low, "_name": key})
    for df, k, mine, as_ in ((done, low, "_low", "done"), (failed, low, "_low", "failed"), (known, key, "_name", "known")):
        rows = rows.join(flag(df, k, as_), F.col(mine) == F.col(f"_{as_}_key"), "left")
    late = F.lit(incremental)
    status = F.when(F.col("_done"), "done").when(F.col("_failed"), "failed-before").when(late & F.col("_known"), "already-in-models").when(late & ~within_window(F.col("date"), today), "too-old").otherwise("pending")
    return rows.withColumn("status", status).select(*models.columns, "status")


def due(last: Column, now: Column, hours: Column, enabled: Column | bool = True) -> Column:
    """A step is due if it never ran, its mark can't be read, or ``hours`` have passed."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(last))
    return (F.lit(enabled) if isinstance(enabled, bool) else enabled) & F.coalesce(seconds >= 3600 * hours, F.lit(True))


def resolve_tier(raw: Column, name: Column, hints: Column) -> Column:
    """A tier that is given; flagship if a hint (array of patterns) matches the name; else null."""
    hinted = F.exists(hints, lambda h: F.regexp_like(F.lower(name), F.concat(F.lit("(?i)"), h)))
    return F.when(raw.isin("flagship", "mid", "small"), raw).when(F.coalesce(hinted, F.lit(False)), "flagship")


#: Precisions of a date, the coarsest first.
PRECISIONS = ("unknown", "year", "quarter", "month", "day")


def precision_rank(precision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECISIONS)), precision) - 1


def resolve_date(raw: Column, precision: Column, status: Column, known: Column, fallback: Column) -> Column:
    """Struct of date (ISO) and precision: a day, month or year as given, then the known one (a struct, or null), then, unless released, the fallback as unknown; else null."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    made = lambda d, p: F.struct(d.alias("date"), p.alias("precision"))
    month = F.when(precision.isin("unknown", "day"), F.lit("month")).otherwise(precision)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), made(text, F.when(precision == "unknown", F.lit("day")).otherwise(precision)))
        .when(text.rlike(r"^\d{4}-\d{2}$"), made(F.concat(text, F.lit("-01")), month))
        .when(text.rlike(r"^\d{4}$"), made(F.concat(text, F.lit("-01-01")), F.lit("year")))
        .when(known.isNotNull(), known)
        .when(status != "released", made(fallback, F.lit("unknown")))
    )


def index_date(raw: Column) -> Column:
    """Struct of date (ISO) and precision of a date as sources write it; null if it can't be read."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", ""), r"(?i)\s*(GMT|UTC?|Z)$", " +0000")
    day = F.coalesce(F.try_to_timestamp(text).cast("date"), *[F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in DATE_FORMATS]).cast("string")
    made = lambda d, p: F.struct(d.alias("date"), F.lit(p).alias("precision"))
    return F.when(text.rlike(r"^\d{4}$"), made(F.concat(text, F.lit("-01-01")), "year")).when(text.rlike(r"^\d{4}-\d{2}$"), made(F.concat(text, F.lit("-01")), "month")).when((text != "") & day.isNotNull(), made(day, "day"))


def item_date(raw: Column, today: Column) -> Column:
    """The day of a source's date, or today's."""
    found = index_date(raw)
    return F.coalesce(found["date"], today.cast("string")).cast("date")


def with_prefix(name: Column, rules: Column) -> Column:
    """The name behind the prefix of the first rule (array of match, prefix) that matches it. Rules whose prefix has a digit or already begins the name don't count."""
    bare = F.trim(name)
    fits = lambda r: (F.trim(r["prefix"]) != "") & ~r["prefix"].rlike("[0-9]") & ~F.lower(bare).startswith(F.lower(F.trim(r["prefix"]))) & F.regexp_like(bare, F.concat(F.lit("(?i)"), r["match"]))
    return F.when(bare == "", bare).otherwise(F.concat(F.coalesce(F.get(F.filter(rules, fits), 0)["prefix"], F.lit("")), bare))
