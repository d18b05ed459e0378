"""Ingestion: page text and links, keys, change detection, merging, promotion, verification and evaluation, and the fold of traffic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named entities and their signs.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "times": "×", "deg": "°", "laquo": "«", "raquo": "»",
    "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£",
}
#: Tiers of the cadence, the slowest first: id, visitors a day from which it holds, hours between runs.
TIERS = (("weekly", 0, 168), ("often", 3, 72), ("daily", 10, 24), ("twice-daily", 30, 12), ("frequent", 100, 6))


def _decoded(text: Column, pattern: str, sign: Callable[[Column], Column]) -> Column:
    """Text with what the pattern's group 1 names replaced by its sign: the text between them, and the signs, are joined again."""

    def one(t: Column) -> Column:
        signs = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda n: F.coalesce(sign(n), F.lit("")))
        joined = F.array_join(F.zip_with(F.split(t, pattern), signs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return F.get(F.transform(F.array(text), one), 0)  # the text is evaluated once


def _of_code(code: Column, base: int) -> Column:
    """The sign of a code point, through the four bytes of UTF-32; null where there is none."""
    n = F.conv(F.when(F.length(code) <= 9, code).otherwise(F.lit("7")), base, 10).cast("long")
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & (F.length(code) <= 9)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Hexadecimal, then decimal, then named entities (in any case). Codes of no sign go, unknown names stay."""
    signs = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    text = _decoded(text, "&#[xX]([0-9a-fA-F]+);", lambda c: _of_code(c, 16))
    text = _decoded(text, "&#([0-9]+);", lambda c: _of_code(c, 10))
    return _decoded(text, f"(?i)&({'|'.join(ENTITIES)});", lambda n: signs[F.lower(n)])


def html_to_text(html: Column) -> Column:
    """Comments, scripts and styles go, block tags become line ends, other tags spaces; white space is folded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "svg", "head"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|br)[^>]*>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href and title of every anchor."""
    anchor = r"(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("title"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("pos", "pair"))
    return rows.select("page_id", "pos", F.col("pair.href").alias("href"), html_to_text(F.col("pair.title")).alias("title"))


def fingerprint(items: DataFrame, by: str, key: str) -> DataFrame:
    """SHA-256 of the sorted keys of a source, whose list of items is that of one page."""
    return items.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(key)), "\n").cast("binary"), 256).alias("hash"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/:?#]+)", 1))


def host_matches(url: Column, allowed: tuple[str, ...]) -> Column:
    """The host is one of ``allowed`` or a subdomain of one."""
    found = F.lit(False)
    for h in allowed:
        found = found | (host(url) == h) | host(url).endswith(f".{h}")
    return found


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", "-"), r"^[-.]+|[-.]+$", "")


def name_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", "")


def release_id(lab: Column, name: Column) -> Column:
    return F.concat(lab, F.lit("-"), slug(name))


def valid_release_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-z0-9]+(-[a-z0-9.]+)+$"), F.lit(False))


def number_spellings(value: Column) -> Column:
    """How a number may be written: whole if it is, with one or two decimals, rounded."""
    whole = F.floor(value + 0.5).cast("long").cast("string")
    return F.array(whole, F.format_string("%.1f", value), F.format_string("%.2f", value))


def quote_contains_value(quote: Column, value: Column) -> Column:
    """A spelling of the number, or the number as it is written shortest, occurs in the quote, thousands separators aside."""
    bare = F.regexp_replace(F.coalesce(quote, F.lit("")), r"(\d),(?=\d)", "$1")
    spelled = F.concat(number_spellings(value), F.array(F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")))
    return F.exists(spelled, lambda s: bare.contains(s))


def iso_time(at: Column) -> Column:
    """A time to the second, as the data write it; the session's time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_date(text: Column) -> Column:
    """The day of a strict ISO date; anything else ends the query."""
    bad = F.raise_error(F.concat(F.lit("no date: "), F.coalesce(text, F.lit("null")))).cast("date")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(bad)


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters, cut at their last space if that is in the last tenth, and marked as cut."""
    cut = F.substring(text, 1, most)
    space = most - F.instr(F.reverse(cut), " ")
    at_space = F.substring(text, F.lit(1), space.cast("int"))
    whole = F.when((F.instr(cut, " ") > 0) & (space > most * 0.9), at_space).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(whole, F.lit("\n[...truncated]")))


def json_content(text: Column) -> Column:
    """The JSON of an answer: as it is, out of a fenced block, or from the first brace to the last; null if none can be parsed."""
    trim = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    bare = trim(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in (bare, trim(fenced), braced)])


def new_items(items: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key wasn't seen before, each key once (first by pos)."""
    fresh = items.join(seen.select(*key).distinct(), key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min("pos").alias("pos"))
    return fresh.join(first, [*key, "pos"])


def merge_upsert(published: DataFrame, incoming: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer merge: key, value after, and what happened (added, updated, kept). Incoming rows must be one for each key."""
    old, new = published.select(*key, F.col(value).alias("_old")), incoming.select(*key, F.col(value).alias("_new"))
    both = old.join(new, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")), "updated").otherwise("kept")
    return both.select(*key, F.coalesce("_new", "_old").alias(value), action.alias("action"))


def promote(published: DataFrame, researched: DataFrame, key: list[str]) -> DataFrame:
    """Published rows, and the researched ones whose key isn't published yet."""
    return published.unionByName(researched.join(published.select(*key), key, "left_anti"))


def evaluation(gold: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Matches, gold and found rows, precision and recall, over all and by lab (null: all), in one pass."""
    both = gold.select("lab", *key, F.lit(1).alias("g")).join(found.select("lab", *key, F.lit(1).alias("f")), ["lab", *key], "full_outer")
    sums = both.rollup("lab").agg(F.count("g").alias("gold"), F.count("f").alias("found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("matched"))
    ratio = lambda a: F.coalesce(F.try_divide(F.col("matched"), F.col(a)), F.lit(0.0))
    return sums.withColumns({"precision": ratio("found"), "recall": ratio("gold")})


def gates(metrics: DataFrame, precision: float = 0.95, recall: float = 0.85) -> DataFrame:
    """The metrics with the names of the gates that fail."""
    fails = F.array(F.when(F.col("recall") < recall, F.lit("recall")), F.when(F.col("precision") < precision, F.lit("precision")))
    names = F.array_compact(fails)
    return metrics.withColumns({"failed": F.array_join(names, ","), "passed": F.size(names) == 0})


def daily_visitors(visits: DataFrame, salt: str = "") -> DataFrame:
    """Distinct salted hashes by day. Distinct pairs are shuffled by (day, hash), so a busy day is spread over tasks."""
    hashed = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("day").cast("string"), F.lit(":"), F.col("address")).cast("binary"), 256), 1, 12)
    return visits.where(F.col("class") == "visit").select("day", hashed.alias("visitor")).distinct().groupBy("day").agg(F.count("*").alias("visitors"))


def mean_visitors(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last ``days`` closed days up to each day, to two decimals. One row for each day."""
    trailing = Window.orderBy("day").rowsBetween(1 - days, 0)
    return daily.withColumn("mean_visitors", F.round(F.avg("visitors").over(trailing), 2))


def tier_level(visitors: Column) -> Column:
    """Place of the tier that so many visitors a day call for; 0 is the slowest."""
    out = F.lit(0)
    for k, (_, least, _) in enumerate(TIERS):
        out = F.when(visitors >= least, k).otherwise(out)
    return out


def _of_tier(visitors: Column, which: int) -> Column:
    return F.get(F.array(*[F.lit(t[which]) for t in TIERS]), tier_level(visitors))


def tier_for(visitors: Column) -> Column:
    return _of_tier(visitors, 0)


def interval_hours(visitors: Column) -> Column:
    return _of_tier(visitors, 2)


def hysteresis(daily: DataFrame, patience: int = 2) -> DataFrame:
    """day and level: up at once, down only after ``patience`` closed days in a row below. daily: day, target; a row for each day."""
    rows = daily.agg(F.array_sort(F.collect_list(F.struct("day", "target"))).alias("rows"))
    first = F.struct(F.lit(0).alias("level"), F.lit(0).alias("below"), F.array().cast("array<struct<day:date,level:int>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        below = F.when(row["target"] < acc["level"], acc["below"] + 1).otherwise(0)
        level = F.when(row["target"] >= acc["level"], row["target"]).when(below >= patience, row["target"]).otherwise(acc["level"])
        out = F.concat(acc["out"], F.array(F.struct(row["day"].alias("day"), level.alias("level"))))
        return F.struct(level.alias("level"), F.when(below >= patience, 0).otherwise(below).alias("below"), out.alias("out"))

    return rows.select(F.explode(F.aggregate("rows", first, step, lambda acc: acc["out"])).alias("r")).select("r.day", "r.level")
