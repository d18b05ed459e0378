"""A backfill's work queue as rounds of joins: pages of candidates are read in the order of a queue that grows while it is worked off.

A round takes all entries of one depth. An overview page enqueues the announcements that it links to for the candidate's name; an extraction that
only lacks a date enqueues one more try through the lab's news. An address is enqueued once in a lab, by the first entry that finds it. An entry whose
release has landed by then is skipped. Labs are independent but for the budget, which is spent in the order of labs and of their queues. As a queue
is worked off by depth, a round is joins and one order by lab; only as many rounds are needed as a page's links are followed (about five).

Nulls: an entry without an address is unreadable, one without a name lands nothing and finds no links. An empty table of candidates gives empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.operators.ingest import name_key
from ability_engine.operators.screening import is_overview, launch_posts, rank_links, url_key, with_official

#: Fixed value: the reason that earns another try.
NO_DATE = "no usable date"
ENTRY = ("lab", "pos", "name", "url", "date", "official", "from_overview", "retried")


def _settled(df: DataFrame) -> DataFrame:
    """An eager checkpoint where the session has a folder for it, so that rounds don't add up in the plan."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _skipped(entries: DataFrame, landing: DataFrame, landed: DataFrame) -> DataFrame:
    """(lab, pos) of entries whose key has landed before their turn: in ``landed`` (lab, key), or by an earlier entry of ``landing`` (lab, pos, key) that isn't skipped itself.

    Whether an entry is skipped depends on earlier ones alone, so repeating the step ends at the walk's answer, after as many steps as names land one after another.
    """
    keyed = entries.select("lab", "pos", "key")
    before = keyed.join(landed, ["lab", "key"], "left_semi").select("lab", "pos")
    skipped = before
    while True:
        first = landing.join(skipped, ["lab", "pos"], "left_anti").groupBy("lab", "key").agg(F.min("pos").alias("_first"))
        after = _settled(keyed.join(first, ["lab", "key"]).where("_first < pos").select("lab", "pos").unionByName(before).distinct())
        if after.count() == skipped.count() and after.join(skipped, ["lab", "pos"], "left_anti").isEmpty():
            return after
        skipped = after


def walk(candidates: DataFrame, pages: DataFrame, links: DataFrame, answers: DataFrame, news: DataFrame, hosts: DataFrame, known: DataFrame, budget: int, most_links: int = 3) -> tuple[DataFrame, DataFrame]:
    """(visits, releases) of a backfill that stops once ``budget`` pages were extracted.

    candidates: lab, pos, name, url, date, official; pages: url of each page that could be read; links: url, n, link (see ``screening.announcement_links``);
    answers: url, answer_pos, release, reason (null where it was kept); news: lab, pos, title, link, date; hosts: lab, host; known: lab, name of published releases.
    A visit has its depth, its place in the lab's queue and a status: skipped, unreadable, expanded, no link, extracted, retry, nothing or stopped. A
    release has lab, release, url and the candidate's name: the first one of its key that lands.
    """
    readable = pages.select("url").distinct().withColumn("_read", F.lit(True))
    order = Window.partitionBy("lab").orderBy("parent", "place")  # a lab's queue, light rows
    first = candidates.select("lab", F.col("pos").alias("parent"), F.lit(0).alias("place"), "name", "url", "date", "official", F.lit(None).cast("string").alias("from_overview"), F.lit(False).alias("retried"))
    front = _settled(first.withColumn("pos", F.row_number().over(order).cast("long")).select(*ENTRY, "parent"))
    seen = front.select("lab", url_key(F.col("url")).alias("url_key")).distinct()
    landed = known.select("lab", name_key(F.col("name")).alias("key")).distinct()
    visits, lands, depth = [], [], 0
    while depth == 0 or not front.isEmpty():
        keyed = front.withColumn("key", name_key(F.col("name"))).join(readable, "url", "left")
        kind = F.when(F.col("_read").isNull(), "unreadable").when(is_overview(F.col("url")), "overview").otherwise("page")
        entries = _settled(keyed.withColumn("kind", kind).drop("_read"))
        low, release = F.lower("name"), F.lower("release")
        asked = entries.where("kind = 'page'").select("lab", "pos", "name", "url", "retried").join(answers, "url")
        fits = F.col("reason").isNull() & ((release == low) | ((release != "") & F.contains(low, release)))
        asked = _settled(asked.withColumns({"_kept": F.coalesce(fits, F.lit(False)), "_key": name_key(F.col("release"))}))
        kept = asked.where("_kept").select("lab", "pos", F.col("_key").alias("key"), "release", "url", "name", "answer_pos")
        skipped = _skipped(entries, kept.select("lab", "pos", "key"), landed)
        live = entries.join(skipped, ["lab", "pos"], "left_anti")
        got = kept.join(skipped, ["lab", "pos"], "left_anti")
        lands.append(got.withColumn("depth", F.lit(depth)))

        ident = F.concat_ws("|", F.col("lab").cast("string"), F.col("pos").cast("string"))
        over = live.where("kind = 'overview'").withColumn("name_id", ident)
        best = rank_links(over.select("name_id", "name", "url").join(links, "url").select("name_id", "name", F.col("n").alias("pos"), F.col("link").alias("url")), most_links)
        mined = over.select(*ENTRY, "name_id").withColumnRenamed("url", "_from").join(best.select("name_id", "url", "place"), "name_id")
        mined = mined.select("lab", F.col("pos").alias("parent"), "place", "name", "url", "date", F.col("_from").alias("from_overview"), "retried")
        dateless = asked.groupBy("lab", "pos").agg(F.max("_kept").alias("_any"), F.coalesce(F.bool_or(F.col("reason") == NO_DATE), F.lit(False)).alias("_late"))
        again = live.where("kind = 'page' and not retried").join(dateless.where("_late and not _any"), ["lab", "pos"]).withColumn("name_id", ident)
        post = launch_posts(again.select("name_id", "lab", "name"), news, again.select("name_id", url_key(F.col("url")).alias("url_key")))
        tried = again.select("lab", F.col("pos").alias("parent"), "name", F.col("date").alias("_date"), "from_overview", "name_id").join(post, "name_id")
        tried = tried.select("lab", "parent", F.lit(1).alias("place"), "name", F.col("link").alias("url"), F.coalesce("date", "_date").alias("date"), "from_overview", F.lit(True).alias("retried"))

        children = mined.unionByName(tried).withColumn("url_key", url_key(F.col("url"))).join(seen, ["lab", "url_key"], "left_anti")
        once = F.row_number().over(Window.partitionBy("lab", "url_key").orderBy("parent", "place"))
        fresh = with_official(children.withColumn("_n", once).where("_n = 1"), hosts)
        last = front.groupBy("lab").agg(F.max("pos").alias("_last"))
        numbered = fresh.join(last, "lab").withColumn("pos", F.row_number().over(order) + F.col("_last"))
        following = _settled(numbered.select(*ENTRY, "parent", "url_key"))

        parents = following.select("lab", F.col("parent").alias("pos")).distinct().withColumn("_grew", F.lit(True))
        won = got.select("lab", "pos").distinct().withColumn("_won", F.lit(True))
        gone = skipped.withColumn("_gone", F.lit(True))
        marked = reduce(lambda df, flag: df.join(flag, ["lab", "pos"], "left"), (parents, won, gone), entries)
        status = (
            F.when(F.col("_gone"), "skipped").when(F.col("kind") == "unreadable", "unreadable").when(F.col("kind") == "overview", F.when(F.col("_grew"), "expanded").otherwise("no link"))
            .when(F.col("_won"), "extracted").when(F.col("_grew"), "retry").otherwise("nothing")
        )
        spends = (F.col("kind") == "page") & F.col("_gone").isNull()
        visits.append(marked.select(*ENTRY, F.lit(depth).alias("depth"), F.when(F.lit(depth > 0), F.col("parent")).alias("parent"), status.alias("status"), spends.cast("long").alias("spent")))
        seen = _settled(seen.unionByName(following.select("lab", "url_key")))
        landed = _settled(landed.unionByName(got.select("lab", "key")).distinct())
        front, depth = following.drop("url_key"), depth + 1
    return _within(reduce(DataFrame.unionByName, visits), reduce(DataFrame.unionByName, lands), known, budget)


def _within(visits: DataFrame, lands: DataFrame, known: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The walk up to the place where the budget is spent: what was in the queue then is stopped, what would have come of it never was."""
    of_lab = visits.groupBy("lab").agg(F.sum("spent").alias("_all"))
    ahead = of_lab.select("lab", F.coalesce(F.sum("_all").over(Window.orderBy("lab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row for each lab
    queue = Window.partitionBy("lab").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = visits.withColumn("_before", F.coalesce(F.sum("spent").over(queue), F.lit(0))).join(ahead, "lab")
    placed = _settled(placed.withColumn("_out", F.col("_before") + F.col("_ahead") >= budget).drop("_before", "_ahead"))
    out: Column = F.col("_out")
    worked = placed.where(~out).select("lab", F.col("pos").alias("parent"))
    queued = placed.where("depth = 0").unionByName(placed.where("depth > 0").join(worked, ["lab", "parent"], "left_semi").select(*placed.columns))
    rows = queued.withColumn("status", F.when(out, "stopped").otherwise(F.col("status"))).select(*ENTRY, "depth", "status")
    mine = lands.join(placed.where(~out).select("lab", "pos"), ["lab", "pos"], "left_semi").join(known.select("lab", name_key(F.col("name")).alias("key")), ["lab", "key"], "left_anti")
    first = F.min_by(F.struct("release", "url", "name"), F.struct("pos", "answer_pos"))
    return rows, mine.groupBy("lab", "key").agg(first.alias("r")).select("lab", "r.*")
