"""The conservative merge of extracted releases into published ones: nothing is overwritten, statuses only advance, dates only get more precise.

Incoming rows of one model meet their published row by (lab, key of the name). What several of them do to it is a fold in their order over the few rows that name
one model in one batch; everything else is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.operators.ingest import name_key, release_id, valid_release_id
from ability_engine.operators.screening import precision_rank

#: Ranks of statuses; the highest suffix of an id.
STATUS_RANK = {"cancelled": -1, "rumored": 1, "announced": 2, "released": 3}
LAST_SUFFIX = 19


def status_rank(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])[status]


def allocate_ids(new: DataFrame, used: DataFrame) -> DataFrame:
    """``new`` (lab, pos, name) with an id: that of lab and name, or the first free one of -2 to -19; null if there is none or it isn't valid. used: lab, id.

    Ids are given in the order of pos, one lab at a time; only the ids that may collide (the same base, or a base with a number) come along. Stems are read one after
    another in sorted partitions, those taken before those new, so a stem costs its rows and no call of its own.
    """
    based = new.withColumn("_base", release_id(F.col("lab").cast("string"), F.col("name")))
    stem = lambda c: F.regexp_replace(c, r"(-\d{1,2})+$", "")
    rows = based.where(valid_release_id(F.col("_base"))).withColumn("_stem", stem(F.col("_base")))
    taken = used.select(F.col("lab").cast(new.schema["lab"].dataType), F.col("id").alias("_id"), stem(F.col("id")).alias("_stem")).where("_id is not null")
    near = taken.join(rows.select("lab", "_stem").distinct(), ["lab", "_stem"], "left_semi")
    new_columns = new.columns
    both = near.unionByName(rows, allowMissingColumns=True).select("lab", "_stem", "_id", "_base", *[c for c in new_columns if c != "lab"])
    together = both.repartition("lab", "_stem").sortWithinPartitions("lab", "_stem", F.col("_id").isNull(), F.asc_nulls_last("pos"))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gone = None, set()
        for batch in batches:
            at, ids = [], []
            for k, (lab, stem_, id_, base) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lab", "_stem", "_id", "_base")], strict=True)):
                if (lab, stem_) != last:
                    last, gone = (lab, stem_), set()
                if id_ is None:
                    id_ = next((x for x in (base, *(f"{base}-{n}" for n in range(2, LAST_SUFFIX + 1))) if x not in gone), None)
                    at.append(k)
                    ids.append(id_)
                gone.add(id_)
            yield pa.RecordBatch.from_arrays([*batch.select(new_columns).take(pa.array(at, pa.int64())).columns, pa.array(ids, pa.string())], [*new_columns, "id"])

    given = together.mapInArrow(give, T.StructType([*new.schema.fields, T.StructField("id", T.StringType())]))
    return given.unionByName(based.where(~F.coalesce(valid_release_id(F.col("_base")), F.lit(False))).select(*new_columns, F.lit(None).cast("string").alias("id")))


def merge_releases(published: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases after, changes). Both: lab, name, status, date (ISO), date_precision, tier; published also id, incoming also pos (its order, unique in a lab).

    changes: lab, id, pos, kind, summary. An incoming name without letters or digits is left out. Of new rows of one name the first is added, and
    the others are merged into it.
    """
    fields = ("status", "date", "date_precision", "tier")
    keyed = incoming.withColumn("key", name_key(F.col("name"))).where("key <> ''")
    old = published.withColumn("key", name_key(F.col("name")))
    first = keyed.groupBy("lab", "key").agg(F.min_by(F.struct("pos", "name", *fields), "pos").alias("f")).join(old.select("lab", "key"), ["lab", "key"], "left_anti")
    added = allocate_ids(first.select("lab", "f.*", "key"), published.select("lab", "id")).where("id is not null")
    base = old.select("lab", "id", "name", *fields, "key", F.lit(None).cast(incoming.schema["pos"].dataType).alias("added_at")).unionByName(added.select("lab", "id", "name", *fields, "key", F.col("pos").alias("added_at")))

    rows = keyed.groupBy("lab", "key").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("rows"))
    both = base.join(rows, ["lab", "key"], "left")
    later = F.filter(F.coalesce("rows", F.array().cast(both.schema["rows"].dataType)), lambda r: F.col("added_at").isNull() | (r["pos"] > F.col("added_at")))
    none = F.array().cast(f"array<struct<pos:{incoming.schema['pos'].dataType.simpleString()},kind:string,summary:string>>")
    state = F.struct(*[F.col(f) for f in fields], none.alias("changes"))

    def fold(acc: Column, r: Column) -> Column:
        finer = precision_rank(r["date_precision"]) > precision_rank(acc["date_precision"])
        precision = F.when(finer, r["date_precision"]).otherwise(acc["date_precision"])
        onward = (acc["status"] != "cancelled") & (r["status"] != "cancelled") & (status_rank(r["status"]) > status_rank(acc["status"])) & ~((r["status"] == "released") & (precision == "unknown"))
        fill = acc["tier"].isNull() & F.coalesce(r["tier"].isin("mid", "small"), F.lit(False))
        note = lambda when, kind, text: F.when(when, F.struct(r["pos"].alias("pos"), F.lit(kind).alias("kind"), text.alias("summary")))
        dated = lambda x: F.concat(x["date"], F.lit(" ("), x["date_precision"], F.lit(")"))
        notes = F.array_compact(
            F.array(
                note(onward, "status_changed", F.concat(acc["status"], F.lit(" -> "), r["status"])),
                note(finer, "release_updated", F.concat(F.lit("date "), dated(acc), F.lit(" -> "), dated(r))),
                note(fill, "release_updated", F.concat(F.lit("tier "), r["tier"])),
            )
        )
        return F.struct(F.when(onward, r["status"]).otherwise(acc["status"]).alias("status"), F.when(finer, r["date"]).otherwise(acc["date"]).alias("date"), precision.alias("date_precision"), F.when(fill, r["tier"]).otherwise(acc["tier"]).alias("tier"), F.concat(acc["changes"], notes).alias("changes"))

    merged = both.withColumn("m", F.aggregate(later, state, fold))
    after = merged.select("lab", "id", "name", *[F.col(f"m.{f}").alias(f) for f in fields])
    new = merged.where("added_at is not null").select("lab", "id", F.col("added_at").alias("pos"), F.lit("release_added").alias("kind"), F.concat_ws(" ", "name", "status", "date").alias("summary"))
    changed = merged.select("lab", "id", F.explode("m.changes").alias("c")).select("lab", "id", "c.pos", "c.kind", "c.summary")
    return after, new.unionByName(changed)


def merge_scores(published: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming scores (release_id, pos, benchmark, config, value) whose (release, benchmark, config) isn't published; each once, the first by pos."""
    blank = lambda df: df.withColumn("config", F.coalesce("config", F.lit("")))
    key = ["release_id", "benchmark", "config"]
    fresh = blank(incoming).join(blank(published).select(*key).distinct(), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min_by("value", "pos").alias("value"))


def replace_scores(published: DataFrame, found: DataFrame) -> DataFrame:
    """Full merge by (release_id, benchmark): the found value wins; action says added, replaced (with the old value) or kept. Found rows must be one for each key."""
    key = ["release_id", "benchmark"]
    both = published.select(*key, F.col("value").alias("old")).join(found.select(*key, F.col("value").alias("new")), key, "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNotNull() & (F.col("new") != F.col("old")), "replaced").otherwise("kept")
    return both.select(*key, F.coalesce("new", "old").alias("value"), F.when(action == "replaced", F.col("old")).alias("old"), action.alias("action"))


def _plain(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


def merge_run(published: DataFrame, scores: DataFrame, sources: DataFrame, incoming: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(releases, scores, sources, changes) after a batch: releases and scores merge together, and a page that changed something becomes a source.

    published and incoming as in ``merge_releases``; incoming also url, of the page that it was read from. scores: release_id, benchmark, config, value; sources: release_id,
    pos, url; found: lab, pos (of the incoming row), score_pos, benchmark, config, value. A score goes in where its benchmark and configuration aren't there yet, the first by
    (pos, score_pos). A page is added once to a release, after its other sources, if one of its rows created it, added a score, moved its status or its date; a tier alone doesn't count.
    """
    after, changes = merge_releases(published, incoming)
    keyed = lambda df: df.withColumn("key", name_key(F.col("name")))
    rows = keyed(incoming).select("lab", "pos", "key", "url").join(keyed(after).select("lab", "key", F.col("id").alias("release_id")), ["lab", "key"]).select("lab", "pos", "url", "release_id")
    blank = lambda df: df.withColumn("config", F.coalesce("config", F.lit("")))
    key = ["release_id", "benchmark", "config"]
    first = F.min_by(F.struct("lab", "pos", "value"), F.struct("pos", "score_pos")).alias("s")
    fresh = blank(found).join(rows, ["lab", "pos"]).join(blank(scores).select(*key).distinct(), key, "left_anti").groupBy(*key).agg(first).select(*key, "s.*")
    made = changes.where("kind = 'release_added'").select("lab", F.col("id").alias("release_id"), "pos")
    setting = F.when(F.col("config") != "", F.concat(F.lit(" ("), "config", F.lit(")"))).otherwise(F.lit(""))
    scored = fresh.join(made, ["lab", "release_id", "pos"], "left_anti")
    noted = scored.select("lab", F.col("release_id").alias("id"), "pos", F.lit("score_added").alias("kind"), F.concat("benchmark", F.lit(" "), _plain(F.col("value")), setting).alias("summary"))
    every = changes.unionByName(noted)
    touched = every.where("kind <> 'release_updated' or summary like 'date %'").select("lab", F.col("id").alias("release_id"), "pos").distinct()
    pages = touched.join(rows, ["lab", "release_id", "pos"]).where("url is not null").groupBy("release_id", "url").agg(F.min("pos").alias("_by")).join(sources.select("release_id", "url"), ["release_id", "url"], "left_anti")
    held = sources.groupBy("release_id").agg((F.max("pos") + 1).alias("_next"))
    order = Window.partitionBy("release_id").orderBy("_by", "url")  # the new pages of one release
    placed = pages.join(held, "release_id", "left").select("release_id", (F.coalesce("_next", F.lit(0)) + F.row_number().over(order) - 1).cast(sources.schema["pos"].dataType).alias("pos"), "url")
    return after, blank(scores).select(*key, "value").unionByName(fresh.select(*key, "value")), sources.select("release_id", "pos", "url").unionByName(placed), every
