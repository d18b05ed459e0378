"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame operations only.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). Its tokens are its shingles of three words (of fewer, where the
window has fewer). A document that contains a window contains all of its shingles, so one token is prefix enough: shingles are ordered by how
often the corpus has them, and only the rarest shingle of each window joins the documents' shingles. Its place fixes where the window would
lie; candidates that would stick out of the document are dropped (positional and length bounds). The rest, about as many as there are hits, are
verified word by word against the text.

One scan finds the places of all shingles of the benchmark in the corpus, which are written down: they give the counts, hence the order, and the
candidates. The documents themselves are never shuffled while the candidates are few: shingles, anchors and candidates are broadcast only up to
``broadcast_rows`` rows, counted first on a written table; beyond that Spark shuffles the join. A hot shingle or item never gathers rows of
different documents in one group: they are grouped by a digest of the row.

Defined cases: a null or empty text has no words and no hits. An item without words has no windows. Rows are documents: equal rows get equal
results, repeated and null doc_ids are kept apart by their texts. Repeated item_ids count once; a window whose item_ids are all null is found and
counts in n_hit, but not in n_items. Other columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ability_engine.llm.common import row_key, stash, unused

WIDTH, SHINGLE = 10, 3
#: Fixed value: what separates words once A-Z is lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The written table ``df``, to be broadcast if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _few(found: DataFrame, most: int) -> DataFrame:
    """The written candidates, to be broadcast if they are ``most`` windows at most over all rows."""
    total = found.agg(F.sum(F.size("candidates"))).first()[0] or 0
    return F.broadcast(found) if total <= most else found


def shingles(array: Column, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` words; candidates from a collision fail verification."""
    starts = F.sequence(F.lit(0), F.size(array) - size)
    hashes = F.transform(starts, lambda k: F.xxhash64(*[F.get(array, k + i) for i in range(size)]))
    return F.when(F.size(array) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, phrase (the window's words, joined by spaces)."""
    items = benchmark.select("item_id", words().alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    phrases = F.transform(starts, lambda k: F.array_join(F.slice(F.col("words"), k + 1, F.lit(width)), " "))
    return items.select("item_id", F.explode(F.array_distinct(phrases)).alias("phrase"))


def tokens(phrases: DataFrame, width: int) -> DataFrame:
    """phrase, size, at and token: the shingles of each window and their places in it."""
    split = phrases.select("phrase", F.split("phrase", " ").alias("w")).withColumn("size", F.size("w"))
    out = []
    for n in range(1, SHINGLE + 1):
        some = split.where(F.col("size") >= n if n == SHINGLE else F.col("size") == n)
        out.append(some.select("phrase", "size", F.posexplode_outer(shingles(F.col("w"), n)).alias("at", "token")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def candidates(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 200_000) -> DataFrame:
    """key (row_key) and the windows (start, size, phrase) that a row may contain, as a written table."""
    grams = stash(tokens(windows(benchmark, width).select("phrase").distinct(), width), "grams")
    vocabulary = _small(stash(grams.select("token").distinct(), "vocabulary"), broadcast_rows)
    short = [r["size"] for r in grams.where(F.col("size") < SHINGLE).select("size").distinct().collect()]  # 1 and 2 at most
    keyed = docs.select(row_key().alias("key"), words().alias("w")).select("key", F.size("w").alias("n"), *[shingles(F.col("w"), n).alias(f"s{n}") for n in (*short, SHINGLE)])
    # An outer explode: the filter that Spark infers for an inner one would split the text again for each shingle.
    runs = [keyed.select("key", "n", F.posexplode_outer(f"s{n}").alias("place", "token")) for n in (*short, SHINGLE)]
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    places = stash(every.join(vocabulary, "token"), "places")

    counts = places.groupBy("token").agg(F.count("*").alias("n"))
    ranked = grams.join(counts, "token", "left").groupBy("phrase", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("least"))
    anchors = _small(stash(ranked.where("least.n > 0").select("least.token", "least.at", "size", "phrase"), "anchors"), broadcast_rows)
    start = F.col("place") - F.col("at")
    found = places.join(anchors, "token").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    return stash(found.groupBy("key").agg(F.collect_set(F.struct(start.alias("start"), F.col("size").alias("size"), "phrase")).alias("candidates")), "candidates")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, key, n_words and the verified windows of every row: an array of (start, size, phrase), or null."""
    may = _few(candidates(docs, benchmark, width, broadcast_rows), broadcast_rows)
    both = docs.select("doc_id", row_key().alias("key"), words().alias("words")).join(may, "key", "left")
    same = F.filter("candidates", lambda c: F.array_join(F.slice(F.col("words"), c["start"] + 1, c["size"]), " ") == c["phrase"])
    return both.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("candidates").isNotNull(), same).alias("found"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    covered = F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1)))
    n_hit = F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")
    phrases = F.when(F.size("found") > 0, F.array_distinct(F.transform("found", lambda m: m["phrase"])))
    rows = stash(matches(docs, benchmark, width).select("doc_id", "key", "n_words", n_hit.alias("n_hit"), phrases.alias("phrases")), "hits")
    items = windows(benchmark, width).select("phrase", F.col("item_id").cast("string").alias("item")).where("item is not null")
    hit = rows.where("n_hit > 0").select("key", F.explode("phrases").alias("phrase")).distinct().join(items, "phrase")
    by_doc = hit.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(by_doc, "key", "left").select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without the documents that contain a window, with all their columns."""
    key, may, array = unused(docs, "_key", "_may", "_words")
    found = _few(candidates(docs, benchmark, width, broadcast_rows), broadcast_rows).select(F.col("key").alias(key), F.col("candidates").alias(may))
    # One array of words for all candidates: it comes from an explode of one row, which keeps it out of the lambda.
    both = docs.withColumn(key, row_key()).join(found, key, "left").select("*", F.explode(F.array(F.when(F.col(may).isNotNull(), words()))).alias(array))
    same = F.exists(may, lambda c: F.array_join(F.slice(F.col(array), c["start"] + 1, c["size"]), " ") == c["phrase"])
    return both.where(F.col(may).isNull() | ~same).select(*docs.columns)
