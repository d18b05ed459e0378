"""Document fingerprints by spot signatures, in DataFrame operations only.

Spots are common short words: the ``words`` of up to ``ANCHOR_CHARS`` characters that most documents of a language hold, counted over the corpus, for the ``langs``
languages with the most documents; so the list has a fixed size. Each occurrence of a spot, with the ``CHAIN`` content words (no spots) that follow it,
is a signature; so is the start of the text with its first words. A fingerprint is the set of the signatures' 32-bit hashes, in order, as hex.

With p the place of a spot and k the number of spots before it, p - k content words come before it. So the chain after it is read from the list of content
words by index, and a text costs one pass.

Sets are compared by Jaccard similarity, pruned by length: sets are dealt to length partitions whose bounds are powers of 1 / ``floor``. Where partitions aren't
next to each other, or the lengths alone keep the similarity below ``floor``, the sets aren't compared and the likeness is 0.

Which document comes next: keys are range-partitioned and sorted; within a partition a window names the next key, and the first key of each partition is the
next of the last one before it, from a table of one row for each partition. A document sends its first characters and its fingerprint to the one before it.

Defined cases: a null text is the empty text. Equal rows (doc_id and text) are one document for the order, and each gets its row. Rows of one doc_id and
different texts are ordered by a digest; a null doc_id comes first. A text without words has an empty fingerprint; two of these are alike (1). A
single document is its own next one. Other columns are ignored; without a column lang, all texts are one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ability_engine.llm.common import let, row_key, stash
from ability_engine.llm.decontaminate import words

ANCHOR_CHARS, CHAIN, FLOOR = 5, 2, 0.1
WIDTH = 8


def anchors(docs: DataFrame, count: int = 20, langs: int = 50) -> list[str]:
    """The ``count`` most common short words of each of the ``langs`` most common languages: at most their product."""
    lang = F.coalesce("lang", F.lit("und")) if "lang" in docs.columns else F.lit("und")
    short = F.array_distinct(F.filter(words(), lambda w: F.length(w) <= ANCHOR_CHARS))
    held = docs.select(lang.alias("lang"), F.explode(short).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    largest = docs.groupBy(lang.alias("lang")).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(langs)
    return sorted({r[0] for r in top.join(F.broadcast(largest), "lang").select("word").collect()})


def signatures(text: Column, spots: list[str]) -> Column:
    """The sorted set of a text's signatures, 8 hex digits each."""
    digest = lambda *parts: F.left(F.md5(F.concat_ws(" ", *parts).cast("binary")), F.lit(WIDTH))
    is_spot = lambda w: w.isin(spots) if spots else F.lit(False)

    def of(w: Column) -> Column:
        def chains(content: Column) -> Column:
            places = F.filter(F.transform(w, lambda x, p: F.when(is_spot(x), p)), lambda p: p.isNotNull())
            return F.transform(places, lambda p, k: digest(F.get(w, p), *[F.get(content, p - k + d) for d in range(CHAIN)]))

        start = digest(F.lit("^"), *[F.get(w, F.lit(d)) for d in range(CHAIN)])
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(F.concat(F.array(start), let(F.filter(w, lambda x: ~is_spot(x)), chains))))).otherwise(F.array().cast("array<string>"))

    return let(words(text), of)


def as_set(fingerprint: Column) -> Column:
    """The signatures of a fingerprint (hex)."""
    n = (F.length(fingerprint) / WIDTH).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.substring(fingerprint, k * WIDTH + 1, F.lit(WIDTH)))).otherwise(F.array().cast("array<string>"))


def length_partition(n: Column, floor: float = FLOOR) -> Column:
    """Sets of partitions that aren't next to each other have a similarity below ``floor``."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1 / floor)) + 1e-12)


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard similarity of two sets; 0 where their lengths keep it below ``floor``, 1 for two empty sets."""
    n, m = F.size(a), F.size(b)
    far = (F.abs(length_partition(n, floor) - length_partition(m, floor)) > 1) | (F.least(n, m) < floor * F.greatest(n, m))
    both = F.size(F.array_intersect(a, b))
    compared = let(both, lambda c: c.cast("double") / (n + m - c))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(far, F.lit(0.0)).otherwise(compared)


def previous(docs: DataFrame) -> DataFrame:
    """key, before (key of the document before it; of the first one, the last) and before_chars (the characters of that one)."""
    keys = docs.select("doc_id", row_key().alias("key"), F.length(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id", "key").agg(F.max("n").alias("n"))
    held = stash(keys, "keys").repartitionByRange("doc_id", "key")
    placed = stash(held.select(F.struct("doc_id", "key", "n").alias("at"), F.spark_partition_id().alias("part")), "placed")
    # One row for each partition.
    ends = placed.groupBy("part").agg(F.max("at").alias("last"))
    bounds = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy())).alias("carried"))
    within = placed.withColumn("before", F.lag("at").over(Window.partitionBy("part").orderBy("at")))
    named = within.join(F.broadcast(bounds), "part").withColumn("before", F.coalesce("before", "carried"))
    return named.select("at.key", F.col("before.key").alias("before"), F.col("before.n").alias("before_chars"))


def report(docs: DataFrame, count: int = 20, langs: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs``."""
    spots = anchors(docs, count, langs)
    text = F.coalesce("text", F.lit(""))
    hexed = lambda s: F.array_join(s, "")
    rows = docs.select(row_key().alias("key"), F.struct("doc_id", text.alias("text"), F.unhex(hexed(signatures("text", spots))).alias("spots")).alias("d"))
    base = rows.groupBy("key").agg(F.first("d").alias("d"), F.count("*").alias("copies"))
    sent = base.where("copies > 0").join(previous(docs), "key").select(F.col("before").alias("key"), F.left(F.col("d.text"), F.floor(F.col("before_chars") / 4).cast("int")).alias("first"), F.col("d.spots").alias("next_spots"))
    n = F.length("d.text")
    cut = F.floor(n / 4).cast("int")
    edited = base.join(sent, "key").select("d.doc_id", "copies", n.cast("long").alias("n_chars"), F.concat(F.left(F.col("d.text"), n - cut), "first").alias("text"), F.lower(F.hex("d.spots")).alias("fingerprint"), F.lower(F.hex("next_spots")).alias("next"))
    # Explodes of one row keep the sets out of the expressions that read them several times.
    sets = F.explode(F.array(F.struct(as_set(F.col("fingerprint")).alias("own"), signatures("text", spots).alias("edited"), as_set(F.col("next")).alias("next")))).alias("s")
    out = edited.select("doc_id", "copies", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", sets)
    near = [likeness(F.col("s.own"), F.col(f"s.{x}")).alias(f"near_{x}") for x in ("edited", "next")]
    result = out.select("doc_id", "copies", "n_chars", "edited_sha256", "fingerprint", hexed(F.col("s.edited")).alias("edited_fingerprint"), *near)
    return result.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), *[c for c in result.columns if c != "copies"]).drop("copy")
