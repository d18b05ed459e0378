"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Bucket k of its sketch keeps the least value of the k-th hash function over the
set, compressed to the count of leading zeros (6 bits) and the ten bits after the first one. Four registers make a band; documents that
share a band are candidates. The share of equal registers, corrected for registers that are equal by accident, estimates the Jaccard
similarity; candidates far below the threshold (``sigmas`` standard errors) end there. The rest are verified on the full sets.

Copies and hot groups: documents with equal sets are one class, and only classes are compared. In a band's group of up to ``few`` classes all
pairs are candidates. A larger group has a center, the member that shares most bands with others, and groups of one center are joined. Each
member is verified against the center, and the components of these links are found. A link only matters between different components, so a
member that is in its center's component is done: a cluster of n near copies costs about n comparisons, whatever else its groups hold. The
members that are left over are compared with all members of their center by edits E(x), the symmetric difference of x and c: E(a) and E(b) differ just
where a and b do, so a join on edits with prefix, length and positional filters finds the pairs. Members of one component that share an edit meet
another component through the loosest bounds among them, and only components that may be linked there are compared member by member. No
link between components is lost in this. Pairs grow with the product of two clusters only where both are in reach of a link and no center joins them.

A pair at similarity 0.85 shares no band with probability 2e-8, and the estimate rules it out with probability below 1e-11.

Components are found by alternating large-star and small-star steps on tables. Nothing but counts comes to the driver.

Defined cases: a text without words (or null) has an empty set, is linked with nothing and is kept. With fewer than five words the whole sequence is
the one shingle. Rows are documents, known by a digest of doc_id and text: equal rows fall into one class; rows that share a doc_id but not a
text stay apart until a link joins them; a null doc_id has links like any other, and its component's id is the least that isn't null. Other
columns are ignored by ``components`` and kept by ``keep_one``, which leaves one row of each component: that of the least doc_id, nulls last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, row_key, stash, struct_of, unused, word_hashes, words_of

SHINGLE = 5
BANDS, ROWS = 24, 4
BUCKETS = BANDS * ROWS
MANTISSA = 10
_rng = np.random.default_rng(20_240_229)
_MUL = (_rng.integers(0, 1 << 32, BUCKETS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, BUCKETS, np.uint64).astype(np.uint32)[:, None]
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    width = min(SHINGLE, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        s += h[k : k + len(s)] * _TURN[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def registers(values: np.ndarray) -> np.ndarray:
    """BUCKETS 16-bit registers of a set that isn't empty."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(least, (_MUL * low[k : k + 4096] + _ADD).min(axis=1), out=least)
    zeros = 32 - np.frexp(least.astype(float))[1].astype(np.uint64)
    mantissa = (least.astype(np.uint64) << zeros & np.uint64(0x7FFFFFFF)) >> np.uint64(31 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers of sets of n and m; accidental equality has probability about accident."""
    accident = 0.7213 * 2.0**-MANTISSA * n * m / (n + m) ** 2
    return (equal / BUCKETS - accident) / (1 - accident)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, set_id (a 128-bit digest of the set; null if it is empty) and the sketch as BANDS longs."""
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), ("key", T.BinaryType()), ("n_shingles", T.LongType()), ("set_id", T.BinaryType()), ("sketch", T.ArrayType(T.LongType())))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            n, ids, found = [], [], []
            for text in b["text"]:
                s = shingles(text)
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(registers(s).view(np.int64) if len(s) else None)
            yield {"doc_id": b["doc_id"], "key": b["key"], "n_shingles": n, "set_id": ids, "sketch": found}

    return map_lists(docs.select("doc_id", "text", row_key().alias("key")), run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and the full set of each row of ``wanted`` (set_id, key)."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"set_id": b["set_id"], "set": [shingles(t).tobytes() for t in b["text"]]}

    found = docs.select(row_key().alias("key"), "text").join(wanted, "key").groupBy("set_id").agg(F.first("text").alias("text"))
    return map_lists(found, run, struct_of(("set_id", T.BinaryType()), ("set", T.BinaryType())))


def likely(pairs: DataFrame, classes: DataFrame, percent: int, sigmas: float = 7.0) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule the threshold out."""
    t = percent / 100
    least = t - sigmas * (t * (1 - t) / BUCKETS) ** 0.5
    side = lambda x: classes.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
                n, m = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield b.select(["a", "b"]).filter(pa.array(estimate((x == y).sum(axis=1), n, m) >= least))

    # Sizes alone rule out what can't reach the threshold.
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.where(fits).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, pairs.select("a", "b").schema)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            a, b = [], []
            for p, q, x, y in zip(batch["a"], batch["b"], batch["set_a"], batch["set_b"], strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * common >= percent * (len(u) + len(v) - common):
                    a.append(p)
                    b.append(q)
            yield {"a": a, "b": b}

    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_lists(both.select("a", "b", "set_a", "set_b"), run, struct_of(("a", T.BinaryType()), ("b", T.BinaryType())))


def connect(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of all nodes of ``links`` (a, b)."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    # Rounds end where the edges stay the same: their number, and a sum of 64-bit hashes.
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    was = digest(edges)
    while True:
        # Large star: each node hands its larger neighbours to the least of its neighbourhood.
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: each node hands its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        new = stash(small, "edges")
        if (now := digest(new)) == was:
            break
        edges, was = new, now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def edits(members: DataFrame, sets: DataFrame, salts: int = 16) -> DataFrame:
    """``members`` (center, set_id, score) with the sizes n and n_center of their sets, and their symmetric difference.

    A center's set comes first in each of ``salts`` parts of its group, and its members stream past it, so it isn't copied to their rows.
    """
    schema = struct_of(("center", T.BinaryType()), ("set_id", T.BinaryType()), ("score", T.LongType()), ("n", T.LongType()), ("n_center", T.LongType()), ("edits", T.ArrayType(T.LongType())))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, v = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            for center, set_id, score, data in zip(batch["center"], batch["set_id"], batch["score"], batch["set"], strict=True):
                u = np.frombuffer(data, np.uint64)
                if set_id is None:
                    at, v = center, u
                    continue
                if center != at:
                    raise RuntimeError("a member without its center")
                for name, value in zip(schema.names, (center, set_id, score, len(u), len(v), np.setxor1d(u, v, assume_unique=True).view(np.int64)), strict=True):
                    out[name].append(value)
            yield out

    salt = F.pmod(F.hash("set_id"), F.lit(salts))
    rows = members.join(sets, "set_id").select("center", "set_id", "score", "set", salt.alias("salt"))
    heads = rows.select("center", "salt").distinct().join(sets.select(F.col("set_id").alias("center"), "set"), "center").select("center", F.lit(None).cast("binary").alias("set_id"), F.lit(None).cast("long").alias("score"), "set", "salt")
    both = rows.unionByName(heads).repartition("center", "salt").sortWithinPartitions("center", "salt", F.asc_nulls_first("set_id"))
    return map_lists(both.select("center", "set_id", "score", "set"), run, schema)


def edit_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``found`` (center, set_id, component, apart, n, edits) with one center that may be linked, of different components; a is apart from the center.

    With k = (100 - percent) / (100 + percent), x and y are linked if |x ^ y| <= k (|x| + |y|), that is if they share at least
    (|E(x)| + |E(y)| - k (|x| + |y|)) / 2 edits. As x isn't linked to the center that is more than (1 - k) |E(y)| / 2.
    """
    k = (100 - percent) / (100 + percent)
    tokens = found.select("center", "set_id", "component", "apart", "n", F.size("edits").alias("e"), F.explode("edits").alias("edit"))
    mixed = tokens.groupBy("center", "edit").agg(F.count("*").alias("times"), F.max("apart").alias("probed"), (F.min("component") != F.max("component")).alias("mixed")).where("probed and mixed")
    rarest = Window.partitionBy("center", "set_id").orderBy("times", "edit")  # the edits of one member
    ranked = tokens.join(mixed.select("center", "edit", "times"), ["center", "edit"], "left").withColumn("rank", F.row_number().over(rarest) - 1).where("times is not null")
    # A pair needs have_a + want_b >= 0 and have_b + want_a >= 0 at their first shared edit, and sizes that differ by what may be edited.
    e, n = F.col("e"), F.col("n")
    ranked = stash(ranked.select("center", "edit", "set_id", "component", "apart", (e - 2 * F.col("rank") + k * n).alias("have"), (k * n - e).alias("want"), (k * n + e).alias("most"), (F.col("rank") <= e - F.greatest(F.lit(1), F.ceil((1 - k) / 2 * e - 1e-9))).alias("prefix")), "edits")
    bounds = ("have", "want", "most")
    named = lambda df, x: df.select("center", "edit", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("center", "edit", "apart", "prefix")])
    reach = lambda df: df.groupBy("center", "edit", "component").agg(*[F.max(c).alias(c) for c in bounds])
    sums = (("have_a", "want_b"), ("have_b", "want_a"), ("most_a", "want_b"), ("most_b", "want_a"))
    fits = reduce(Column.__and__, [F.col(x) + F.col(y) >= -1e-6 for x, y in sums])
    left, right = ranked.where("apart"), ranked.where("prefix")
    meet = named(reach(left), "a").join(named(reach(right), "b"), ["center", "edit"]).where((F.col("component_a") != F.col("component_b")) & fits).select("center", "edit", "component_a", "component_b")
    pairs = meet.join(named(left, "a"), ["center", "edit", "component_a"]).join(named(right, "b"), ["center", "edit", "component_b"]).where(fits)
    return pairs.select(F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b")).distinct()


def all_pairs(members: DataFrame, *group: str) -> DataFrame:
    """The pairs (a, b) of ``members`` (group, set_id) of one group; for groups of a few."""
    left, right = members.select(*group, F.col("set_id").alias("a")), members.select(*group, F.col("set_id").alias("b"))
    return left.join(right, [*group]).where("a < b").select("a", "b").distinct()


def hot_pairs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to centers, as (a, b) with b the least of a's component, and further candidates. members: center, set_id, score; the center is no member of its own."""
    k = (100 - percent) / (100 + percent)
    found = stash(edits(members, sets), "edits")
    linked = F.size("edits") <= k * (F.col("n") + F.col("n_center")) + 1e-9
    roots = stash(connect(found.where(linked).select(F.col("center").alias("a"), F.col("set_id").alias("b"))), "roots")
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    placed = found.select("center", "set_id").join(root("set_id"), "set_id", "left").join(root("center"), "center", "left").withColumn("component", F.coalesce("set_id_root", "set_id"))
    placed = stash(placed.select("center", "set_id", "component", (F.coalesce("center_root", "center") != F.col("component")).alias("apart")), "placed")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if placed.where("apart").isEmpty():
        return stars, stars.limit(0)
    # Only members of a center that has others apart from it are needed.
    wanted = placed.join(placed.where("apart").select("center").distinct(), "center", "left_semi")
    return stars, edit_pairs(found.join(wanted, ["center", "set_id"]), percent)


def candidate_pairs(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, few: int = 8, salts: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full sets, links to centers, candidates) of classes (set_id, sketch) that share a band. ``sets_of`` gives the full sets of set_ids."""
    # A band's group may be hot: its members are spread over ``salts`` parts wherever they meet what is known of the group.
    salt = F.pmod(F.hash("set_id"), F.lit(salts)).alias("salt")
    spread = lambda groups: groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bands = classes.select("set_id", F.posexplode("sketch").alias("band", "key"), salt)
    groups = bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = stash(bands.join(spread(groups), ["band", "key", "salt"]), "members")
    sets = stash(sets_of(members.select("set_id").distinct()), "sets")

    pairs = all_pairs(members.where(F.col("size") <= few), "band", "key")
    score = members.groupBy("set_id").agg(F.sum("size").alias("score"))
    large = stash(members.where(F.col("size") > few).join(score, "set_id"), "large")
    if large.isEmpty():
        return sets, pairs.limit(0), pairs
    centers = large.groupBy("band", "key").agg(F.max(F.struct("score", "set_id")).alias("top")).select("band", "key", F.col("top.set_id").alias("center"))
    grouped = large.join(spread(centers), ["band", "key", "salt"]).where("set_id <> center").select("center", "set_id", "score").distinct()
    stars, more = hot_pairs(grouped, sets, percent)
    return sets, stars, pairs.unionByName(more).distinct()


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept and component (the digest that stands for the component, null for empty sets) of every row."""
    rows = stash(sketches(docs), "sketches")
    full = rows.where("n_shingles > 0")
    classes = stash(full.groupBy("set_id").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    sets, stars, pairs = candidate_pairs(classes, lambda wanted: full_sets(docs, wanted.join(classes, "set_id").select("set_id", "key")), percent)
    roots = connect(stars.unionByName(verify(likely(pairs, classes, percent), sets, percent)))

    named = classes.select("set_id", "doc_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(least, "root").select("set_id", "component_id", F.col("root").alias("component"))
    linked = full.select("doc_id", "key", "n_shingles", "set_id").join(of_set, "set_id").select("doc_id", "key", "n_shingles", "component_id", "component")
    alone = rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component, with all columns of ``docs``; documents without words all stay."""
    key, once = unused(docs, "_key", "_once")
    found = components(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias(key)
    chosen = found.where("component is not null").groupBy("component").agg(first).select(key, F.lit(True).alias(once))
    empty = found.where("component is null").select(F.col("key").alias(key), F.lit(False).alias(once)).distinct()
    kept = docs.withColumn(key, row_key()).join(chosen.unionByName(empty), key)
    number = F.when(F.col(once), 0).otherwise(F.monotonically_increasing_id())  # equal rows of a component are one
    return kept.withColumn(once, number).dropDuplicates([key, once]).select(*docs.columns)
