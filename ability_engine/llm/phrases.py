"""Collocations: phrases of two to five words that stay together more often than their parts would by chance.

Counting goes level by level, over tries that each task builds for shards of about ``shard_words`` words. A phrase is frequent (``least`` occurrences) only if
the phrases within it are, so pairs are counted only of frequent words, and longer phrases only along frequent pairs. Which these are, a task looks up
in a bitmap of fixed size: a wrong hit costs work and changes nothing, as every count is whole when it is compared with ``least``.

A shard's trie is the sorted array of its windows; nodes are where a prefix of one length begins. It is serialised in preorder (words, levels, counts), a
row for each range of first words, those with the same first four signs. Rows are dealt out by ranges of (language, prefix) and sorted, so a task meets the rows of one
prefix from all shards next to each other and merges their nodes level by level: it holds the rows of one prefix, or of some small ones, at a time. Hot words (more
than one in ``hot_share`` of all words, so there are no more than that many) are prefixes of their own, dealt out over 32 parts by their next word, and hot pairs once more.

The frequent nodes are then walked once more in order, which gives the counts of all left parts of a phrase. Its right parts are its suffix links: the
node without the first word, and so on, found by a join of all links with the nodes. A phrase is dropped where a node one word longer, whose
parent or suffix link it is, has its count; longer ones need no look, as counts only fall along the way.

Defined cases: null text is empty, null lang is `und`. Rows are documents: repeated and null doc_ids count each time. A word may hold any sign but
separators, spaces and tabs. An empty table, and languages without frequent phrases, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ability_engine.llm.common import new_path, scratch, stash, struct_of

DEPTH, LEAST, TOP = 5, 100, 2000
SHARD_WORDS, HOT_SHARE, PARTS = 3_000_000, 1_000, 32
#: Signs that the first words of one range share.
LEAD = 4
#: Nodes that are merged at once, if they don't all have one prefix.
CHUNK = 150_000
BITS = 1 << 26
#: The signs that end a piece; between words, tabs are as spaces.
_SIGNS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
NODES = struct_of(("lang", T.StringType()), ("prefix", T.StringType()), ("part", T.IntegerType()), ("words", T.BinaryType()), ("levels", T.BinaryType()), ("counts", T.BinaryType()))
PHRASES = struct_of(("lang", T.StringType()), ("words", T.ArrayType(T.StringType())), ("f", T.LongType()))
#: Exact: three factors of up to 38 digits together.
SCORE = "CAST(CAST(1000 AS DECIMAL(38,0)) * a * n AS DECIMAL(38,0)) DIV CAST(CAST(l AS DECIMAL(38,0)) * r AS DECIMAL(38,0))"


class Vocabulary(dict):
    """Words to numbers from 1 on; 0 is the end of a piece, -1 is nothing."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text, with 0 at the ends of pieces and of the text."""
        data = text.encode("utf-8", "surrogatepass").lower().translate(_SIGNS).replace(b"\n", b" \n ") if text else b""
        found = np.array([*map(self.__getitem__, data.split(b" ")), 0], np.int32)
        return found[found >= 0]


def _shards(docs: DataFrame, build: Callable[[str, list[bytes], np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType, shard_words: int) -> DataFrame:
    """``build`` of (language, words by number, numbers of the running text) for each language of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (vocabulary, texts) in held.items():
                words = [b"", *itertools.islice(vocabulary, 2, None)]  # in the order of their numbers
                yield from build(lang, words, np.concatenate(texts))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    if lang not in held:
                        held[lang] = Vocabulary(), []
                    vocabulary, texts = held[lang]
                    texts.append(vocabulary.numbers(text))
                    size += len(texts[-1])
                    if size >= shard_words:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, schema)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _count_words(lang: str, words: list[bytes], text: np.ndarray) -> Iterator[pa.RecordBatch]:
    counts = np.bincount(text, minlength=len(words))
    for at in range(1, len(words), 100_000):
        part = words[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), _strings(part), pa.array(counts[at : at + 100_000], pa.int64())], names=["lang", "word", "n"])


def known(bitmap: np.ndarray, lang: str, phrases: list[bytes]) -> np.ndarray:
    """Whether phrases are in the bitmap; a few may be that were never put in."""
    salt = zlib.crc32(lang.encode() + b"\0")
    bits = np.fromiter((zlib.crc32(p, salt) for p in phrases), np.int64, len(phrases)) & (BITS - 1)
    return bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 1


def bitmap(phrases: DataFrame) -> Broadcast:
    """The (lang, phrase) rows as a bitmap of ``BITS`` bits: 8 MB whatever their number is."""
    bit = F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")) % BITS + 1
    rows = phrases.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for k, bits in rows:
        out[4096 * (k - 1) : 4096 * k] = bits
    return phrases.sparkSession.sparkContext.broadcast(bytes(out))


def trie(text: np.ndarray, follows: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of up to ``depth`` words that are at least ``least`` long, sorted; and rows, levels and counts of the nodes, in preorder.

    ``follows[i]``: the word at i and the next one may be in one window. Numbers of words are in the order of the words.
    """
    alive, lengths = text > 0, (text > 0).astype(np.int8)
    for k in range(depth - 1):
        alive = alive & np.append(follows, np.zeros(len(text) - len(follows), bool))[np.minimum(np.arange(k, len(text) + k), len(text) - 1)]
        alive[len(text) - k - 1 :] = False
        lengths += alive
    starts = np.flatnonzero(lengths >= least)
    lengths = lengths[starts]
    windows = np.zeros((depth, len(starts)), np.int64)
    for k in range(depth):
        has = lengths > k
        windows[k, has] = text[starts[has] + k]
    high = windows[0] << 42 | (windows[1] << 21 if depth > 1 else 0) | (windows[2] if depth > 2 else 0)
    order = np.lexsort((windows[3] << 21 | windows[4], high)) if depth > 3 else np.argsort(high, kind="stable")
    windows = windows[:, order]
    new, counts = np.zeros((len(starts), depth), bool), np.zeros((len(starts), depth), np.int64)
    changed = np.zeros(len(starts), bool)
    changed[:1] = True
    for k in range(depth):
        changed[1:] |= windows[k, 1:] != windows[k, :-1]
        at = np.flatnonzero(changed)
        counts[at, k] = np.diff(np.append(at, len(starts)))
        new[:, k] = changed & (windows[k] > 0)
    rows, levels = np.nonzero(new)
    return windows, rows, levels, counts[rows, levels]


def _tries(lang: str, words: list[bytes], text: np.ndarray, level: int, depth: int, bits: list[np.ndarray], hot: list[set[bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of the shard's trie: nodes of ``level`` to ``depth`` words along frequent phrases of ``level`` - 1 words."""
    keep = known(bits[0], lang, words)
    keep[0] = False
    kept = sorted(np.flatnonzero(keep).tolist(), key=words.__getitem__)
    order = np.zeros(len(words), np.int64)
    order[kept] = np.arange(1, len(kept) + 1)
    names = [b"", *[words[k] for k in kept]]
    if len(names) >= 1 << 21:
        raise ValueError("too many words in a shard")
    text = order[text]
    follows = (text[:-1] > 0) & (text[1:] > 0)
    if level == 3:
        at = np.flatnonzero(follows)
        pairs, which = np.unique(text[at] << 21 | text[at + 1], return_inverse=True)
        fine = known(bits[1], lang, [names[p >> 21] + b" " + names[p & 0x1FFFFF] for p in pairs.tolist()])
        follows[at] = fine[which] if len(at) else False
    windows, rows, levels, counts = trie(text, follows, level, depth)
    if not len(rows):
        return
    # The prefix of a window is a range of first words, those with the same first signs. A hot word is a prefix of its own, dealt out by the next word; a hot pair once more.
    width = windows.shape[1]
    first = np.isin(windows[0], [k for k, w in enumerate(names) if w in hot[0]])
    again = np.zeros(width, bool)
    if level == 3:
        at = np.flatnonzero(first)
        pairs, which = np.unique(windows[0, at] << 21 | windows[1, at], return_inverse=True)
        if len(at):
            again[at] = np.array([names[p >> 21] + b" " + names[p & 0x1FFFFF] in hot[1] for p in pairs.tolist()], bool)[which]
    of = np.array([zlib.crc32(w) % PARTS for w in names])
    leads = [w.decode("utf-8", "surrogatepass")[:LEAD].encode("utf-8", "surrogatepass") for w in names]
    led = np.cumsum([0, *(a != b for a, b in itertools.pairwise(leads))])
    lengths = first.astype(np.int64) + again
    part = np.where(again, of[windows[min(level - 1, 2)]], np.where(first, of[windows[1]], -1))
    cut = np.ones(width, bool)
    head = np.where(first, windows[0], led[windows[0]])
    cut[1:] = (head[1:] != head[:-1]) | (lengths[1:] != lengths[:-1]) | again[1:] & (windows[1, 1:] != windows[1, :-1])
    runs = np.cumsum(cut) - 1
    wanted = levels >= lengths[rows]
    rows, levels, counts = rows[wanted], levels[wanted], counts[wanted]
    group = runs[rows] * (PARTS + 1) + part[rows] + 1
    if first.any():  # windows of one part are brought together, in order
        order = np.argsort(group, kind="stable")
        rows, levels, counts, group = rows[order], levels[order], counts[order], group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    edges = np.append(starts, len(group))
    spelled = windows[levels, rows]
    ends = np.concatenate([[0], np.cumsum(np.array([len(w) + 1 for w in names])[spelled])])
    lines = [w + b"\n" for w in names]
    text = b"".join(map(lines.__getitem__, spelled.tolist()))
    heads = [leads[a] if n == 0 else names[a] if n == 1 else names[a] + b" " + names[b] for a, b, n in zip(windows[0, rows[starts]].tolist(), windows[1, rows[starts]].tolist(), lengths[rows[starts]].tolist(), strict=True)]

    def binary(data: bytes, offsets: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])

    columns = [pa.array([lang] * len(starts), pa.string()), _strings(heads), pa.array(part[rows[starts]], pa.int32()), binary(text, ends[edges]), binary(levels.astype(np.uint8).tobytes(), edges), binary(counts.astype("<u4").tobytes(), 4 * edges)]
    whole = pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(NODES))
    for at in range(0, len(starts), 20_000):
        yield whole.slice(at, 20_000)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def merge(rows: list[tuple[str, str, int, bytes, bytes, bytes]], level: int, least: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, count) of the nodes of ``level`` words or more that occur ``least`` times in all rows. Rows of one prefix and part stand together.

    Level by level, nodes with one parent and one word are the same node; their counts are added.
    """
    keys = [r[:3] for r in rows]
    new = np.array([True, *(a != b for a, b in itertools.pairwise(keys))])
    group = np.cumsum(new) - 1
    heads = [keys[k] for k in np.flatnonzero(new)]
    sizes = np.array([len(r[4]) for r in rows])
    levels = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    counts = np.frombuffer(b"".join(r[5] for r in rows), "<u4").astype(np.int64)
    vocabulary = Numbers()
    words = np.array(list(map(vocabulary.__getitem__, b"".join(r[3] for r in rows).split(b"\n")[:-1])), np.int64)
    of = np.repeat(group, sizes)
    base = np.repeat(np.array([0 if r[2] < 0 else r[1].count(" ") + 1 for r in rows]), sizes)
    parents, spelled, kept = [np.full(len(heads), -1)], [np.full(len(heads), -1)], []
    node, place, count = np.zeros(len(levels), np.int64), np.arange(len(levels)), len(heads)
    for k in range(int(levels.min()), int(levels.max()) + 1):
        mine = np.flatnonzero(levels == k)
        above = np.maximum.accumulate(np.where(levels == k - 1, place, -1))[mine]
        under = np.where(base[mine] < k, node[above], of[mine])
        codes, which = np.unique(under * len(vocabulary) + words[mine], return_inverse=True)
        sums = np.bincount(which, counts[mine], len(codes)).astype(np.int64)
        node[mine] = count + which
        parents.append(codes // len(vocabulary))
        spelled.append(codes % len(vocabulary))
        if k + 1 >= level:
            kept += [(count + int(x), int(sums[x])) for x in np.flatnonzero(sums >= least)]
        count += len(codes)
    parent, spell, names = np.concatenate(parents), np.concatenate(spelled), list(vocabulary)
    for at, n in kept:
        path = []
        while parent[at] >= 0:
            path.append(names[spell[at]])
            at = parent[at]
        lang, prefix, part = heads[at]
        yield lang, [*(prefix.encode().split(b" ") if part >= 0 else []), *reversed(path)], n


def _merged(rows: DataFrame, level: int, least: int) -> DataFrame:
    """PHRASES of ``level`` words or more that occur ``least`` times, from the rows of all shards."""
    arrow = to_arrow_schema(PHRASES)

    def made(found: list[tuple[str, list[bytes], int]]) -> pa.RecordBatch:
        flat = _strings([w for _, words, _ in found for w in words])
        ends = pa.array(np.cumsum([0, *(len(words) for _, words, _ in found)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.ListArray.from_arrays(ends, flat, type=arrow.field(1).type), pa.array([x[2] for x in found], pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(n).to_pylist() for n in NODES.names], strict=True):
                if size >= CHUNK and row[:3] != held[-1][:3]:
                    yield made(list(merge(held, level, least)))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield made(list(merge(held, level, least)))

    keys = ("lang", "prefix", "part")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, PHRASES)


def _lefts(nodes: DataFrame) -> DataFrame:
    """Adds lefts, the counts of a phrase's left parts of two words or more: one walk in preorder over the nodes below each pair of words."""
    schema = T.StructType([*PHRASES.fields, T.StructField("lefts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: list[int] = [0] * (DEPTH + 1)
        for b in batches:
            lefts = []
            for words, f in zip(b.column("words").to_pylist(), b.column("f").to_pylist(), strict=True):
                walk[len(words)] = f
                lefts.append(walk[2 : len(words)])
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in PHRASES.names], pa.array(lefts, arrow.field(3).type)], schema=arrow)

    pair = F.slice("words", 1, 2)
    return nodes.repartition("lang", pair).sortWithinPartitions("lang", "words").mapInArrow(run, schema)


def frequent(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, shard_words: int = SHARD_WORDS, hot_share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, n), and (lang, words, f) of the phrases of up to ``depth`` words that occur ``least`` times."""
    spark = docs.sparkSession
    word_rows = struct_of(("lang", T.StringType()), ("word", T.StringType()), ("n", T.LongType()))
    every = _shards(docs, _count_words, word_rows, shard_words).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    # Rare words only count in their language's total.
    counted = stash(every.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f")), "words")
    totals = stash(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    level = counted.where("word is not null").select("lang", F.array("word").alias("words"), "f")
    found, hot, bits = [level], [], []
    for least_words, most_words in ((2, 2), (3, depth)):
        if most_words < least_words:
            break
        phrase = F.array_join("words", " ")
        bits.append(bitmap(level.select("lang", phrase.alias("phrase"))))
        # Hot in any language: at most ``hot_share`` phrases.
        hot.append({r[0].encode() for r in level.where(F.col("f") * hot_share > total).select(phrase).distinct().collect()})

        def build(lang: str, words: list[bytes], text: np.ndarray, a: int = least_words, b: int = most_words, bits: list = list(bits), hot: list = list(hot)) -> Iterator[pa.RecordBatch]:
            return _tries(lang, words, text, a, b, [np.frombuffer(x.value, np.uint8) for x in bits], hot)

        path = new_path(spark, "phrases")
        with scratch(spark):  # the tries go once they are merged
            rows = stash(_shards(docs, build, NODES, shard_words), "tries")
            _merged(rows, least_words, least).write.parquet(path)
        level = spark.read.schema(PHRASES).parquet(path)
        found.append(level)
    for b in bits:  # what was made with them is written
        b.destroy()
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return totals, nodes


def mine(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, shard_words: int = SHARD_WORDS, hot_share: int = HOT_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    totals, nodes = frequent(docs, least, depth, shard_words, hot_share)
    phrase = F.array_join("words", " ")
    counts = nodes.select("lang", phrase.alias("phrase"), "f")
    several = stash(_lefts(nodes.where(F.size("words") > 1)), "walked")
    size = F.size("words")
    # Whole where a node one word longer begins or ends with it and is as frequent.
    longer = several.where(size > 2).select("lang", F.explode(F.array(F.array_join(F.slice("words", 1, size - 1), " "), F.array_join(F.slice("words", 2, size - 1), " "))).alias("phrase"), "f")
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    open_ = several.withColumn("phrase", phrase).join(covered, ["lang", "phrase"], "left").where("longest is null or longest < f")
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("first_f"))
    led = open_.withColumn("first", F.get("words", F.lit(0))).join(first, ["lang", "first"])
    cut = led.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), F.concat(F.array("first_f"), "lefts").alias("lefts"))
    link = F.array_join(F.slice("words", F.col("k") + 1, size), " ")
    linked = cut.select("lang", "phrase", "a", "k", F.get("lefts", F.col("k") - 1).alias("l"), link.alias("rest")).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = linked.join(totals, "lang").select("lang", "phrase", "a", "n", F.struct(F.expr(SCORE).alias("score"), "k", "l", "r").alias("cut"))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
