"""Alignment of two tokenizers: groups of tokens that end together, and links between tokens that share bytes.

Python only tokenises. It gives stretches of text, each with two arrays of ids and two of byte ends, and each text as a list of stretches. A stretch
is white space and what follows up to the next white space: neither tokenizer runs over its start, so ends, groups and links of a text are
those of its stretches, and a stretch that a batch of texts holds many times is aligned once. From there on Spark's array functions do the work. The ends
that ``array_intersect`` finds in both arrays cut a stretch into groups. Where every end is shared, tokens pair off by their index. In a short stretch each place
where a token ends is looked up on either side. In a long one, all ends, each with its own index, are sorted into one array; an end of A at place p with index i has p - i ends of B before it, and so names the token
of B that covers it, and the reverse. Each end but the shared ones of B is a link, as the shortest pieces between ends lie in one token of either side.

A pair's count is the number of documents that hold it linked, over the corpus. The counts are a table: its ``head_rows`` most frequent pairs at most are broadcast
(a threshold from a histogram of counts keeps to that bound at every size), and only links of the pairs beyond it are shuffled, after they
were summed up by document and pair. No pair of that tail is frequent, so none is a hot key.

A long text is cut into blocks of about ``block_chars`` at stretches, so the arrays of a row are bounded; its blocks are put together again at the end.
Texts with white space other than spaces and line ends are one stretch.

Defined cases: null and empty texts, and texts whose joined tokens differ from space + text on either side, have no tokens: zeros, and '' for
the digest. Rows are documents: repeated and null doc_ids each get their row, and each counts as a document. Other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ability_engine.llm.common import let, stash, struct_of

#: The ranks hold the merges of byte_bpe_50k.json: a test compares both.
RANKS_A, TOKENIZER_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BLOCK_CHARS, BATCH_CHARS, MEMO = 100_000, 4_000_000, 250_000
_MASK = 0x7FFFFFFF
#: Up to so many tokens of both sides, looking each one up costs less than sorting.
SHORT = 24
#: White space, and what follows up to the next.
STRETCH, DOUBLE = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[ \n][ \n]")
#: Other white space, which tokenizers may join with a space before it.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


class Pieces:
    """The piece model. No piece of it holds a space after another sign, or a line end, which is checked at the start."""

    def __init__(self, name: str = TOKENIZER_B):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) or len(self.model.encode("\n")) != 2 or len(pieces) > 1 << 16:
            raise ValueError(f"{name}: its pieces cross spaces")
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they are: the model puts a space before what it encodes, unless that is empty, but none after a line end."""
        spaced = [len(t) > 1 and t[0] == " " for t in texts]
        found = self.model.encode([t[1:] if s else "\n" + t for s, t in zip(spaced, texts, strict=True)], num_threads=1)
        return [ids if s else ids[2:] for s, ids in zip(spaced, found, strict=True)]


class Both(dict):
    """Encodes stretches with both tokenizers. As a dict: a number for each stretch seen lately; ``a`` and ``b`` have its ids by that number.

    A stretch is spelled without its space where it is one space and what follows. ``bad`` are those whose tokens don't give the bytes back.
    """

    def __init__(self) -> None:
        super().__init__()
        ranks = {base64.b64decode(token): int(k) for token, k in map(bytes.split, open(public_tokenizers.path(RANKS_A), "rb"))}
        self.a_merges = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = sorted(ranks, key=ranks.get)
        self.a_lengths = np.array([len(b) for b in self.a_bytes], np.int32)
        self.pieces = Pieces()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.a: list[bytes] = []
        self.b: list[bytes] = []
        self.bad: set[int] = set()

    def __missing__(self, stretch: str) -> int:
        n = self[stretch] = len(self)
        self.fresh.append(stretch)
        return n

    def learn(self) -> None:
        """Encode the stretches that were asked for since the last call."""
        texts = [s if s[0] in " \n" else " " + s for s in self.fresh]
        self.fresh = []
        encode = self.a_merges.encode_ordinary
        for text, ids in zip(texts, self.pieces.encode(texts), strict=True):
            found = encode(text)
            if not text.isascii():
                data = text.encode("utf-8", "surrogatepass")
                if b"".join(map(self.a_bytes.__getitem__, found)) != data or b"".join(map(self.pieces.bytes.__getitem__, ids)) != data:
                    self.bad.add(len(self.a))
            self.a.append(array("H", found).tobytes())
            self.b.append(array("H", ids).tobytes())


_BOTH: list[Both] = []


def both() -> Both:
    """One pair of encoders for each Python worker."""
    if not _BOTH:
        _BOTH.append(Both())
    return _BOTH[0]


_INTS = T.ArrayType(T.IntegerType(), False)
_SIDES = struct_of(*[(n, _INTS) for n in ("a", "a_ends", "b", "b_ends")])


def stretches(text: str | None) -> list[str]:
    """The stretches of space + text: spelled without the space where that is all the white space before it."""
    if not text:
        return []
    if OTHER_SPACE.search(text):
        return [" " + text]
    if DOUBLE.search(text) or text[0] in " \n" or text[-1] in " \n":
        return [s[1:] if s[0] == " " and len(s) > 1 and s[1] not in " \n" else s for s in STRETCH.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)), type=pa.list_(pa.field("element", pa.int32(), False)))


def _sides(ids: list[bytes], lengths: np.ndarray) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
    """Ids, ends within the stretch, and the number of tokens, by stretch."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
    flat = np.frombuffer(b"".join(ids), np.uint16)
    ends = np.cumsum(lengths[flat])
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], ends])[first]
    return _lists(flat, sizes), _lists(ends - np.repeat(before, sizes), sizes), sizes


def tokenize(docs: DataFrame, block_chars: int = BLOCK_CHARS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Batches of texts: the distinct stretches with ids and ends of both sides, and the texts (or blocks of long ones) as places of their stretches."""
    texts = struct_of(("doc", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("n_blocks", T.IntegerType()), ("block", T.IntegerType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("places", _INTS))
    schema = struct_of(("stretches", T.ArrayType(_SIDES, False)), ("texts", T.ArrayType(texts, False)))
    arrow = to_arrow_schema(schema)

    def pack(rows: list[tuple[int, int, int, np.ndarray]], doc_id: pa.Array) -> pa.RecordBatch:
        known, at = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        a, a_ends, n_a = _sides([both().a[k] for k in known], both().a_lengths)
        b, b_ends, n_b = _sides([both().b[k] for k in known], both().pieces.lengths)
        sizes = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(sizes)
        sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(n[at])])[np.concatenate([[0], ends])]), pa.int64()) for n in (n_a, n_b)]
        columns = [pa.array([r[0] for r in rows], pa.int64()), doc_id, *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)], *sums, _lists(at, sizes)]
        inner = [pa.StructArray.from_arrays(c, fields=list(arrow.field(n).type.value_field.type)) for n, c in (("stretches", [a, a_ends, b, b_ends]), ("texts", columns))]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c, type=arrow.field(k).type) for k, c in enumerate(inner)]
        if len(both()) > MEMO:
            both().forget()
        return pa.RecordBatch.from_arrays(whole, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, np.ndarray]] = []
        ids: list[pa.Array] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, memo = batch.slice(at, 16), both()
                texts = part.column("text").to_pylist()
                places = [np.array(list(map(memo.__getitem__, stretches(t))), np.int32) for t in texts]
                memo.learn()
                for k, (doc, text, found) in enumerate(zip(part.column("doc").to_pylist(), texts, places, strict=True)):
                    if memo.bad and not memo.bad.isdisjoint(found.tolist()):
                        found = found[:0]
                    width = len(text or "")
                    held += width
                    step = max(1, len(found) * block_chars // width if width > block_chars else len(found))
                    blocks = [found[j : j + step] for j in range(0, len(found), step)] or [found]
                    rows += [(doc, len(blocks), j, block) for j, block in enumerate(blocks)]
                    ids += [part.column("doc_id").slice(k, 1)] * len(blocks)
                if held > batch_chars:
                    yield pack(rows, pa.concat_arrays(ids))
                    rows, ids, held = [], [], 0
        if rows:
            yield pack(rows, pa.concat_arrays(ids))

    return docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text").mapInArrow(run, schema)


def _range(first: Column, last: Column, ids: Column) -> Column:
    return F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(ids, k).cast("string")), ",")


def align_stretch(s: Column, size_b: int) -> Column:
    """struct(groups: text, n_groups, links: A id * ``size_b`` + B id of each overlapping pair) of a stretch."""
    a, b = s["a"], s["b"]
    made = lambda groups, n, links: F.struct(groups.alias("groups"), n.alias("n_groups"), links.alias("links"))

    def paired(n: Column) -> Column:
        texts = F.transform(a, lambda x, k: F.concat(x.cast("string"), F.lit("|"), F.get(b, k).cast("string")))
        return made(F.array_join(texts, ";"), n, F.transform(a, lambda x, k: x * size_b + F.get(b, k)))

    def short(shared: Column) -> Column:
        """Few tokens: which end is shared, and which token covers a place, are looked up one by one."""

        def side(ids: Column, ends: Column) -> Column:
            texts = F.transform(ids, lambda x, k: F.concat(x.cast("string"), F.when(F.exists(shared, lambda e: e == F.get(ends, k)), ";").otherwise(",")))
            return F.split(F.array_join(texts, ""), ";")

        def at(ids: Column, ends: Column, place: Column) -> Column:
            return F.get(ids, F.size(F.filter(ends, lambda e: e < place)))

        # Both sides end with a shared end, so an empty text comes after the last group on either.
        groups = F.zip_with(side(a, s["a_ends"]), side(b, s["b_ends"]), lambda x, y: F.when(x != "", F.concat(x, F.lit("|"), y)))
        places = F.array_union(s["a_ends"], s["b_ends"])
        return made(F.array_join(groups, ";"), F.size(shared), F.transform(places, lambda u: at(a, s["a_ends"], u) * size_b + at(b, s["b_ends"], u)))

    def mark(ends: Column, tag: int) -> Column:
        return F.transform(ends, lambda e, k: F.shiftleft(e.cast("long"), 32).bitwiseOR((k + F.lit(tag)).cast("long")))

    def merged(n: Column) -> Column:
        own = lambda m: m.bitwiseAND(_MASK).cast("int")

        def of_marks(marks: Column) -> Column:
            def link(m: Column, place: Column) -> Column:
                shared = F.shiftright(F.get(marks, place - 1), 32) == F.shiftright(m, 32)
                of_a = F.shiftright(m, 31).bitwiseAND(1) == 0
                return F.when(of_a, F.get(a, own(m)) * size_b + F.get(b, place - own(m))).when(shared, F.lit(-1)).otherwise(F.get(a, place - own(m)) * size_b + F.get(b, own(m)))

            def of_links(links: Column) -> Column:
                # Places of the shared ends of B. The mark there names the last token of B in the group, and its place that of A.
                cuts = F.filter(F.sequence(F.lit(0), F.size(links) - 1), lambda p: F.get(links, p) < 0)

                def group(cuts: Column) -> Callable[[Column, Column], Column]:
                    def text(place: Column, k: Column) -> Column:
                        before = F.coalesce(F.get(cuts, k - 1), F.lit(-1))
                        last_b = own(F.get(marks, place))
                        first_b = F.when(k == 0, F.lit(0)).otherwise(own(F.get(marks, before)) + 1)
                        return F.concat(_range(before + 1 - first_b, place - last_b - 1, a), F.lit("|"), _range(first_b, last_b, b))

                    return text

                groups = let(cuts, lambda c: F.array_join(F.transform(c, group(c)), ";"))
                return made(groups, n, F.filter(links, lambda x: x >= 0))

            return let(F.transform(marks, link), of_links)

        return let(F.sort_array(F.concat(mark(s["a_ends"], 0), mark(s["b_ends"], 1 << 31))), of_marks)

    few = F.size(a) + F.size(b) <= SHORT
    several = let(F.array_intersect(s["a_ends"], s["b_ends"]), lambda shared: F.when(few, short(shared)).otherwise(merged(F.size(shared))))
    return F.when(s["a_ends"] == s["b_ends"], paired(F.size(a))).otherwise(several)


def align(tokens: DataFrame, size_b: int = 32_000) -> DataFrame:
    """doc, doc_id, n_blocks, block, n_a, n_b, n_groups, groups (text) and links of each text of ``tokenize``."""
    # An explode of one row keeps the stretches' results out of the lambdas that read them.
    known = F.explode(F.array(F.transform("stretches", lambda s: align_stretch(s, size_b)))).alias("known")

    def whole(t: Column) -> Column:
        n_groups = F.aggregate(t["places"], F.lit(0).cast("long"), lambda n, p: n + F.get("known", p)["n_groups"])
        groups = F.array_join(F.transform(t["places"], lambda p: F.get("known", p)["groups"]), ";")
        links = F.flatten(F.transform(t["places"], lambda p: F.get("known", p)["links"]))
        return F.struct(*[t[n].alias(n) for n in ("doc", "doc_id", "n_blocks", "block", "n_a", "n_b")], n_groups.alias("n_groups"), groups.alias("groups"), links.alias("links"))

    return tokens.select("texts", known).select(F.inline(F.transform("texts", whole)))


def head_threshold(counts: DataFrame, rows: int) -> int:
    """The least count from which on ``counts`` has ``rows`` rows at most, by a histogram with 16 steps a doubling."""
    histogram = counts.groupBy(F.floor(F.log2("count") * 16).alias("step")).count().collect()  # 16 x 64 rows at most
    held, least = 0, math.inf
    for step, n in sorted((tuple(r) for r in histogram), reverse=True):
        held += n
        if held > rows:
            break
        least = step
    return 1 << 62 if least == math.inf else math.ceil(2 ** (least / 16) - 1e-9)


def report(docs: DataFrame, head_rows: int = 400_000, block_chars: int = BLOCK_CHARS, size_b: int = 32_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    whole = F.col("n_blocks") == 1
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    links = stash(
        align(tokenize(docs, block_chars), size_b).select(
            "doc", "doc_id", "n_blocks", "block", "n_a", "n_b", "n_groups",
            F.when(whole, digest).alias("digest"), F.when(~whole, F.col("groups")).alias("groups"), "links",
        ),
        "links",
    )
    each = links.select("doc", "n_blocks", F.explode(F.array_distinct("links")).alias("pair"))
    # A pair counts once for a document, whatever its blocks are.
    pairs = each.where(whole).select("pair").unionAll(each.where(~whole).select("doc", "pair").distinct().select("pair"))
    counts = stash(pairs.groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    of_a = F.floor(F.col("pair") / size_b).cast("int")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("highest"))  # one row for each id of A's vocabulary: at most 50,257
    marked = counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    least = head_threshold(counts, head_rows)
    head, tail = marked.where(F.col("count") >= least), marked.where(F.col("count") < least)

    found = links.select("doc", F.explode("links").alias("pair")).join(F.broadcast(head), "pair", "left")
    rest = F.when(F.col("count").isNull(), F.col("pair")).alias("rest")
    sums = stash(found.groupBy("doc", rest).agg(F.sum("count").alias("count_sum"), F.sum("best").alias("n_best"), F.count("*").alias("n_links")), "sums")
    rare = sums.where("rest is not null").select("doc", F.col("rest").alias("pair"), "n_links").join(tail, "pair")
    rare = rare.select("doc", (F.col("count") * F.col("n_links")).alias("count_sum"), (F.col("best") * F.col("n_links")).alias("n_best"), "n_links")
    parts = sums.where("rest is null").select("doc", "count_sum", "n_best", "n_links").unionByName(rare)
    zero = F.lit(None).cast("long")
    shape = links.select(
        "doc", "doc_id", "n_a", "n_b", "n_groups", "digest", F.when(~whole, F.struct("block", "groups")).alias("block"), *[zero.alias(n) for n in ("count_sum", "n_best", "n_links")]
    )
    nothing = [F.lit(None).cast(links.schema["doc_id"].dataType).alias("doc_id"), *[zero.alias(n) for n in ("n_a", "n_b", "n_groups")], F.lit(None).cast("string").alias("digest"), F.lit(None).cast(shape.schema["block"].dataType).alias("block")]
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda b: b["groups"]), ";").cast("binary"), 256)
    rows = shape.unionByName(parts.select("doc", *nothing, "count_sum", "n_best", "n_links")).groupBy("doc")
    return rows.agg(F.max("doc_id").alias("doc_id"), *map(total, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce(F.max("digest"), joined).alias("groups_sha256")).drop("doc")
