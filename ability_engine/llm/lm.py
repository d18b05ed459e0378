"""Language-model scores by a weighted backoff automaton over all n-grams of up to three tokens.

Tokens are words (A-Z lowered, split at ASCII white space) and one end for each document, which also stands before its first word. A word's
probability after the context s is smoothed by that after the context without its first word, s', with a hierarchical Dirichlet prior:
p(w | s) = (c(sw) + k p(w | s')) / (c(s) + k), and p(w) = (c(w) + 1) / (N + V + 1) at the root. Every c(s) is the sum of its c(sw), so the
probabilities of all words, one unknown word included, add up to one after any context.

In the automaton the states are the contexts that the corpus has: the root, words and word pairs. A state has an arc of log10 p(w | s) for each w
that followed it, and a failure arc of log10 (k / (c(s) + k)) to the state without its first word. One traversal from left to right carries the
state: where it has no arc for the next token it fails down, level by level, and the logarithms are added up on the way.

Counts go through Spark whole: no n-gram is cut, however rare, and what is gathered grows with the corpus. Documents are taken in chunks of about
``CHUNK`` tokens. A chunk sends its distinct n-grams (as sorted 64-bit hashes, in packed ranges) with its training counts through one shuffle; a
range is summed over all chunks, and each chunk is sent back its counts, by which the task that holds the chunk builds that part of the
automaton that its documents can reach. A frequent n-gram crosses the shuffle once a chunk, so there is no hot key. Only N and V come to the driver.

Defined cases: null and empty texts are the end alone. Rows are documents; a repeated doc_id is scored each time. With no training rows all
words are unknown: N and V are 0. Two words with one 64-bit hash count as one. Other columns are ignored. The input is read twice and has to
be the same both times: a chunk that has changed ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, stash, struct_of, word_hashes, words_of

#: The end of a document as a token: no word, since words have no white space.
END = b"\n"
#: Tokens of a chunk; characters of text for each part of the shuffle.
CHUNK, PART = 800_000, 8_000_000
#: Weight of the shorter context in that of one and of two tokens.
PRIOR = (1000.0, 10.0)
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


def mixed(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair."""
    x = (s * np.uint64(0x9E3779B97F4A7C15)) ^ (s >> np.uint64(32))
    x = (x ^ w) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x += w * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    """Compressed columns of 8 bytes, byte by byte: equal and zero bytes lie together."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8).reshape(columns, 8, size // (8 * columns))
    return [np.ascontiguousarray(c.T).reshape(-1).view(np.uint64) for c in planes]


def encode(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens."""
    return word_hashes([*words_of(text), END])


def grams(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a chunk, and where those that end at each token are: all of one token (odd), of two, then of three (none at a start).

    ``tokens``: those of all documents of the chunk, which begin at ``starts``; the end of a document stands before its first token.
    """
    before = np.roll(tokens, 1)
    before[starts] = tokens[-1]  # an end
    two = mixed(before, tokens)
    later = np.ones(len(tokens), bool)
    later[starts] = False
    at = np.flatnonzero(later)
    three = mixed(two[at - 1] ^ np.uint64(0x5851F42D4C957F2D), tokens[at])
    return np.unique(np.concatenate([tokens | np.uint64(1), two & _EVEN, three & _EVEN]), return_inverse=True)


class Automaton:
    """The states and arcs that the documents of a chunk can reach. n: the training counts of the n-grams that ``grams`` gave, at their places."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, tokens: int, distinct: int, prior: tuple[float, float] = PRIOR):
        size = (len(n) + len(starts)) // 3
        self.starts, self.ends = starts, np.append(starts[1:], size)
        one, two, three = n[:size], n[size : 2 * size], np.zeros(size)
        later = np.ones(size, bool)
        later[starts] = False
        three[later] = n[2 * size :]
        context, pair = np.roll(one, 1), np.roll(two, 1)
        context[starts], pair[starts] = one[self.ends - 1], 0
        self.unigram = np.log10(one + 1) - np.log10(tokens + distinct + 1)
        p1 = (one + 1) / (tokens + distinct + 1)
        p2 = (two + prior[0] * p1) / (context + prior[0])
        p3 = (three + prior[1] * p2) / (pair + prior[1])
        self.known = one > 0
        #: The longest context from which there is an arc for the token, the weight of that arc, and the failure arcs of the states of two tokens and of one.
        self.depth = np.where(three > 0, 2, (two > 0).astype(np.int64))
        self.arc = np.log10(np.where(three > 0, p3, np.where(two > 0, p2, p1)))
        self.fail = np.log10(prior[1] / (pair + prior[1])), np.log10(prior[0] / (context + prior[0]))

    def walk(self, k: int) -> float:
        """log10 of the probability of the k-th document."""
        part = slice(self.starts[k], self.ends[k])
        total, state = 0.0, 1  # words of the state
        for depth, arc, fail2, fail1, known in zip(self.depth[part].tolist(), self.arc[part].tolist(), self.fail[0][part].tolist(), self.fail[1][part].tolist(), self.known[part].tolist(), strict=True):
            if state == 2 and depth < 2:
                total += fail2
                state = 1
            if state == 1 and depth < 1:
                total += fail1
            total += arc
            state = 2 if depth else 1 if known else 0
        return total


class Chunk:
    """Documents in a row of one input partition."""

    def __init__(self):
        self.ids, self.learns, self.asked, self.docs, self.size = [], [], [], [], 0

    def add(self, doc_id: object, text: str | None, learns: bool, asked: bool) -> None:
        self.docs.append(encode(text))
        self.size += len(self.docs[-1])
        for kept, value in ((self.ids, doc_id), (self.learns, learns), (self.asked, asked)):
            kept.append(value)

    def close(self, number: int) -> None:
        self.lengths = np.array([len(d) for d in self.docs], np.int64)
        self.tokens = np.concatenate(self.docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.keys, self.at = grams(self.tokens, self.starts)
        #: Its name says what it holds and where, so that another content cannot pass for it.
        self.name = xxhash.xxh3_64_intdigest(self.keys.tobytes(), (TaskContext.get().partitionId() << 24) + number) >> 1


def chunks(batches: Iterator[dict[str, list]], size: int) -> Iterator[Chunk]:
    chunk, number = Chunk(), 0
    for b in batches:
        for row in zip(b["doc_id"], b["text"], b["learns"], b["asked"], strict=True):
            chunk.add(*row)
            if chunk.size >= size:
                chunk.close(number)
                yield chunk
                chunk, number = Chunk(), number + 1
    if chunk.docs:
        chunk.close(number)
        yield chunk


#: Rows of the shuffles. PAIRS: a range of a chunk's n-grams and training counts; COUNTS: the counts of all chunks for them; TOTAL: tokens and
#: distinct words of a range; CHUNK_: a chunk itself.
CHUNK_, PAIRS, COUNTS, TOTAL = range(4)


def score(docs: DataFrame, learned: Column | DataFrame, prior: tuple[float, float] = PRIOR, chunk_tokens: int = CHUNK, part_chars: int = PART) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigrams alone) and score of every row of ``docs``.

    ``learned``: which rows of ``docs`` the training texts are, or a table of them (text).
    """
    kind = docs.schema["doc_id"].dataType
    flag = F.coalesce(learned, F.lit(False)) if isinstance(learned, Column) else F.lit(False)
    rows = docs.select("doc_id", "text", flag.alias("learns"), F.lit(True).alias("asked"))
    if isinstance(learned, DataFrame):
        rows = rows.unionByName(learned.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(True).alias("learns"), F.lit(False).alias("asked")))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = size // part_chars + 2
    ranges = 4 * parts
    edges = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)
    packed = struct_of(("what", T.IntegerType()), ("range", T.LongType()), ("chunk", T.LongType()), ("asked", T.BooleanType()), ("data", T.BinaryType()), ("tokens", T.LongType()), ("distinct", T.LongType()))
    whole = T.StructType([*packed.fields, T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType()))])

    def columns(schema: T.StructType, n: int, **given: object) -> dict[str, list]:
        return {f.name: given[f.name] if isinstance(given.get(f.name), list) else [given.get(f.name)] * n for f in schema}

    def send(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks(batches, chunk_tokens):
            learns = np.repeat(np.array(chunk.learns, float), chunk.lengths)
            later = np.ones(len(learns), bool)
            later[chunk.starts] = False
            n = np.bincount(chunk.at, np.concatenate([learns, learns, learns[later]]), len(chunk.keys)).astype(np.uint64)
            cuts = np.append(np.searchsorted(chunk.keys, edges), len(chunk.keys))
            spans = [(k, i, j) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
            for at in range(0, len(spans), 500):
                part = spans[at : at + 500]
                data = [pack(np.diff(chunk.keys[i:j], prepend=np.uint64(0)), n[i:j]) for _, i, j in part]
                yield columns(packed, len(part), what=PAIRS, range=[k for k, _, _ in part], chunk=chunk.name, asked=any(chunk.asked), data=data)

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        """Sum each range over the chunks, and answer them."""
        held: list[tuple[int, bool, bytes]] = []
        last = -1

        def answers() -> Iterator[dict[str, list]]:
            sides = [unpack(data, 2) for _, _, data in held]
            keys, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in sides]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in sides]).astype(float), len(keys))
            words = n[keys & np.uint64(1) == 1]
            yield columns(packed, 1, what=TOTAL, range=last, tokens=int(words.sum()), distinct=int((words > 0).sum()))
            upto = 0
            for (chunk, asked, _), (k, _) in zip(held, sides, strict=True):
                if asked:
                    yield columns(packed, 1, what=COUNTS, range=last, chunk=chunk, data=[pack(n[at[upto : upto + len(k)]].astype(np.uint64))])
                upto += len(k)

        for b in batches:
            for at, chunk, asked, data in zip(b["range"], b["chunk"], b["asked"], b["data"], strict=True):
                if at != last and held:
                    yield from answers()
                    held = []
                last = at
                held.append((chunk, asked, data))
        if held:
            yield from answers()

    def resend(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        """The chunks themselves: their words, and each token's place among them."""
        for chunk in chunks(batches, chunk_tokens):
            if any(chunk.asked):
                words, at = np.unique(chunk.tokens, return_inverse=True)
                ids = [i if a else None for i, a in zip(chunk.ids, chunk.asked, strict=True)]
                lengths = np.where(chunk.asked, chunk.lengths, -chunk.lengths).tolist()
                data = len(words).to_bytes(8, "little") + pack(np.concatenate([words, at.astype(np.uint64)]))
                yield columns(whole, 1, what=CHUNK_, range=-1, chunk=chunk.name, data=[data], ids=[ids], lengths=[lengths])

    sums = map_lists(rows, send, packed).repartition(parts, "range").sortWithinPartitions("range")
    found = stash(map_lists(sums.select("range", "chunk", "asked", "data"), count, packed), "counts")
    total = found.where(F.col("what") == TOTAL).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = int(total[0]), int(total[1])
    out = struct_of(("doc_id", kind), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))

    def walk(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        head, held, name = None, [], None

        def scored() -> dict[str, list]:
            ids, lengths, data = head
            asked, lengths = np.array(lengths) > 0, np.abs(np.array(lengths))
            (flat,) = unpack(data[8:], 1)
            words = int.from_bytes(data[:8], "little")
            text, starts = flat[:words][flat[words:].astype(np.int64)], np.cumsum(lengths) - lengths
            keys, at = grams(text, starts)
            n = np.concatenate([np.zeros(0), *[unpack(x, 1)[0].astype(float) for x in held]])
            if len(n) != len(keys):
                raise RuntimeError("the documents changed between two reads")
            automaton = Automaton(n[at], starts, tokens, distinct, prior)
            own = np.flatnonzero(asked).tolist()
            base, known = np.add.reduceat(automaton.unigram, starts), np.add.reduceat(automaton.known.astype(np.int64), starts)
            return {"doc_id": [ids[k] for k in own], "n_tokens": lengths[own].tolist(), "n_known": known[own].tolist(), "base_score": base[own].tolist(), "score": [automaton.walk(k) for k in own]}

        for b in batches:
            for what, chunk, ids, lengths, data in zip(b["what"], b["chunk"], b["ids"], b["lengths"], b["data"], strict=True):
                if what == CHUNK_:
                    if head:
                        yield scored()
                    head, held, name = (ids, lengths, data), [], chunk
                elif chunk != name:
                    raise RuntimeError("the documents changed between two reads")
                else:
                    held.append(data)
        if head:
            yield scored()

    none = [F.lit(None).cast(whole[c].dataType).alias(c) for c in ("ids", "lengths")]
    both = map_lists(rows, resend, whole).unionByName(found.where(F.col("what") == COUNTS).select("*", *none))
    ordered = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "what", "range").select("what", "chunk", "ids", "lengths", "data")
    return map_lists(ordered, walk, out).select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
