"""Cost-balanced packing of tokenised documents into training sequences.

A sequence of n tokens costs about ``linear * n + quadratic * sum(piece ** 2)``: attention is quadratic within a piece. Documents are cut
where they are longer than a sequence; the full pieces stand alone. The rests are taken in descending length, each going to the sequence of
the lowest cost so far that still has room for it. What fits nowhere whole is cut to fill the gaps, again from the cheapest sequence on.

Each Arrow stream (one input partition) packs its own documents in rounds of about ``round_tokens`` tokens, so nothing is shuffled, memory
is bounded, and a lost task is simply run again with the same result. A round fills its sequences to the brim; the tokens that are left
over go to sequences whose lengths are powers of two, so no padding is needed.

Defined cases: a null or empty text is a document of one token (the end id). Rows are documents, so a doc_id that occurs twice is packed
twice. Other columns of the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, struct_of
from ability_engine.llm.tokens import encoder


class Open:
    """Sequences that still have room: the cheapest one with at least n free tokens, in logarithmic time."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int, int]] = [(float("inf"), -1, -1)] * (2 * self.leaves)
        self.heaps[capacity] = [(0.0, k) for k in range(sequences)]
        self._renew(capacity)

    def _renew(self, room: int) -> None:
        heap = self.heaps[room]
        at = room + self.leaves
        self.tree[at] = (*heap[0], room) if heap else (float("inf"), -1, -1)
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest sequence with ``least`` free tokens."""
        lo, hi, best = least + self.leaves, 2 * self.leaves, (float("inf"), -1, -1)
        while lo < hi:
            if lo & 1:
                best, lo = min(best, self.tree[lo]), lo + 1
            lo, hi = lo // 2, hi // 2
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._renew(best[2])
        return best

    def put(self, cost: float, sequence: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._renew(room)


def plan(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths: (document, start, length, sequence, offset) for each piece."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rests: list[tuple[int, int, int]] = []  # length, document, start
    n = 0
    for doc, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, n, 0))
            n += 1
        if length % capacity:
            rests.append((length % capacity, doc, full * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rests)
    spare = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(spare.bit_length() - 1, -1, -1) if spare >> b & 1]
    rooms = Open(total // capacity, capacity)
    for k in range(total // capacity, len(sizes)):
        rooms.put(0.0, k, sizes[k])

    def place(length: int, doc: int, start: int, got: tuple[float, int, int]) -> None:
        cost, sequence, room = got
        pieces.append((doc, start, length, n + sequence, sizes[sequence] - room))
        rooms.put(cost + linear * length + quadratic * length * length, sequence, room - length)

    late = []
    for length, doc, start in rests:
        if got := rooms.take(length):
            place(length, doc, start, got)
        else:
            late.append((length, doc, start))
    for length, doc, start in late:
        while length:
            got = rooms.take(1)
            part = min(length, got[2])
            place(part, doc, start, got)
            length, start = length - part, start + part
    return pieces


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 1, round_tokens: int = 8_000_000, linear: float = 1.0, quadratic: float = 1 / 2048, ids: bool = True) -> DataFrame:
    """Pack every document: a row for each piece, with the piece's ids (unsigned 16-bit, little-endian) unless ``ids`` is off."""
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), *((c, T.LongType()) for c in numbers), *[("ids", T.BinaryType())] * ids)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        code, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        names: list = []
        data: list[bytes] = []

        def flush() -> Iterator[dict[str, list]]:
            nonlocal base
            found = plan([len(d) // 2 for d in data], capacity, linear, quadratic)
            for k in range(0, len(found), 20_000):
                rows = []
                for doc, start, length, sequence, offset in found[k : k + 20_000]:
                    part = data[doc][2 * start : 2 * (start + length)]
                    crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                    rows.append((names[doc], start, length, crc, len(data[doc]) // 2, base + sequence, offset, part))
                yield dict(zip(schema.names, map(list, zip(*rows)), strict=False))
            base += 1 + max((p[3] for p in found), default=-1)
            names.clear()
            data.clear()

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                names.append(doc_id)
                data.append(code.encode(text) + end)
                held += len(data[-1]) // 2
                if held >= round_tokens:
                    yield from flush()
                    held = 0
        if data:
            yield from flush()

    return map_lists(docs.select("doc_id", "text"), run, schema)
