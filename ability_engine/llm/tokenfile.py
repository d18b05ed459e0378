"""Token files: concatenated ids with Elias-Fano coded document boundaries.

Documents are range-partitioned by doc_id and sorted, then cut into segments of about ``segment_tokens`` ids. A segment holds, in one
binary column each, its ids (unsigned 16-bit, little-endian), its doc_ids and the Elias-Fano code of its document ends. The segments are rows of
a Parquet folder, so any store that Spark writes to will do, and a lost task rewrites only its own segments.

Elias-Fano: of n ends up to u, each has ``low`` = log2(u / n) low bits stored as they are; the high parts are stored in unary, as one bit set
per end. ``Bounds.select(k)`` finds the k-th set bit from a stored sample of every 64th one and returns the k-th end: about 2.5 + log2(u / n) bits a
document. Reading goes through ``select``, so no table of 64-bit ends is ever built.

Defined cases: a null or empty text is a document of the end id alone. Rows are documents, so a repeated doc_id keeps all its rows, in the
order of their texts' hash. A null doc_id comes first and is read back as null. An empty table gives an empty folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, struct_of
from ability_engine.llm.tokens import encoder

MAGIC = 0x4546_4944
SAMPLE = 64


class Bounds:
    """Elias-Fano code of a non-decreasing sequence."""

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, sampled: bytes):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        self.sampled = np.frombuffer(sampled, "<u4")

    @classmethod
    def of(cls, ends: np.ndarray) -> Bounds:
        n, top = len(ends), int(ends[-1]) if len(ends) else 0
        low = max(0, int(np.log2(max(1, top // max(1, n)))))
        values = ends.astype(np.uint64)
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        lows = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, low, np.packbits(lows.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, k: int) -> int:
        """The k-th value."""
        at = int(self.sampled[k // SAMPLE])
        rest, byte = k % SAMPLE, at // 8
        word = self.highs[byte] >> at % 8 << at % 8
        while (ones := word.bit_count()) <= rest:
            rest, byte = rest - ones, byte + 1
            word = self.highs[byte]
        for _ in range(rest):
            word &= word - 1
        high = 8 * byte + (word & -word).bit_length() - 1 - k
        first = k * self.low
        chunk = int.from_bytes(self.lows[first // 8 : (first + self.low) // 8 + 1], "little")
        return high << self.low | chunk >> first % 8 & ((1 << self.low) - 1)

    def to_bytes(self) -> bytes:
        head = np.array([MAGIC, self.n, self.low, len(self.lows), len(self.highs)], "<u8").tobytes()
        return head + self.lows + self.highs + self.sampled.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bounds:
        magic, n, low, a, b = np.frombuffer(data, "<u8", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano block")
        return cls(n, low, data[40 : 40 + a], data[40 + a : 40 + a + b], data[40 + a + b :])


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, segment_tokens: int = 1_000_000) -> None:
    """Encode every text and write the segments to ``path``."""
    kind = docs.schema["doc_id"].dataType
    schema = struct_of(("part", T.IntegerType()), ("segment", T.IntegerType()), ("tokens_before", T.LongType()), ("n_tokens", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("ends", T.BinaryType()), ("ids", T.BinaryType()))
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        names: list = []
        data: list[bytes] = []
        before = segment = held = 0

        def flush() -> dict[str, list]:
            ends = np.cumsum([len(d) // 2 for d in data])
            return {"part": [part], "segment": [segment], "tokens_before": [before], "n_tokens": [held], "doc_ids": [names], "ends": [Bounds.of(ends).to_bytes()], "ids": [b"".join(data)]}

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                names.append(doc_id)
                data.append(code.encode(text) + end)
                held += len(data[-1]) // 2
                if held >= segment_tokens:
                    yield flush()
                    before, segment, held = before + held, segment + 1, 0
                    names, data = [], []
        if data:
            yield flush()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_lists(ordered, run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit) and ids, by document."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = struct_of(("doc_id", kind), ("part", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), *[("ids", T.BinaryType())] * ids)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part, before, names, ends, data in zip(batch["part"], batch["tokens_before"], batch["doc_ids"], batch["ends"], batch["ids"], strict=True):
                bounds, last = Bounds.from_bytes(ends), 0
                for k in range(0, len(names), 1000):
                    cut = []
                    for d in range(k, min(k + 1000, len(names))):
                        first, last = last, bounds.select(d)
                        cut.append((first, last))
                    yield {
                        "doc_id": names[k : k + 1000],
                        "part": [part] * len(cut),
                        "at": [before + a for a, _ in cut],
                        "n_tokens": [b - a for a, b in cut],
                        "ids_crc32": [zlib.crc32(np.frombuffer(data, "<u2", b - a, 2 * a).astype("<u4").tobytes()) for a, b in cut],
                        "ids": [data[2 * a : 2 * b] if ids else None for a, b in cut],
                    }

    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One small row for each partition of the writing job: few enough to broadcast at any size of the corpus.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    docs = map_lists(segments.select("part", "tokens_before", "doc_ids", "ends", "ids"), run, schema)
    start = (F.col("before") + F.col("at")).alias("start")
    return docs.join(F.broadcast(before), "part").select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * ids)
