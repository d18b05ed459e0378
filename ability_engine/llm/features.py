"""Hashed text features, and the labelled rows that classifiers are fitted on: all of them in shards, or a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, stash, struct_of, word_hashes

#: Buckets of each block (character 3-grams, words, word pairs), then eight numbers on length and repetition.
BLOCK = 2048
SIZE = 3 * BLOCK + 8
LENGTHS = (5, 10, 25, 50)
_BITS = np.uint32(32 - 11)


def _spread(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> _BITS


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams: each block has length one, or zero where the text has none. Case is kept.

    The last eight: which of five classes of length in words, and the square roots of the shares of repeated words, repeated pairs and words
    equal to the word before.
    """
    x = np.zeros(SIZE, np.float32)
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        x[:BLOCK] = np.bincount(_spread(b[:-2] << 16 | b[1:-1] << 8 | b[2:]), minlength=BLOCK) / (len(b) - 2)
    words = data.split()
    if words:
        h = word_hashes(words).astype(np.uint32)
        x[BLOCK : 2 * BLOCK] = np.bincount(_spread(h), minlength=BLOCK) / len(h)
        if len(h) > 1:
            pairs = h[:-1] * np.uint32(31) + h[1:]
            x[2 * BLOCK : 3 * BLOCK] = np.bincount(_spread(pairs), minlength=BLOCK) / (len(h) - 1)
            x[-3:] = 1 - len(set(words)) / len(h), 1 - len(np.unique(pairs)) / len(pairs), (h[:-1] == h[1:]).mean()
    x[3 * BLOCK + sum(len(words) >= n for n in LENGTHS)] = 1
    return np.sqrt(x, out=x)


def sparse(x: np.ndarray) -> bytes:
    """The places that aren't zero, then their values, in 16 bits each."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f2").tobytes()


def dense(rows: list[bytes] | list[pa.Buffer]) -> np.ndarray:
    x = np.zeros((len(rows), SIZE), np.float32)
    for k, data in enumerate(rows):
        pairs = np.frombuffer(data, "<u2").reshape(2, -1)
        x[k, pairs[0]] = pairs[1].view("<f2")
    return x


def _marked(labels: DataFrame, label: str, learn: Column | None) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and label, one row each, and how many there are of each class. A doc_id with several labels takes the lowest; null labels are left out."""
    marked = labels.where(F.col(label).isin(0, 1))
    if learn is not None:
        marked = marked.where(learn)
    marked = marked.groupBy("doc_id").agg(F.min(label).alias("label"))
    return marked, {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}


def shards(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column | None = None, least: int = 50) -> DataFrame | None:
    """All labelled documents, dealt by a hash to shards of about ``rows``: rows with the lists of label, copy and x of up to SLICE of them; None unless there are two classes.

    Where a class is too rare for ``least`` rows in a shard, its rows are in several ones; ``copy`` counts them from 0. Only labelled texts leave the scan, so
    the ids and labels are broadcast, which grow with the labels; each text is shuffled once, and what reads a shard again shuffles nothing. A shard is a partition
    and one file of one row group, so its rows meet in one task and follow each other; no row, and no step before the fit, holds a whole shard.
    """
    marked, counts = _marked(labels, label, learn)
    if len(counts) < 2:
        return None
    n = -(-sum(counts.values()) // rows)
    copies = {k: min(n, -(-least * n // c)) for k, c in counts.items()}

    def pack(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            ends = [k for k, after in enumerate(b["shard"][1:], 1) if after != b["shard"][k - 1]] + [len(b["shard"])]
            for k, end in zip([0, *ends], ends):  # noqa: B905
                yield {"shard": [b["shard"][k]], "label": [b["label"][k:end]], "copy": [b["copy"][k:end]], "x": [[sparse(features(t)) for t in b["text"][k:end]]]}

    texts = docs.select("doc_id", "text").join(F.broadcast(marked.select("doc_id", F.col("label").cast("int"))), "doc_id").select("label", F.xxhash64("doc_id", F.lit(17)).alias("key"), "text")
    last = F.when(F.col("label") == 0, copies[0] - 1).otherwise(copies[1] - 1)
    dealt = texts.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).withColumn("shard", F.pmod(F.pmod("key", F.lit(n)) + F.col("copy"), F.lit(n)).cast("int"))
    schema = struct_of(("shard", T.IntegerType()), *((name, T.ArrayType(kind)) for name, kind in (("label", T.IntegerType()), ("copy", T.IntegerType()), ("x", T.BinaryType()))))
    placed = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "key", "copy").select("shard", "label", "copy", "text")
    return stash(map_lists(placed, pack, schema), "labelled", **{"parquet.block.size": 1 << 30})


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of about ``rows`` labelled documents, half of each class as far as there are any.

    Rows are taken by a hash of doc_id, so the sample is the same on each run; a weight is the number of labelled rows a row stands for. Only the sampled texts leave the scan: the ids are at most about
    ``rows`` and so may be broadcast.
    """
    marked, counts = _marked(labels, label, learn)
    if not counts:
        return np.zeros((0, SIZE), np.float32), np.zeros(0), np.zeros(0)
    share = {k: min(1.0, rows / 2 / n) for k, n in counts.items()}
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = marked.where(dice < F.when(F.col("label") == 0, share.get(0, 0.0)).otherwise(share.get(1, 0.0)))
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), ("label", T.IntegerType()), ("x", T.BinaryType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "label": b["label"], "x": [sparse(features(t)) for t in b["text"]]}

    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", F.col("label").cast("int"))), "doc_id").select("doc_id", "label", "text")
    got = sorted((r["doc_id"], r["label"], r["x"]) for r in map_lists(texts, run, schema).collect())
    x = dense([r[2] for r in got])
    y = np.array([r[1] for r in got], float)
    return x, y, np.where(y == 1, 1 / share.get(1, 1), 1 / share.get(0, 1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -500, 500)))


def descend(gradient, start: np.ndarray, step: float, turns: int) -> np.ndarray:
    """Accelerated gradient descent."""
    w = ahead = start
    for k in range(turns):
        new = ahead - step * gradient(ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, turns: int = 300) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a bias that is not penalised. ``x`` isn't copied."""
    share = weight / weight.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        pull = (share * (sigmoid(x @ w[:-1] + w[-1]) - y)).astype(np.float32)
        return np.append(x.T @ pull + np.float32(l2) * w[:-1], pull.sum())

    w = descend(gradient, np.zeros(x.shape[1] + 1, np.float32), 1.0, turns)
    return w[:-1], float(w[-1])


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated probability sigmoid(a * z + b), by Newton's method."""
    a, b, share = 1.0, 0.0, weight / weight.sum()
    n1, n0 = max(1.0, (y == 1).sum()), max(1.0, (y == 0).sum())
    aim = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([(share * (p - aim) * z).sum(), (share * (p - aim)).sum()])
        h = share * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-9, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        da, db = np.linalg.solve(m, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a), float(b)
