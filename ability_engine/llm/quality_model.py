"""Bradley-Terry quality scores.

A preference pair is a good and a poor document; the model learns weights so that the sigmoid of the difference of their scores, which is
linear in the difference of their features, is likely to be high (logistic loss). Such scores have no zero, so the cut is a quantile of
the labelled documents' scores: the share of poor ones among them. The score returned is a sigmoid that is 0.3 at the cut.

All labelled documents are fitted on, in shards of about ``rows`` (a parameter). Each shard fits its own pairs and the weights are averaged; in further rounds
the shards start from the average, and each leans its gradient by what the joint gradient there differs from its own, so they go on to one joint fit. The
cut is a quantile of all labelled documents, each scored by weights that it had no part in. Every document is then scored in its own partition, without a shuffle.

Defined cases: null and empty texts have no features and get the score of zero features. With no labels, or of one class only, every score is 0.5.
Rows are documents; a doc_id that occurs twice is scored twice. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ability_engine.llm.common import map_lists, scratch, struct_of
from ability_engine.llm.features import SIZE, dense, descend, features, shards, sigmoid

CUT = 0.3


@dataclass
class Ranker:
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights - self.cut) + (np.log(CUT / (1 - CUT)) if self.slope else 0.0))


def pairwise(x: np.ndarray, y: np.ndarray, pairs: int, l2: float, seed: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of the loss over preference pairs of the good and the poor rows. Each row of a class is in as many pairs as the others, give or take one."""
    rng = np.random.default_rng(seed)
    i, j = (rng.permutation(np.resize(rng.permutation(np.flatnonzero(y == k)), pairs)) for k in (1, 0))

    def gradient(w: np.ndarray) -> np.ndarray:
        z = x @ w
        pull = (sigmoid(z[i] - z[j]) - 1) / pairs
        each = np.bincount(i, pull, len(x)) - np.bincount(j, pull, len(x))
        return x.T @ each.astype(np.float32) + np.float32(l2) * w

    return gradient


#: Rows that each of the three weights is fitted on: all, and either half.
PARTS = (slice(None), slice(0, None, 2), slice(1, None, 2))


def weights(x: np.ndarray, y: np.ndarray, pairs: int, l2: float, turns: int, start: np.ndarray | None = None, joint: np.ndarray | None = None) -> np.ndarray:
    """For each of PARTS its weights and, in the last column, its rows; zeros where it lacks a class.

    They begin at ``start``. ``joint``: gradients of all shards there, which take the place of its own there. Without turns: its gradients at ``start``.
    """
    out = np.zeros((len(PARTS), x.shape[1] + 1))
    for k, at in enumerate(PARTS):
        if len(set(y[at].tolist())) < 2:
            continue
        gradient = pairwise(x[at], y[at], pairs, l2)
        begin = np.zeros(x.shape[1], np.float32) if start is None else start[k]
        lean = np.float32(0) if joint is None else joint[k] - gradient(begin)
        out[k, :-1] = descend(lambda w: gradient(w) + lean, begin, 0.5, turns) if turns else gradient(begin)  # noqa: B023
        out[k, -1] = len(y[at])
    return out


def crossed(x: np.ndarray, w: np.ndarray, halves: bool) -> np.ndarray:
    """Scores by the weights that a row had no part in, or by those of all rows if a half lacks a class."""
    z = x @ w[0]
    if halves:
        for k in (0, 1):
            z[k::2] = x[k::2] @ w[2 - k]
    return z


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = 40_000, l2: float = 1e-5, turns: int = 300) -> Ranker:
    """The fit of one shard. The cut is a quantile of scores by weights that a row had no part in, where each half has both classes."""
    if len(set(y.tolist())) < 2:
        return Ranker(np.zeros(SIZE, np.float32), 0.0, 0.0)
    found = weights(x, y, pairs, l2, turns)
    w = found[:, :-1].astype(np.float32)
    z = crossed(x, w, bool((found[1:, -1] > 0).all()))
    order = np.argsort(z, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    at = int(np.searchsorted(share, weight[y == 0].sum() / weight.sum()))
    return Ranker(w[0], float(z[order][at : at + 2].mean()), 1.0)


def _each(known: DataFrame, fn: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, list]], schema: T.StructType) -> DataFrame:
    """What ``fn`` makes of the number, features, labels and copies of each shard. Its rows are never Python objects, so a worker holds little beside the matrix."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))
        for shard, part in groupby(rows, lambda row: row.column("shard")[0].as_py()):
            lists = {name: [row.column(name).flatten() for row in held] for held in [list(part)] for name in ("label", "copy", "x")}
            label, copy = (np.concatenate([v.to_numpy() for v in lists[name]]) for name in ("label", "copy"))
            x = dense([v.as_buffer() for values in lists.pop("x") for v in values])
            out = fn(shard, x, label.astype(float), copy)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return known.mapInArrow(run, schema)


def _mean(known: DataFrame, count: int, *args) -> tuple[np.ndarray, np.ndarray]:
    """The mean of what ``weights`` gives for the ``count`` shards, by their rows, and the rows. Shards are summed in groups first, so the driver gets their square root."""

    def one(shard: int, x: np.ndarray, y: np.ndarray, _: np.ndarray) -> dict[str, list]:
        found = weights(x, y, *args)
        found[:, :-1] *= found[:, -1:]
        return {"shard": [shard], "sums": [found.tobytes()]}

    def add(part: pa.Table) -> pa.Table:
        return pa.table({"sums": [sum(np.frombuffer(s) for s in part.sort_by("shard")["sums"].to_pylist()).tobytes()]})

    sums = _each(known, one, struct_of(("shard", T.IntegerType()), ("sums", T.BinaryType()))).groupBy(F.pmod("shard", F.lit(max(1, int(count**0.5))))).applyInArrow(add, "sums binary").collect()
    total = sum(np.frombuffer(s) for s in sorted(bytes(r.sums) for r in sums)).reshape(len(PARTS), -1) if sums else np.zeros((len(PARTS), SIZE + 1))
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32), total[:, -1]


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, learn: Column | None = None, pairs: int = 40_000, l2: float = 1e-5, turns: int = 300, rounds: int = 2) -> Ranker:
    none = Ranker(np.zeros(SIZE, np.float32), 0.0, 0.0)
    with scratch(docs.sparkSession):
        known = shards(docs, labels, "quality", rows, learn)
        if known is None:
            return none
        count = known.select("shard").distinct().count()
        w, n = _mean(known, count, pairs, l2, turns)
        if not n[0]:
            return none
        if count > 1:
            for _ in range(rounds):
                joint, _ = _mean(known, count, pairs, l2, 0, w)
                w, _ = _mean(known, count, pairs, l2, turns // 3, w, joint)
        halves = bool((n[1:] > 0).all())

        def score_all(_: int, x: np.ndarray, y: np.ndarray, copy: np.ndarray) -> dict[str, list]:
            return {"z": crossed(x, w, halves).astype(float), "label": y.astype(int), "copy": copy}

        z = _each(known, score_all, struct_of(("z", T.DoubleType()), ("label", T.IntegerType()), ("copy", T.IntegerType()))).where("copy = 0").persist()
        poor = z.agg(F.avg(1.0 - F.col("label"))).first()[0]
        low = z.agg(F.percentile_approx("z", F.lit(poor), F.lit(100_000))).first()[0]
        high = z.where(F.col("z") > low).agg(F.min("z")).first()[0]
        z.unpersist()
    return Ranker(w[0], low if high is None else (low + high) / 2, 1.0)


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is 0.3 or more)."""
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), ("score", T.DoubleType()), ("predicted", T.IntegerType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            found: list[float] = []
            for k in range(0, len(b["text"]), 256):
                found += model.score(np.array([features(t) for t in b["text"][k : k + 256]])).astype(float).tolist()
            yield {"doc_id": b["doc_id"], "score": found, "predicted": [int(s >= CUT) for s in found]}

    return map_lists(docs.select("doc_id", "text"), run, schema)
