"""Quality rules: counts of words, signs and repeats, and a calibrated model on top of them.

The model is a logistic regression on hashed word and character n-grams, fitted on at most about ``rows`` labelled documents (a parameter); its
probability is calibrated on folds that it was not fitted on. Documents are scored in Arrow batches in their own partitions, without a
shuffle, and held against fixed thresholds.

Defined cases: a null or empty text has no words and fails the base rule. Without labels, or with one class only, the model rejects
nothing. Rows are documents; a doc_id that occurs twice is judged twice. Other columns are kept by ``filter_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, struct_of
from ability_engine.llm.features import SIZE, features, logistic, platt, sample, sigmoid

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_PROBABILITY = 0.5
SPACES = " \t\n\v\f\r"
SIGNS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words), bool)
    at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for k in range(3):
        hit[k : k + len(windows)] |= at
    return int(hit.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SIGNS)), dup_lines(text), repeat_words(words)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * (x @ self.weights + self.bias) + self.b)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model | None:
    if len(set(y.tolist())) < 2:
        return None
    z = np.zeros(len(y))
    for k in (0, 1):  # folds are views of every second row, not copies
        other = slice(1 - k, None, 2)
        if len(set(y[other].tolist())) == 2:
            w, b = logistic(x[other], y[other], weight[other])
            z[k::2] = x[k::2] @ w + b
    w, b = logistic(x, y, weight)
    return Model(w, b, *platt(z, y, weight))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, learn: Column | None = None) -> Model | None:
    """Fit on the rows of ``labels.quality`` that ``learn`` (a condition on labels) admits."""
    return fit(*sample(docs, labels, "quality", rows, learn))


def _judge(model: Model | None, texts: list[str | None]) -> dict[str, list]:
    out = dict(zip(COUNTS, map(list, zip(*map(counts, texts), strict=True)), strict=True)) if texts else {c: [] for c in COUNTS}
    out["base_failed"] = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(out["n_words"], out["n_repeat_words"], strict=True)]
    p: list[float] = []
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        p += [1.0] * len(part) if model is None else model.probability(np.array([features(t) for t in part]).reshape(-1, SIZE)).astype(float).tolist()
    out["probability"] = p
    out["kept"] = [not f and q >= MIN_PROBABILITY for f, q in zip(out["base_failed"], p, strict=True)]
    return out


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the model's probability that the document is good."""
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), *((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("probability", T.DoubleType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"doc_id": b["doc_id"]} | _judge(model, b["text"])

    return map_lists(docs.select("doc_id", "text"), run, schema)


def filter_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            kept = _judge(model, b["text"])["kept"]
            yield {c: [v for v, k in zip(values, kept, strict=True) if k] for c, values in b.items()}

    return map_lists(docs, run, docs.schema)
