"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds those of its letters (elementwise product),
each permuted (rotated) by its place. A text's vector bundles (sums) those of its n-grams, a language's prototype those of its training texts at
length one. A text gets the language whose prototype has the highest cosine.

Prototypes are fitted on at most about ``rows`` texts of each language (a parameter); vectors are summed in the tasks, and only one for each
language comes to the driver. Texts are then scored in their own partitions, without a shuffle.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0. Equal cosines go to the first language by name. With no
training rows every text is ``und``. Rows are documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, struct_of

DIM = 1024
#: Letters by code point, up to the end of the planes that have any.
_ALPHA = np.zeros(0x40000, bool)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; anything between them is one 0, as are the ends."""
    if not _ALPHA[97]:
        _ALPHA[:] = [chr(c).isalpha() for c in range(len(_ALPHA))]
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(_ALPHA[np.minimum(codes, len(_ALPHA) - 1)], codes, 0)
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


class Vectors:
    """Vectors of letters and 3-grams; the latter in a memo of bounded size."""

    def __init__(self, dim: int = DIM, memo: int = 20_000):
        self.dim, self.letters, self.rows = dim, {}, {}
        self.table = np.zeros((memo, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 100_000:
                self.letters.clear()
            self.letters[code] = (np.random.default_rng(code).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def row(self, key: int) -> int:
        at = self.rows.get(key)
        if at is None:
            a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
            at = self.rows[key] = len(self.rows)
            self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return at

    def of(self, text: str | None) -> np.ndarray | None:
        """A text's vector, at length one; None without letters."""
        if not text:
            return None
        codes = letters(text)
        if len(codes) < 3:
            return None
        keys, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        out = np.zeros(self.dim, np.float32)
        for k in range(0, len(keys), 4096):
            part = keys[k : k + 4096].tolist()
            if len(self.rows) + len(part) > len(self.table):
                self.rows.clear()
            out += counts[k : k + 4096].astype(np.float32) @ self.table[[self.row(key) for key in part]].astype(np.float32)
        length = np.linalg.norm(out)
        return out / length if length else None


_VECTORS: list[Vectors] = []


def vectors() -> Vectors:
    if not _VECTORS:
        _VECTORS.append(Vectors())
    return _VECTORS[0]


def train(docs: DataFrame, learn: Column, rows: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes at length one, from rows that ``learn`` (a condition on doc_id) admits."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in docs.where(learn & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))]), F.col("lang"))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if (v := vectors().of(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(float)
        yield {"lang": [*sums], "bundle": [v.tolist() for v in sums.values()]}

    parts = map_lists(known.where(dice < share).select("lang", "text"), run, struct_of(("lang", T.StringType()), ("bundle", T.ArrayType(T.DoubleType()))))
    total = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = total.collect()
    langs = sorted({r["lang"] for r in found})
    out = np.zeros((len(langs), DIM))
    for r in found:
        out[langs.index(r["lang"]), r["at"]] = r["value"]
    return langs, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score: the cosine with the prototype, 0 at least."""
    schema = struct_of(("doc_id", docs.schema["doc_id"].dataType), ("lang_pred", T.StringType()), ("score", T.DoubleType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            found, scores = [], []
            for text in b["text"]:
                v = vectors().of(text) if langs else None
                cosines = prototypes @ v if v is not None else None
                best = int(np.argmax(cosines)) if v is not None else -1
                found.append(langs[best] if best >= 0 else "und")
                scores.append(min(1.0, max(0.0, float(cosines[best]))) if best >= 0 else 0.0)
            yield {"doc_id": b["doc_id"], "lang_pred": found, "score": scores}

    return map_lists(docs.select("doc_id", "text"), run, schema)
