"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that are Python objects at once.
SLICE = 1024

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []
#: The lists of the scratch() blocks that a thread is in; without one, paths go to _WRITTEN.
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session has none does a local master get a temporary folder; a cluster then uses the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="ability_engine_"))


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/ability_engine/{what}-{uuid.uuid4().hex}"
    (getattr(_SCOPES, "open", None) or [_WRITTEN])[-1].append(path)
    return path


def stash(df: DataFrame, what: str, **options: int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing. ``options``: of the writer."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stashes(spark: SparkSession) -> None:
    """Delete what stash() has written. Call it only once the results that read it are written."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, what this thread has stashed within it. Results that are still wanted are written to a path made before."""
    own: list[str] = []
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append(own)
    try:
        yield
    finally:
        scopes.pop()
        while own:
            _delete(spark, own.pop())


def remainder(col: Column | str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put after it until it isn't a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key() -> Column:
    """128-bit digest of a row's doc_id and text: two rows have one key only if they are the same document. Never null."""
    doc = F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("\0")), F.lit("n"))
    return F.unhex(F.md5(F.concat(doc, F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n"))).cast("binary")))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered, split at ASCII white space, as UTF-8. Null: none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, with a bounded memo: frequent words stay at hand, and a worker's memory doesn't grow with the vocabulary."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: One memo for each Python worker, whatever operators it runs.
_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, within an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def struct_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


def map_lists(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: T.StructType) -> DataFrame:
    """mapInArrow over columns as Python lists: whole numbers stay whole where there are nulls, and few rows are Python objects at once."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict[str, list]]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield {name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)}

        for out in fn(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
