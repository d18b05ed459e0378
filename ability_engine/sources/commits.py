"""Publication of lab files and their audit log as one commit: versioned folders, and a manifest that points to them.

A commit writes its lab files and its changes to folders of its own, which nobody reads yet, checks the files there, and then creates the manifest of the next version.
That is one file, created only if it isn't there, and it alone makes the commit visible: whatever fails before leaves the last version as it was, and files and log
never disagree. Of two commits on one version the second finds the manifest taken and is refused. A manifest that was cut off while it was written isn't whole, so it
doesn't count, and its number isn't used again. ``restore`` publishes an older version's files as a new version; the log keeps everything.

A folder holds ``models/<name>/lab=...``, ``changes/<name>`` and ``manifest/<version>``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ability_engine.sources import star


@dataclass
class Outcome:
    """What came of a commit: the version that is current now, whether it is a new one, and why not."""

    version: int
    written: bool
    errors: list[str] = field(default_factory=list)


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, at: str) -> list[str]:
    store, path = _path(spark, at)
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []


def _delete(spark: SparkSession, at: str) -> None:
    store, path = _path(spark, at)
    store.delete(path, True)


def _read(spark: SparkSession, at: str) -> str:
    store, path = _path(spark, at)
    stream = store.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def manifests(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The whole manifests by version. They are small, one for each commit."""
    found = {}
    for name in _names(spark, f"{folder}/manifest"):
        try:
            entry = json.loads(_read(spark, f"{folder}/manifest/{name}"))
        except ValueError:
            continue  # cut off
        if name.isdigit():
            found[int(name)] = entry
    return found


def version(spark: SparkSession, folder: str) -> int:
    """The current version, 0 before the first commit."""
    return max(manifests(spark, folder), default=0)


def lab_files(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """The lab files of a version, the current one by default."""
    found = manifests(spark, folder)
    entry = found.get(max(found, default=0) if at is None else at)
    return star.lab_files(spark, f"{folder}/models/{entry['models']}") if entry else spark.createDataFrame([], star.LAB_FILE)


def changes(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The audit log of all commits, or of those up to a version."""
    found = [e["changes"] for v, e in sorted(manifests(spark, folder).items()) if e["changes"] and (upto is None or v <= upto)]
    return spark.read.schema(star.CHANGE).json([f"{folder}/changes/{name}" for name in found]) if found else spark.createDataFrame([], star.CHANGE)


def _stage(files: DataFrame, events: DataFrame, folder: str, name: str) -> None:
    star.canonical(files).write.partitionBy("lab").text(f"{folder}/models/{name}")
    star.append_changes(events, f"{folder}/changes/{name}")


def _point(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Create the manifest of a version; False if it exists."""
    store, path = _path(spark, f"{folder}/manifest/{number:010}")
    try:
        stream = store.create(path, False)
    except Exception as e:  # py4j wraps what the store throws
        if "exist" in str(e).lower():
            return False
        raise
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
    return True


def _next(spark: SparkSession, folder: str) -> int:
    return max((int(n) for n in _names(spark, f"{folder}/manifest") if n.isdigit()), default=0) + 1


def commit(files: DataFrame, events: DataFrame, folder: str, check: Callable[[DataFrame], DataFrame] | None = None, base: int | None = None) -> Outcome:
    """Publish ``files`` with the changes ``events`` on top of version ``base`` (the current one by default).

    ``check`` gives issues (severity, message) of the staged files; with an error nothing is published and the outcome has its messages. Without events, or if the files
    hold what is published already, nothing is written.
    """
    spark = files.sparkSession
    now = version(spark, folder)
    if base is not None and base != now:
        return Outcome(now, False, [f"version {now} was published after {base}"])
    if events.isEmpty():
        return Outcome(now, False)
    if now:
        old, new = (star.canonical(x).select("value") for x in (lab_files(spark, folder), files))
        if new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty():
            return Outcome(now, False)
    number, name = _next(spark, folder), uuid.uuid4().hex
    _stage(files, events, folder, name)
    issues = [] if check is None else [r[0] for r in check(star.lab_files(spark, f"{folder}/models/{name}")).where("severity = 'error'").select("message").limit(10).collect()]
    if issues or not _point(spark, folder, number, {"models": name, "changes": name, "base": now}):
        for what in ("models", "changes"):
            _delete(spark, f"{folder}/{what}/{name}")
        return Outcome(version(spark, folder), False, issues or [f"version {number} was published meanwhile"])
    return Outcome(number, True)


def restore(spark: SparkSession, folder: str, to: int) -> Outcome:
    """Publish the files of version ``to`` again, as a new version without changes of its own."""
    entry = manifests(spark, folder)[to]
    number = _next(spark, folder)
    done = _point(spark, folder, number, {"models": entry["models"], "changes": None, "base": version(spark, folder)})
    return Outcome(number if done else version(spark, folder), done, [] if done else [f"version {number} was published meanwhile"])


def sweep(spark: SparkSession, folder: str, keep: int | None = None) -> list[str]:
    """Delete what no manifest names, and models of all but the newest ``keep`` versions; run it while no commit is under way. The log is kept."""
    found = manifests(spark, folder)
    newest = sorted(found)[-keep:] if keep else sorted(found)
    named = {"models": {found[v]["models"] for v in newest}, "changes": {e["changes"] for e in found.values()}}
    gone = [f"{what}/{name}" for what, names in named.items() for name in _names(spark, f"{folder}/{what}") if name not in names]
    for at in gone:
        _delete(spark, f"{folder}/{at}")
    return gone


def audit(files: DataFrame, log: DataFrame) -> DataFrame:
    """Releases of the files that no change ever added: id and lab. Empty where files and log agree."""
    added = log.where("kind = 'release_added'").select(F.col("release_id").alias("id")).distinct()
    return star.releases(files).select("id", "lab").join(added, "id", "left_anti")
