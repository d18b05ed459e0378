"""A stream source of access logs: lines of growing files by byte offsets, and their truncation once lines are counted.

``spark.dataSource.register(AccessLogs)``, then ``spark.readStream.format("access_logs").option("path", folder)``. The folder is one that the driver and all executors see;
each file in it is the log of one server, which keeps appending. An offset holds, for each file, how many bytes were ever written up to the last whole line;
a partition is a range of bytes of one file, cut at line ends, so a log of any size is read by many tasks.

``settle`` truncates logs after the query's lines are safe. A log that has grown since is left as it is, for its new lines aren't counted, unless it has passed ``MOST`` bytes:
a handful of lost lines beats a log that never shrinks. What a log had before a truncation is kept beside it, in a file that is
replaced as a whole before the log is cut, with a digest of what will be cut. If the process dies in between, the next run sees that the log
still begins with that, and goes on with the old count: nothing is lost, nothing read twice.
"""

from __future__ import annotations

import ast
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: a log beyond this size is truncated even if it grows.
MOST = 8 * 1024 * 1024
SPLIT = 1024 * 1024
MARK = ".offset"


def _digest(path: str, size: int) -> int:
    found = 0
    with open(path, "rb") as f:
        while size > 0 and (part := f.read(min(SPLIT, size))):
            found, size = zlib.crc32(part, found), size - len(part)
    return found if size == 0 else -1


def base(path: str) -> int:
    """Bytes of a log that were cut off before what it holds now."""
    try:
        with open(path + MARK) as f:
            mark = json.load(f)
    except FileNotFoundError:
        return 0
    if mark["cut"] and os.path.getsize(path) >= mark["cut"] and _digest(path, mark["cut"]) == mark["digest"]:
        return mark["base"] - mark["cut"]  # it wasn't cut after all
    return mark["base"]


def whole_lines(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - SPLIT)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def logs(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if not n.endswith((MARK, ".tmp")) and not n.startswith(("_", ".")) and os.path.isfile(os.path.join(folder, n)))


def truncate(path: str, read: int, most: int = MOST) -> bool:
    """Cut a log off after ``read`` bytes of it (in its own count) were counted; False where it has grown and isn't too large."""
    size = os.path.getsize(path)
    if size == 0 or size != read and size <= most:
        return False
    mark = {"base": base(path) + size, "cut": size, "digest": _digest(path, size)}
    with open(path + MARK + ".tmp", "w") as f:
        json.dump(mark, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + MARK + ".tmp", path + MARK)
    os.truncate(path, 0)
    return True


def settle(folder: str, offset: dict[str, int], most: int = MOST) -> list[str]:
    """Truncate every log of the folder whose lines up to ``offset`` are safe; the names of those that were."""
    done = []
    for name in logs(folder):
        path = os.path.join(folder, name)
        if name in offset and truncate(path, offset[name] - base(path), most):
            done.append(name)
    return done


def read_offset(query) -> dict[str, int]:
    """Up to where a finished query has read, by log."""
    progress = [p for p in query.recentProgress if p["sources"] and p["sources"][0]["endOffset"]]
    found = progress[-1]["sources"][0]["endOffset"] if progress else {}
    return ast.literal_eval(found) if isinstance(found, str) else dict(found)  # progress spells offsets as Python or JSON does


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for name in logs(self.folder):
            path = os.path.join(self.folder, name)
            found[name] = base(path) + whole_lines(path)
        return found

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for name, upto in sorted(end.items()):
            path = os.path.join(self.folder, name)
            before = base(path)
            first, last = max(0, start.get(name, 0) - before), upto - before
            out += [Span(path, at, min(at + SPLIT, last)) for at in range(first, last, SPLIT)]
        return out

    def read(self, partition: Span) -> Iterator[tuple[str, str]]:
        """Lines that begin in the partition's range: one that runs over its end belongs to it."""
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()  # the rest of a line of the range before
            while f.tell() < partition.end and (line := f.readline()):
                yield name, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Nothing: a sink may still be at work on what lies before ``end``. ``settle`` truncates after the query has ended."""


class AccessLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "access_logs"

    def schema(self) -> str:
        return "log string, value string"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"])
