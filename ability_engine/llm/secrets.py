"""Secret scans over an incremental ledger of content-addressed texts.

A blob is a distinct text, addressed by its SHA-256; a path is a row that holds it. The ledger keeps, for each blob, the rule versions that it
was scanned with and what they found. A run scans only the (blob, rule version) pairs that the ledger lacks, each once however many paths
share the blob, and joins findings back to all paths.

What is due is found by digests alone: distinct ones, of which a task sends each once, meet those of the ledger, and the result is written down. Where it is up to
``broadcast_rows`` digests it is broadcast to the texts, so only texts that are due leave their task, and none do when nothing is new; beyond that, copies are merged first and
the merged texts meet what is due. Either way copies are merged within each task (a partial aggregate on the digest), so a hot text crosses the shuffle
at most once a task. Findings join paths on the digest; a digest with most of the paths is split by Spark's skew join.

``update`` keeps a ledger in a folder: a run appends what was due, so the next one scans nothing it has seen. Historical versions of a document are
rows of their own (``report`` keeps the columns named in ``path``, say doc_id and version); a version that comes back is an old blob. A run that fails before its
job commits leaves the ledger as it was; a commit that is cut off, or two runs at once, may leave some rows twice, which changes no result.

Defined cases: a null text is the empty text, which has no findings. Rows are paths, so a repeated or null doc_id gets a row each time. Findings
are code point offsets into the whole text, ends exclusive. Other columns are ignored by ``report`` and kept by ``redact``. ``redact`` replaces the
whole match, the name of the secret included, and overlapping matches together; an empty ledger leaves all texts as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import exists, map_lists, stash, struct_of, unused


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind of secret. ``hints``: a text without any of these (lower-cased) bytes can't match."""

    kind: str
    version: int
    pattern: re.Pattern
    hints: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key runs to its END line; where that is cut off, over the lines of base64 that follow.
PEM = re.compile(
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?:(?:(?!-----BEGIN ).)*?-----END \1-----"
    r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:\s*[A-Za-z0-9+/]{24,}={0,2}(?!\S))*(?:\s*[A-Za-z0-9+/]+={1,2}(?!\S)|\s*[A-Za-z0-9+/]+\s*\Z)?)",
    re.S,
)
#: The base kinds, in the order in which findings at one place are listed; then the further kinds.
RULES = (
    Rule("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), 2, 6),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), (b"akia",), 0, 20),
    Rule("hex", 1, re.compile(r"[0-9a-f]+"), (), 0, 24),
    Rule("pem", 2, PEM, (b"private key-----",)),
    Rule("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), (b"eyj",)),
)
BASE = ("assign", "access", "hex")
FINDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("scanned", T.ArrayType(T.StringType())), T.StructField("findings", T.ArrayType(FINDING))])
_HEX = bytes(c in b"0123456789abcdef" for c in range(256))


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, str, int]]:
    """All findings of ``rules`` in a text: (start, kind, rule, end), in the order of start, then of the rules."""
    data = text.encode("utf-8", "surrogatepass")
    low, out = data.lower(), []
    for order, rule in enumerate(rules):
        if rule.kind == "hex":  # a run of n digits covers n // 2 even places in a row
            if b"\1" * (rule.least // 2) not in data[::2].translate(_HEX):
                continue
        elif not any(h in low for h in rule.hints):
            continue
        out += [(m.start(), order, rule.kind, rule.name, m.end()) for m in rule.pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(s, kind, name, e) for s, _, kind, name, e in sorted(out)]


def address(text: Column | str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def due(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and due, the rule versions that ``ledger`` lacks for it; blobs that lack none are left out. Digests only."""
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = ledger.select("blob", F.explode("scanned").alias("rule")).where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    digests = docs.select(address().alias("blob")).distinct().join(seen, "blob", "left")
    return digests.select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 200_000) -> DataFrame:
    """New ledger rows: every blob of ``docs`` with the rule versions that ``ledger`` lacks for it, and their findings."""
    texts = docs.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        names = F.array(*[F.lit(r.name) for r in rules])
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", names)
    else:
        wanted = stash(due(docs, ledger, rules), "due")
        if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
            blobs = texts.join(F.broadcast(wanted), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
        else:
            blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).join(wanted, "blob")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            found = []
            for text, due in zip(b["text"], b["due"], strict=True):
                due = set(due)
                found.append([dict(zip(("start", "kind", "rule", "end"), x, strict=True)) for x in find(text, tuple(r for r in rules if r.name in due))])
            yield {"blob": b["blob"], "scanned": b["due"], "findings": found}

    return map_lists(blobs, run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger in the folder ``path`` lacks, append it, and return the ledger."""
    spark = docs.sparkSession
    old = read_ledger(spark, path) if exists(spark, path) else None
    scan(docs, old, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def _order(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """Sorted by start, then by the order of the rules."""
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    ranked = F.transform(findings, lambda f: F.struct(f["start"].alias("start"), rank[f["kind"]].alias("rank"), f["kind"].alias("kind"), f["end"].alias("end")))
    return F.array_sort(F.array_distinct(ranked))


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of ``docs`` (the ``path`` columns and blob) with the findings that the ledger has for the current rule versions."""
    now = [r.name for r in rules]
    findings = F.filter("findings", lambda f: f["rule"].isin(now))
    hits = ledger.select("blob", findings.alias("findings")).where(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    paths = docs.select(*path, address().alias("blob"))
    none = F.array().cast(T.ArrayType(FINDING))
    return paths.join(hits, "blob", "left").select(*path, "blob", _order(F.coalesce("findings", none), rules).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("findings").alias("spans"))


def redacted(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, at, upto = [], 0, -1
    for start, end in sorted(spans):
        if start >= upto:
            out += [text[at:start], mark]
        at = upto = max(upto, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; n_chars follows. Texts without findings stay as they are."""
    blob, spans = unused(docs, "_blob", "_spans")
    now = [r.name for r in rules]
    pairs = F.transform(F.filter("findings", lambda f: f["rule"].isin(now)), lambda f: F.struct(f["start"], f["end"]))
    hits = ledger.select(F.col("blob").alias(blob), pairs.alias(spans)).where(F.size(spans) > 0).groupBy(blob).agg(F.flatten(F.collect_list(spans)).alias(spans))
    joined = docs.withColumn(blob, address()).join(hits, blob, "left").drop(blob)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            found = b.pop(spans)
            for k, pairs in enumerate(found):
                if pairs and b["text"][k] is not None:
                    b["text"][k] = redacted(b["text"][k], [tuple(p.values()) for p in pairs], mark)
                    if counted:
                        b["n_chars"][k] = len(b["text"][k])
            yield b

    return map_lists(joined, run, docs.schema)
