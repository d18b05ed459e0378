"""Chat formatting with typed content parts.

A turn has a role and content parts: text, image, audio or document. A visitor flattens them, in order, into one string; what isn't text becomes a
placeholder, and its reference and the number of tokens that it expands to are recorded. Template of a turn::

    [ROLE]user[/ROLE]...parts...</s>

Inside roles and texts every backslash is doubled, and one is put after the first character of each control string, so no control string is
left in them and ``unescape`` gives the text back. The loss mask is a list of spans of the formatted turn: the text parts of assistants.

Turns are formatted where they lie. Reading back sorts each conversation's turns within its partition and streams over them with running digests, so a
conversation of any length takes constant memory.

Defined cases: null roles and texts are empty; a null list of parts has none. Turns with equal numbers are ordered by their formatted text, and
repeated rows stay. A null conv_id is one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ability_engine.llm.common import map_lists, struct_of

PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = ("[ROLE]", "[/ROLE]", "</s>", "<s>", "[INST]", "[/INST]", *PLACEHOLDERS.values())
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_BREAK = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[ROLE\](.*?)\[/ROLE\](.*)</s>", re.S)

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])
ATTACHMENT = T.StructType([T.StructField("at", T.LongType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BREAK.sub(r"\1", text)


class Flatten:
    """Visitor of the parts of one turn. ``patch``: pixels of an image token's side; ``rate``: audio tokens a second; ``page``: tokens of a page."""

    def __init__(self, role: str, patch: int = 28, rate: float = 25.0, page: int = 512):
        self.out, self.size, self.role = [], 0, role
        self.patch, self.rate, self.page = patch, rate, page
        self.attachments: list[dict] = []
        self.loss: list[dict] = []
        self._put(f"[ROLE]{escape(role)}[/ROLE]")

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", *PLACEHOLDERS):
            raise ValueError(f"unknown kind of part: {kind}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        start = self.size
        self._put(escape(part.get("text") or ""))
        if self.role == "assistant":
            self.loss.append({"start": start, "end": self.size})

    def _attach(self, kind: str, part: dict, tokens: float) -> None:
        self.attachments.append({"at": self.size, "type": kind, "ref": part.get("ref"), "tokens": max(1, math.ceil(tokens))})
        self._put(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, (part.get("seconds") or 0) * self.rate)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page)

    def close(self) -> str:
        self._put("</s>")
        return "".join(self.out)


def format_turns(turns: DataFrame, **sizes: float) -> DataFrame:
    """conv_id, turn, the formatted turn, its loss spans, attachments and the number of tokens that placeholders expand to.

    ``turns`` has conv_id, turn, role, and ``parts`` (PART) or else ``text``.
    """
    typed = "parts" in turns.columns
    schema = struct_of(("conv_id", turns.schema["conv_id"].dataType), ("turn", turns.schema["turn"].dataType), ("formatted", T.StringType()), ("loss", T.ArrayType(SPAN)), ("attachments", T.ArrayType(ATTACHMENT)), ("expanded_tokens", T.LongType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {"conv_id": b["conv_id"], "turn": b["turn"], "formatted": [], "loss": [], "attachments": [], "expanded_tokens": []}
            for role, content in zip(b["role"], b["parts" if typed else "text"], strict=True):
                flat = Flatten(role or "", **sizes)
                for part in (content or []) if typed else [{"type": "text", "text": content}]:
                    flat.visit(part)
                out["formatted"].append(flat.close())
                out["loss"].append(flat.loss)
                out["attachments"].append(flat.attachments)
                out["expanded_tokens"].append(sum(a["tokens"] for a in flat.attachments))
            yield out

    return map_lists(turns.select("conv_id", "turn", "role", "parts" if typed else "text"), run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text as they are."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation: its turns and loss text, parsed from the formatted turns, as counts and digests."""
    schema = struct_of(("conv_id", formatted.schema["conv_id"].dataType), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        rows: list[tuple] = []
        conv, n, chars, loss_chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for b in batches:
            for conv_id, text, spans in zip(b["conv_id"], b["formatted"], b["loss"], strict=True):
                if n and conv_id != conv:
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                conv, n, chars = conv_id, n + 1, chars + len(text)
                role, content = parse_turn(text)
                turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    part = unescape(text[s["start"] : s["end"]])
                    loss_chars += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
            if len(rows) >= 5000:
                yield dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))
                rows = []
        if n:
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if rows:
            yield dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return map_lists(ordered.select("conv_id", "formatted", "loss"), run, schema)
