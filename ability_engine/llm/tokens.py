"""Token ids by public tokenizers, with a bounded memo of the pieces that a text falls into.

A tokenizer works on each piece (a run of letters, digits or signs) on its own, so a piece that was seen before needs no second look.
Texts outside Latin-1, or with control characters that libraries class differently, are encoded whole by the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import public_tokenizers
from tokenizers import Tokenizer

# Latin-1 classes: letters (L), numbers (N), white space (S).
_L = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = rb"0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_S = rb"\x09-\x0d\x20\xa0"
_ENDINGS = rb"'(?:s|t|re|ve|m|ll|d)"
#: The split patterns of the two tokenizers, for Latin-1 text.
PIECES = {
    "byte_bpe_50k.json": re.compile(rb"%b| ?[%b]+| ?[%b]+| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (_ENDINGS, _L, _N, _S, _L, _N, _S, _S, _S)),
    "word_bpe_49k.json": re.compile(rb"%b|[%b]+|[%b]|[^%b%b%b]+" % (_ENDINGS, _L, _N, _S, _L, _N)),
}
#: Characters that libraries class differently.
_UNSURE = bytes([*range(0x1C, 0x20), 0x85])


#: Byte-level vocabularies spell each byte as a printable character: itself, or the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LOWERED = {"word_bpe_49k.json"}


class Encoder(dict):
    """``encode(text)``: ids as little-endian unsigned 16-bit bytes. As a dict: the pieces seen lately, ``memo`` at most."""

    def __init__(self, name: str, memo: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name}: ids of more than 16 bits")
        self.pattern, self.lowered, self.memo = PIECES[name], name in _LOWERED, memo
        self.merge = self.tokenizer.model.tokenize

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        out = array("H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        """A text by the whole tokenizer."""
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: bytes) -> bytes:
        """A piece by the tokenizer's merges alone."""
        text = piece.decode("latin-1")
        text = text.lower() if self.lowered else text
        ids = self.pack([t.id for t in self.merge(text.encode().decode("latin-1").translate(_SPELL))])
        if len(self) >= self.memo:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if len(data.translate(None, _UNSURE)) != len(data):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.pattern.findall(data)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each tokenizer and Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
