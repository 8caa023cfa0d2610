"""Token ids of whole texts with a public tokenizer, for packing and for binary output.

The vocabulary file is read by the driver and broadcast (one file, a few MB).  A text is cut where
white space follows other characters; no token of a byte-level BPE with this pre-tokenizer crosses
such a place, so the ids of the parts, joined, are the ids of the text.  Parts that occur again
are looked up instead of encoded again; the memory for them is bounded.  Texts that hold an added
token of the vocabulary, which is no subject of the BPE, are encoded by the library.

Defined results: a null text is an empty one.
"""

from __future__ import annotations

import re
import struct

import regex

from placegauge.llm.common import made_once

PART_CACHE = 1_200_000
PIECE_CACHE = 1_000_000
CACHED_CHARS = 64  # longer parts and pieces are not remembered
END_ID = 2

# Fixed value: how a byte-level BPE cuts a text before merging.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same on ASCII text, for the faster module.
ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_names() -> dict[int, str]:
    """Character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Recent(dict):
    """Values by key, made when first asked for.  Two halves of ``most`` entries: when the younger one
    is full the older one goes, so keys that keep coming stay."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.half, self.older = most // 2, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.older.get(key, self)
        if value is self:
            value = self.made(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Pieces(Recent):
    """Ids of pieces, encoded by the library's model."""

    def __init__(self, model, most: int) -> None:
        super().__init__(most)
        self.model, self.names = model, byte_names()

    def made(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = [token.id for token in self.model.tokenize(raw.translate(self.names))]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else packed(ids)

    def encode(self, text: str) -> bytes:
        cut = ASCII_PIECES if text.isascii() else PIECES
        return b"".join(map(self.__getitem__, cut.findall(text)))


class Parts(Recent):
    """Ids of parts behind ``lead``; None for one next to whose end no cut is allowed."""

    def __init__(self, pieces: Pieces, lead: str, most: int) -> None:
        super().__init__(most)
        self.pieces, self.lead = pieces, lead

    def made(self, part: str) -> bytes | None:
        if part.isascii() and part.isalpha():
            return self.pieces[self.lead + part]
        odd = not part or part[-1].isspace()
        return None if odd else self.pieces.encode(self.lead + part)


class Encoder:
    """Texts to little-endian 32-bit ids; remembers up to ``most_parts`` parts and ``most_pieces`` pieces."""

    def __init__(
        self, vocabulary: str, most_parts: int = PART_CACHE, most_pieces: int = PIECE_CACHE
    ) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = tuple(token.content for token in added if token.content)
        self.pieces = Pieces(self.tokenizer.model, most_pieces)
        self.heads = Parts(self.pieces, "", most_parts // 4)
        self.words = Parts(self.pieces, " ", most_parts)

    def encode(self, text: str) -> bytes:
        """Ids of one text, by the library alone."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return packed(ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.encode(text)
        head, *words = text.split(" ")
        found = [self.heads[head], *map(self.words.__getitem__, words)]
        try:
            return b"".join(found)
        except TypeError:  # white space next to white space
            return self.pieces.encode(text)


def encoder(
    vocabulary: str, most_parts: int = PART_CACHE, most_pieces: int = PIECE_CACHE
) -> Encoder:
    """The encoder of a vocabulary, made once in each Python worker."""

    def made(vocabulary: str) -> Encoder:
        return Encoder(vocabulary, most_parts, most_pieces)

    return made_once(f"encoder {most_parts} {most_pieces}", vocabulary, made)
