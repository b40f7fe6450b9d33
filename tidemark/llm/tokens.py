"""Tokenizing through bounded caches, equal to encode(text, add_special_tokens=False).

The public word BPE drops whitespace and never merges across it or across its
pre-token pattern, so a text's ids are its pre-tokens' ids in order. Pre-tokens
repeat far more often than texts do: texts of plain characters are cut by one
pattern and looked up. Other texts are cut at whitespace, and chunks that are not
plain go to the library. A vocabulary file of another kind is used through the
library's own encode.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Entries of each cache generation; two generations are held. Bounds memory, never results.
PIECE_ENTRIES, CHUNK_ENTRIES = 500_000, 100_000
#: Longer chunks are encoded each time and not kept.
CACHE_CHARS = 64

# The pipeline of the word BPE file, which the fast path stands for.
_WHITE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_NORMALIZERS = [{"type": "NFC"}, _WHITE, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Characters whose NFC form, lower case and class are the same in Python and in the library.
_PLAIN = re.compile("[\x21-\x7eÀ-ÿ]+")
_LETTERS = "a-zß-öø-ÿ"
_PLAIN_TEXT = re.compile("[ \t\n\r\x21-\x7eÀ-ÿ]*")
#: The alternatives of _SPLIT over plain lower-case text; only the last two start alike.
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\r{_LETTERS}0-9]+")
#: Python's split() also cuts at these, which the pattern takes as ordinary characters.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_ASCII_WHITE = re.compile("[ \t\n\r]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_FEW = [struct.Struct(f"<{n}I").pack for n in range(17)]


def _packed(ids: list[int]) -> bytes:
    return _FEW[len(ids)](*ids) if len(ids) < len(_FEW) else struct.pack(f"<{len(ids)}I", *ids)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """A dict that makes what it lacks, in two generations: the older one goes when the younger is full."""

    def __init__(self, make: Callable[[str], bytes], entries: int):
        super().__init__()
        self._make, self._entries, self._old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        got = self._old.get(key)
        if got is None:
            got = self._make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self._entries:
                self._old = dict(self)
                self.clear()
            self[key] = got
        return got


class WordTokenizer:
    """Encodes texts to uint32 ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self._cuts = (
            (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and steps[0].get("pattern") == {"Regex": _SPLIT}
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and not steps[1]["add_prefix_space"]
        )
        self._model = self._tok.model
        self._chars = _byte_chars()
        self._piece = _Cache(self._make_piece, PIECE_ENTRIES).__getitem__
        self._chunk = _Cache(self._make_chunk, CHUNK_ENTRIES).__getitem__

    def _make_piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self._chars.__getitem__, piece.encode()))
        return _packed([t.id for t in self._model.tokenize(shown)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece, _PIECES.findall(text.lower())))

    def _make_chunk(self, chunk: str) -> bytes:
        return self._plain(chunk) if _PLAIN.fullmatch(chunk) else _packed(self._tok.encode(chunk, add_special_tokens=False).ids)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self._cuts:
            return _packed(self._tok.encode(text, add_special_tokens=False).ids)
        if _PLAIN_TEXT.fullmatch(text):
            return self._plain(text)
        parts = _ASCII_WHITE.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self._chunk, filter(None, parts)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
