"""Pre-tokens of whole texts and what a byte-pair tokenizer makes of each, kept in bounded worker tables.

Pre-tokens are found by pattern only in texts of well-known characters, where pattern engines agree; any
other text, and any that spells an added token, goes to the tokenizer whole. Both ways give its result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from tokenizers import Tokenizer

# The letters and numbers among the characters that count as well known.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼½¾"
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-¬®-įı-ſ–—‘’“”…€]")
#: The split patterns of the two vocabulary files, for texts of such characters.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
WORD_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
# Byte-level vocabularies write each byte as a printable character: the printable ones of Latin-1 as they are,
# the others as the characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Values of at most so many pre-tokens are held beside the shared table. Once so many more have found no room,
#: the worker starts afresh.
CACHE_ENTRIES = 150_000
REFUSALS = 3_000_000
#: Longer pre-tokens are not held.
CACHED_CHARS = 64


class Pieces:
    """What ``value`` says of each pre-token: from the shared table, else from this worker's cache."""

    def __init__(self, path: str, pattern: str, value: Callable, lower: bool = False, frequent: dict | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.find = re.compile(pattern).findall
        self.value, self.lower = value, lower
        self.frequent = frequent or {}
        self.known = dict(self.frequent)
        self.passing: list[str] = []
        self.refused = 0

    def plain(self, text: str) -> bool:
        return not _UNUSUAL.search(text) and not any(x in text for x in self.added)

    def split(self, text: str) -> list[str]:
        return self.find(text.lower() if self.lower else text)

    def whole(self, text: str):
        """The tokenizer's own answer for a whole text."""
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def look_up(self, pieces: list[str]) -> dict:
        """A table with an entry for each of ``pieces``."""
        for piece in self.passing:
            del self.known[piece]
        self.passing = []
        missing = set(pieces).difference(self.known)
        merge = self.tokenizer.model.tokenize
        self.known.update(
            (p, self.value([t.id for t in merge(p.encode().decode("latin1").translate(_BYTE_SIGNS))])) for p in missing)
        if len(self.known) > len(self.frequent) + CACHE_ENTRIES:
            # full: these are held for this call only, and the cache starts afresh if that goes on
            self.passing = list(missing)
            self.refused += len(missing)
            if self.refused > REFUSALS:
                self.known, self.passing, self.refused = {**self.frequent, **{p: self.known[p] for p in set(pieces)}}, [], 0
        else:
            self.passing = [p for p in missing if len(p) > CACHED_CHARS]
        return self.known

    def each(self, texts: list[str], combine: Callable) -> list:
        """``combine`` of the values of each text's pre-tokens, in order."""
        plain = [self.plain(t) for t in texts]
        split = [self.split(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        table = self.look_up([p for pieces in split for p in pieces])
        return [
            combine(map(table.__getitem__, pieces)) if ok else self.whole(text)
            for text, ok, pieces in zip(texts, plain, split, strict=True)
        ]


_held: dict[tuple, Pieces] = {}


def held_pieces(name: tuple, make: Callable[[], Pieces]) -> Pieces:
    """The tables of this worker process under ``name``: they outlive a task; another name replaces them."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]
