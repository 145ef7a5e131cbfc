"""Exact byte-level BPE by Aho-Corasick matching and backtracking, and its offset-table decoder.

A byte string cut into tokens t1..tn is its BPE encoding exactly when every adjacent pair is one
that merging alone would also leave side by side (pair compatibility).  The encoder takes the
longest token at each place, keeps it if it is compatible with the token before, else falls back to
shorter ones, marking dead positions; every position is entered a bounded number of times, so long
unbroken runs stay linear.  The same property makes any slice of an encoding, cut between tokens
inside one pre-token, the encoding of its own bytes.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

DEFAULT_DIR = "/opt/tokenizers"
#: Pre-token pattern of the public byte-level vocabularies (fixed value of the file format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_ENTRIES = 300_000
_LOADED: dict[str, "ByteBpe"] = {}


def vocabulary_path(name: str, directory: str | None = None) -> str:
    """Place of a vocabulary file; ``directory`` is a parameter of every query using one."""
    return os.path.join(directory or DEFAULT_DIR, f"{name}.tiktoken")


def _bmp_pattern() -> re.Pattern:
    """``PATTERN`` for texts of the basic plane, its classes spelt out: the same matches, found faster."""
    import regex

    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    letters, numbers = ("".join(f"{m[0]}-{m[-1]}" for m in regex.findall(f"{chr(92)}p{{{k}}}+", plane)) for k in "LN")
    blanks = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class ByteBpe:
    """Encoder and decoder of one rank file (token id = merge rank)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = [b""] * len(pairs)
        for piece, rank in pairs:
            self.tokens[int(rank)] = base64.b64decode(piece)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = b"".join(self.tokens)
        self._prefix = self._shorter_prefixes()
        self._pairs: dict[tuple[int, int], int] = {}
        self._split: list[tuple[int, int]] = []
        self._build_splits()
        self._automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self._automaton.add_word(t.decode("latin-1"), (len(t), i))
        self._automaton.make_automaton()
        self._find_any = regex.compile(PATTERN).findall
        self._find = _bmp_pattern().findall
        self._cache: dict[str, tuple[int, ...]] = {}

    def _shorter_prefixes(self) -> list[int]:
        ids, out = self.ids, []
        for t in self.tokens:
            found = -1
            for n in range(len(t) - 1, 0, -1):
                found = ids.get(t[:n], -1)
                if found >= 0:
                    break
            out.append(found)
        return out

    def _build_splits(self) -> None:
        for i, t in enumerate(self.tokens):
            left = self._prefix[i]
            while left >= 0:
                right = self.ids.get(t[len(self.tokens[left]) :], -1)
                if 0 <= right < i and left < i and self.compatible(left, right):
                    self._pairs[left, right] = i
                    self._split.append((left, right))
                    break
                left = self._prefix[left]
            else:
                self._split.append((i, i))

    def compatible(self, a: int, b: int) -> bool:
        """Would merging leave token ``a`` followed by ``b`` as they are?

        Undo the later of the two tokens' merges step by step; if at any step the two inner
        neighbours form a merge ranked before the one undone, they would have merged instead.
        """
        pairs, split, limit = self._pairs, self._split, 1 << 60
        while True:
            merged = pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a != limit:
                    continue
                first, limit = split[b][0], b + 1
                if first == b:
                    return True
                b = first
            else:
                limit, first = b + 1, split[b][0]
                if first != b:
                    b = first
                    continue
                limit, last = a, split[a][1]
                if last == a:
                    return True
                a = last

    def encode_bytes(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        width = [0] * n
        for end, (size, token) in self._automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > width[start]:
                width[start], longest[start] = size, token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        tokens, prefix = self.tokens, self._prefix
        while pos < n:
            while token >= 0:
                end = pos + len(tokens[token])
                if alive[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                token = prefix[token]
            else:
                alive[pos] = 0
                token = out.pop()
                pos -= len(tokens[token])
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; special-token strings are ordinary text."""
        cache, out = self._cache, []
        get = cache.get
        plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        for piece in (self._find if plain else self._find_any)(text):
            ids = get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode("utf-8", "replace")))
                if len(piece) <= 64:
                    if len(cache) >= _CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode_bytes(self, ids) -> bytes:
        """Bytes of a list of ids, sliced out of one blob by the offset table."""
        off, blob = self.offsets, self.blob
        return b"".join([blob[off[i] : off[i + 1]] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    """One encoder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
