"""Ids of words, remembered between batches within a bounded table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Index(dict):
    """Word to running number; new words are noted in order."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordMemo:
    """Maps texts, given as lists of words, to flat ids.

    `encode` turns a list of distinct words into (flat ids, lengths). The table
    is emptied when it holds over `most` words or `most_chars` characters, so
    memory stays bounded whatever the corpus; results don't depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000, most_chars: int = 12_000_000):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.index, self.chars = _Index(), 0
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0
        self.start, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def _grow(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            more = np.zeros(max(need, 2 * len(have)), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if len(self.index) > self.most or self.chars > self.most_chars:
            self.clear()
        known = len(self.index)
        find = self.index.__getitem__
        numbers = [np.fromiter(map(find, words), np.int64, len(words)) for words in texts]
        if new := self.index.new:
            self.index.new = []
            flat, lengths = self.encode(new)
            self.chars += sum(map(len, new))
            self._grow("ids", self.used + len(flat))
            self._grow("start", known + len(new))
            self._grow("length", known + len(new))
            self.ids[self.used : self.used + len(flat)] = flat
            self.length[known : known + len(new)] = lengths
            self.start[known : known + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(flat)
        out, sizes = [], np.zeros(len(texts), np.int64)
        for i, at in enumerate(numbers):
            n = self.length[at]
            total = int(n.sum())
            ends = np.cumsum(n)
            out.append(self.ids[np.arange(total) + np.repeat(self.start[at] - (ends - n), n)])
            sizes[i] = total
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes
