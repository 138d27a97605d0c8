"""Ids of a lower-casing word BPE tokenizer (a `tokenizers` file), with a bounded memory of words."""

from __future__ import annotations

import json
import re

import numpy as np

from terrafringe.llm.bpe import PairTable, early_pieces, merge_rounds
from terrafringe.llm.memo import WordMemo

#: Two ASCII or Latin-1 signs or controls side by side: a run of signs, which must stay whole.
_SIGNS = re.compile(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\xbf×÷]{2}")
#: A run of signs between a letter and white space.
_TAIL = re.compile(r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(?=[ \n]|$)")
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_chars() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 for itself, the others from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """The ids of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`.

    Texts are cut at spaces, tabs and line ends, which no token spans. Cut
    words of lower-case Latin letters are merged here, in vectorised rounds;
    all others go to the library. Both are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            bpe = json.load(f)["model"]
        vocab, merges, suffix = bpe["vocab"], bpe["merges"], bpe["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, merged = (np.array([vocab[f(a, b)] for a, b in pairs], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        rank = np.arange(len(pairs), dtype=np.int64)
        self.table, self.early = PairTable(left, right, rank, merged), early_pieces(left, right, rank, merged)
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.memo = WordMemo(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((_PLAIN(w) is not None for w in words), bool, len(words))
        lengths, parts = np.zeros(len(words), np.int64), []
        at = np.flatnonzero(plain)
        if len(at):
            data = [words[i].encode() for i in at.tolist()]
            size = np.fromiter(map(len, data), np.int64, len(data))
            raw = np.frombuffer(b"".join(data), np.uint8)
            sym = self.inner[raw]
            end = np.cumsum(size) - 1
            sym[end] = self.last[raw[end]]
            ids, word = merge_rounds(sym, np.repeat(at, size), self.table, self.early)
            parts.append((word, ids))
            lengths += np.bincount(word, minlength=len(words))
        at = np.flatnonzero(~plain)
        if len(at):
            found = [e.ids for e in self.lib.encode_batch_fast([words[i] for i in at.tolist()], add_special_tokens=False)]
            lengths[at] = [len(x) for x in found]
            parts.append((np.repeat(at, lengths[at]), np.array([i for x in found for i in x], np.int64)))
        word, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.argsort(word, kind="stable")], lengths

    @staticmethod
    def split(text: str) -> list[str]:
        """Words whose ids, one after the other, are the text's; case and signs are taken off where that is exact."""
        try:
            text.encode("latin-1")
            narrow = "<|" not in text
        except UnicodeEncodeError:
            narrow = False
        if narrow:
            # Latin-1 is composed already, and lower case maps it character by character.
            text = text.lower()
            text = _TAIL.sub(r"\1 \2 ", text) if _SIGNS.search(text) else text.replace(".", " . ").replace(",", " , ")
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number for each text."""
        return self.memo([self.split(t) for t in texts])


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of `path`, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
