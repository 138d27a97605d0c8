"""Vectorised byte-pair merge rounds over many words at once."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40


class PairTable:
    """Open-addressing table from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            at = todo[free]
            _, first = np.unique(slot[at], return_index=True)
            won = at[first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            lost = todo[self.keys[slot[todo]] != -1]
            slot[lost] = (slot[lost] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank `NONE` where the pair never merges."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        rank, merged = np.full(len(key), NONE, np.int64), np.zeros(len(key), np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes + 1):
            if not len(todo):
                break
            here = self.keys[slot[todo]]
            hit = here == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[slot[todo[hit]]], self.merged[slot[todo[hit]]]
            todo = todo[~hit & (here != -1)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return rank, merged


def early_pieces(left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """Symbols that can take part in a merge of a better rank than the one that makes them.

    Such a symbol's new pairs must be looked at before the next occurrence of
    its own pair, so only one occurrence of it may be merged in a round.
    """
    made = np.full(int(max(left.max(), right.max(), merged.max())) + 1, -1, np.int64)
    np.maximum.at(made, merged, rank)
    return np.unique(np.concatenate([side[rank <= made[side]] for side in (left, right)]))


def merge_rounds(symbols: np.ndarray, word: np.ndarray, table: PairTable, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the flat symbols of many words to the end; returns symbols and words of what is left.

    Each round finds for every word the least rank among its neighbouring
    pairs (a segmented minimum), merges all leftmost non-overlapping
    occurrences of that rank at the same time, and compacts the arrays. Words
    without a pair leave the working set. `word` is ascending.
    """
    done_s, done_w = [], []
    sym, wrd = symbols.astype(np.int64), word.astype(np.int64)
    rank = merged = None
    while len(sym) > 1:
        same = wrd[1:] == wrd[:-1]
        if rank is None:
            rank, merged = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
            at = np.flatnonzero(same)
            rank[at], merged[at] = table.find(sym[at], sym[at + 1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.append(starts, len(sym)))
        if (idle := least == NONE).any():
            out = np.repeat(idle, counts)
            done_s.append(sym[out])
            done_w.append(wrd[out])
            keep = ~out
            sym, wrd, rank, merged = sym[keep], wrd[keep], rank[keep], merged[keep]
            least, counts = least[~idle], counts[~idle]
            if not len(sym):
                break
        hit = rank == np.repeat(least, counts)
        at = np.flatnonzero(hit)
        # Runs of overlapping hits (aaaa): every second one, from the left.
        head = np.concatenate([[True], np.diff(at) != 1])
        run = np.cumsum(head) - 1
        at = at[(np.arange(len(at)) - np.flatnonzero(head)[run]) % 2 == 0]
        if len(early) and (odd := np.isin(merged[at], early)).any():
            first = np.concatenate([[True], wrd[at][1:] != wrd[at][:-1]])
            at = at[first | ~odd]
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, wrd, rank, merged = sym[keep], wrd[keep], rank[keep], merged[keep]
        new = moved[at]
        touched = np.zeros(len(sym), bool)
        touched[new] = True
        touched[new[new > 0] - 1] = True
        again = np.flatnonzero(touched)
        rank[again] = NONE
        again = again[again + 1 < len(sym)]
        again = again[wrd[again] == wrd[again + 1]]
        rank[again], merged[again] = table.find(sym[again], sym[again + 1])
    done_s.append(sym)
    done_w.append(wrd)
    s, w = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(w, kind="stable")
    return s[order], w[order]
