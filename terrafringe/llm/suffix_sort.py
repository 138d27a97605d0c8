"""Deep-shallow sorting of fixed-length windows of a byte text, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at before the blind tries take over.
SHALLOW = 32


def _word(data: np.ndarray, pos: np.ndarray, w: int, length: int) -> np.ndarray:
    """Bytes 8w to 8w + 8 of each window as a big-endian number; bytes beyond the window are zero."""
    key = np.zeros(len(pos), np.uint64)
    for k in range(8 * w, min(8 * w + 8, length)):
        key = key << np.uint64(8) | data[pos + k].astype(np.uint64)
    return key << np.uint64(8 * max(0, 8 * w + 8 - length))


def _regroup(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, keys), stable, and the new group numbers in that order."""
    order = np.lexsort((*keys[::-1], group))
    new = np.zeros(len(order), bool)
    for k in (group, *keys):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def _shared(group: np.ndarray) -> np.ndarray:
    """Whether each member's group has two or more members; groups are contiguous."""
    edge = np.ones(len(group) + 1, bool)
    edge[1:-1] = group[1:] != group[:-1]
    return ~(edge[:-1] & edge[1:])


def equal_windows(data: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each window data[pos : pos + length] the number of the first equal window of its group.

    Windows without an equal one get their own number; "first" is by position
    in `pos`. First, multikey quicksort splits the groups by eight bytes at a
    time down to `SHALLOW` bytes; windows left alone are done. Then each group
    builds its blind trie from the top: all members are compared with one leaf,
    those equal to it are its class, and the others branch by the position of
    the first difference and the byte there, without looking at bytes above
    again. All groups do this at the same time.
    """
    first = np.arange(len(pos))
    order, grp = _regroup(group)
    at = order
    for w in range(-(-min(SHALLOW, length) // 8)):
        keep = _shared(grp)
        at, grp = at[keep], grp[keep]
        if not len(at):
            return first
        order, grp = _regroup(grp, _word(data, pos[at], w, length))
        at = at[order]
    words = -(-length // 8)
    while True:
        keep = _shared(grp)
        at, grp = at[keep], grp[keep]
        if not len(at):
            return first
        start = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        leaf = np.repeat(at[start], np.diff(np.append(start, len(at))))
        byte, branch = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for w in range(SHALLOW // 8, words):
            own, other = _word(data, pos[at[open_]], w, length), _word(data, pos[leaf[open_]], w, length)
            differ = own != other
            if differ.any():
                x = (own ^ other)[differ]
                # The first byte that differs, from the top.
                lead = np.zeros(len(x), np.int64)
                for k in range(1, 8):
                    lead += (x >> np.uint64(64 - 8 * k)) == 0
                here = open_[differ]
                byte[here] = 8 * w + lead
                branch[here] = data[pos[at[here]] + byte[here]]
            open_ = open_[~differ]
        first[at[open_]] = leaf[open_]
        rest = byte >= 0
        at, order_grp = at[rest], grp[rest]
        if not len(at):
            return first
        order, grp = _regroup(order_grp, byte[rest], branch[rest])
        at = at[order]
