"""Packing documents into token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrafringe.llm.common import chunks, text_bytes
from terrafringe.llm.word_bpe import tokenizer

#: A piece: (document, start, length).
Piece = tuple[int, int, int]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, taken from `counts`, whose sum is the largest up to `capacity`.

    A bitset holds all reachable sums; every copy of a length shifts it by
    that length. The sets before each step allow the way back to the counts.
    """
    reach, full, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            more = (reach | reach << length) & full
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


class Packer:
    """Fills sequences of `capacity` ids from a stream of documents.

    Whole sequences are cut off long documents; the rests gather in a window
    of `window` pieces. Each sequence of a window takes its longest piece and
    the multiset of others that leaves the least slack. Sequences that stay
    over `slack` short wait for the next window. At the end the longest
    waiting piece is cut to fill what is left, and the last sequence is cut to
    powers of two, which need no padding.
    """

    def __init__(self, capacity: int, window: int = 1024, slack: int = 0):
        self.capacity, self.window, self.slack = capacity, window, slack
        self.waiting: dict[int, list[Piece]] = {}
        self.size = 0

    def _put(self, piece: Piece) -> None:
        self.waiting.setdefault(piece[2], []).append(piece)
        self.size += 1

    def _take(self, length: int) -> Piece:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.size -= 1
        return piece

    def add(self, doc: int, tokens: int) -> Iterator[list[Piece]]:
        """Take a document; yields the sequences that are complete now."""
        whole = tokens // self.capacity
        for k in range(whole):
            yield [(doc, k * self.capacity, self.capacity)]
        if rest := tokens - whole * self.capacity:
            self._put((doc, whole * self.capacity, rest))
        if self.size >= self.window:
            yield from self._pack(self.window // 2)

    def _best(self) -> list[Piece]:
        first = self._take(max(self.waiting))
        used = fullest({n: len(p) for n, p in self.waiting.items()}, self.capacity - first[2])
        return [first, *(self._take(n) for n, k in used.items() for _ in range(k))]

    def _pack(self, leave: int) -> Iterator[list[Piece]]:
        short = []
        while self.size > leave:
            sequence = self._best()
            if self.capacity - sum(p[2] for p in sequence) <= self.slack:
                yield sequence
            else:
                short.append(sequence)
        if len(short) > self.window // 8:
            # Lengths that don't add up: fill the slack by cutting.
            for sequence in short:
                yield self._filled(sequence)
        else:
            for sequence in short:
                for piece in sequence:
                    self._put(piece)

    def _filled(self, sequence: list[Piece]) -> list[Piece]:
        room = self.capacity - sum(p[2] for p in sequence)
        while room and self.size:
            doc, start, length = self._take(max(self.waiting))
            sequence.append((doc, start, min(room, length)))
            if length > room:
                self._put((doc, start + room, length - room))
            room -= sequence[-1][2]
        return sequence

    def finish(self) -> Iterator[list[Piece]]:
        """The sequences of all that still waits."""
        while self.size:
            sequence = self._filled(self._best())
            total = sum(p[2] for p in sequence)
            while total:
                # The whole of a full sequence, else powers of two.
                goal = self.capacity if total == self.capacity else 1 << total.bit_length() - 1
                part, sequence = _cut(sequence, goal)
                total -= goal
                yield part


def _cut(sequence: list[Piece], length: int) -> tuple[list[Piece], list[Piece]]:
    head, rest = [], []
    for doc, start, n in sequence:
        k = min(n, length)
        length -= k
        if k:
            head.append((doc, start, k))
        if n > k:
            rest.append((doc, start + k, n - k))
    return head, rest


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise every text (null: empty), add `end_id`, and pack the ids into sequences.

    One row per piece: `id_col`, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with `keep_ids`, ids. Sequences are made within
    the input's partitions, so nothing is shuffled and hot keys don't matter;
    sequence ids are the partition's number times 2^40 plus a count. A repeated
    row is packed as another document. Each piece is sent on as soon as its
    document is tokenised, except for the at most `window` waiting rests, whose
    ids stay in memory. An empty table gives no rows; null ids are kept; other
    columns of `docs` are not read. `capacity` is a power of two.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        encode = tokenizer(tokenizer_path)
        packer = Packer(capacity)
        sequence = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # document number to [key, ids of the rest, where that begins, tokens, ids that are not placed]
        number, rows = 0, []

        def place(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in pieces:
                own = held[doc]
                ids = own[1][start - own[2] : start - own[2] + length]
                row = (own[0], start, length, zlib.crc32(ids), own[3], sequence, offset)
                rows.append((*row, ids.tolist()) if keep_ids else row)
                offset += length
                own[4] -= length
                if not own[4]:
                    del held[doc]
            sequence += 1

        def sent():
            columns = list(zip(*rows, strict=True)) or [()] * (8 if keep_ids else 7)
            types = [key_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])
            rows.clear()
            return batch

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            _, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                keys = batch.column(0).slice(a, b - a).to_pylist()
                ids, sizes = encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                at = 0
                for key, n in zip(keys, sizes.tolist(), strict=True):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    held[number] = [key, own, 0, n + 1, n + 1]
                    whole = (n + 1) // capacity * capacity
                    for pieces in packer.add(number, n + 1):
                        place(pieces)
                    if number in held and whole:
                        held[number][1], held[number][2] = own[whole:].copy(), whole
                    number += 1
                if rows:
                    yield sent()
        for pieces in packer.finish():
            place(pieces)
        if rows:
            yield sent()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
