"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrafringe.llm.bpe import PairTable, early_pieces, merge_rounds
from terrafringe.llm.common import chunks, text_bytes
from terrafringe.llm.memo import WordMemo

SPACE = "▁"
_MODELS: dict[str, "BpeModel"] = {}


class BpeModel:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix.

    The vocabulary is read through the sentencepiece library; segmentation and
    detokenisation are done here. Words are cut before each run of spaces,
    which is exact because no piece of the vocabulary holds a space mark after
    another character (checked on loading).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  Aä ﬁ ") != SPACE * 3 + "Aä" + SPACE + "ﬁ" + SPACE:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        self.pieces = sp.id_to_piece(list(range(n)))
        odd = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        byte = {i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.full(256, self.unk, np.int64)
        for i in byte:
            self.byte_id[int(self.pieces[i][3:5], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if i not in odd and i not in byte}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that hold a space after another character are not supported")
        score = sp.get_score(list(range(n)))
        # Symbols: vocabulary ids, then characters outside of the vocabulary.
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        outside: dict[str, int] = {}
        pairs = []

        def symbol(part: str) -> int | None:
            if part in ids or len(part) > 1:
                return ids.get(part)
            return outside.setdefault(part, n + len(outside))

        for p, i in ids.items():
            for k in range(1, len(p)):
                x, y = symbol(p[:k]), symbol(p[k:])
                if x is not None and y is not None:
                    pairs.append((x, y, i))
        left, right, merged = np.array(pairs, np.int64).T
        order = np.argsort(-np.array(score), kind="stable")
        rank_of = np.empty(n, np.int64)
        rank_of[order] = np.arange(n)
        rank = rank_of[merged]
        self.table, self.early = PairTable(left, right, rank, merged), early_pieces(left, right, rank, merged)
        self.char_id |= outside
        self.n = n
        # Code point to symbol: a table for the low planes and a dict for the rest.
        self.low = np.full(0x10000, -1, np.int64)
        for c, i in self.char_id.items():
            if ord(c) < 0x10000:
                self.low[ord(c)] = i
        self.text = [("" if i in odd else p.replace(SPACE, " ")).encode() for i, p in enumerate(self.pieces)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in byte}
        self.unk_text = " ⁇ ".encode()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word; spaces are already marks."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = np.where(points < 0x10000, self.low[np.minimum(points, 0xFFFF)], -1)
        for at in np.flatnonzero(points >= 0x10000):
            sym[at] = self.char_id.get(chr(points[at]), -1)
        # A character that no pair knows keeps its code point, above all other symbols.
        known = sym >= 0
        sym = np.where(known, sym, points + (1 << 24))
        sym, word = merge_rounds(sym, word, self.table, self.early)
        outside = np.flatnonzero(sym >= self.n)
        if len(outside):
            back = {i: c for c, i in self.char_id.items() if i >= self.n}
            chars = [back[s] if s < 1 << 24 else chr(s - (1 << 24)) for s in sym[outside].tolist()]
            data = [self.byte_id[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)] for c in chars]
            times = np.ones(len(sym), np.int64)
            times[outside] = [len(d) for d in data]
            first = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            for d, a in zip(data, first[outside].tolist(), strict=True):
                sym[a : a + len(d)] = d
        return sym, np.bincount(word, minlength=len(words))

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text: byte runs are joined, invalid bytes become U+FFFD, the dummy space goes."""
        out, run, first = [], bytearray(), True
        for i in ids.tolist():
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                out.append(_valid(bytes(run)))
                run.clear()
            if i == self.unk:
                out.append(self.unk_text)
                first = False
            elif i not in (self.bos, self.eos):
                t = self.text[i]
                out.append(t[1:] if first and t.startswith(b" ") else t)
                first = False
        if run:
            out.append(_valid(bytes(run)))
        return b"".join(out)


def _valid(data: bytes) -> bytes:
    """`data` with one U+FFFD for each byte that is no part of a valid UTF-8 character."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode().encode() if i + n <= len(data) else b"")
                if out[-1]:
                    i += n
                    break
                out.pop()
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def model(path: str) -> BpeModel:
    """The model of `path`, loaded once in a process."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


def split_words(text: str) -> list[str]:
    """Cut the marked text before each run of spaces; empty text has no words."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 not in marked:
        return [SPACE + w for w in marked[1:].split(SPACE)]
    return [w for w in _WORD.findall(marked) if w]


class Codec:
    """Encodes and decodes batches of texts with a bounded memory of words."""

    LONG = 200

    def __init__(self, path: str):
        self.model = model(path)
        self.decoded: dict[bytes, bytes] = {}
        self.memo = WordMemo(self._encode)
        self.words: list[bytes] = []

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.model.encode_words(words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, without begin and end, and the number of ids of each text."""
        return self.memo([split_words(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        """As `BpeModel.decode_ids`, by a table of piece bytes where no byte or unknown id occurs."""
        m = self.model
        if not hasattr(self, "flat"):
            # A byte piece below 0x80 is a whole character; the others need their neighbours.
            texts = [bytes([m.byte_of[i]]) if m.byte_of.get(i, 0x80) < 0x80 else t for i, t in enumerate(m.text)]
            lengths = np.array([len(t) for t in texts], np.int64)
            self.flat = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths
            self.plain = np.ones(m.n, bool)
            self.plain[[m.unk, *(i for i, x in m.byte_of.items() if x >= 0x80)]] = False
        shown = ids[1:] if len(ids) and ids[0] == m.bos else ids
        shown = shown[:-1] if len(shown) and shown[-1] == m.eos else shown
        if ((shown == m.bos) | (shown == m.eos)).any():
            return m.decode_ids(ids)
        lead = len(shown) and shown[0] not in m.byte_of and m.text[shown[0]][:1] == b" "
        odd = ~self.plain[shown]
        if odd.any():
            edge = np.flatnonzero(np.diff(odd)) + 1
            parts = [shown[a:b] for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(shown)], strict=True)]
            out = b"".join(m.decode_ids(part) if k % 2 ^ int(odd[0]) else self._table(part) for k, part in enumerate(parts))
        else:
            out = self._table(shown)
        return out[1:] if lead else out

    def _table(self, ids: np.ndarray) -> bytes:
        data, start, lengths = self.flat
        n = lengths[ids]
        ends = np.cumsum(n)
        return data[np.arange(int(n.sum())) + np.repeat(start[ids] - (ends - n), n)].tobytes()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text (null: empty) with begin and end ids, decode the ids again, and return digests.

    Columns: `id_col`, n_tokens, ids_sha256, decoded_sha256 and, with
    `keep_ids`, ids (array of int) and decoded (string). One row per input row,
    repeated rows included; an empty table gives an empty table; no shuffle.
    Other columns of `docs` are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches):
        codec = Codec(path)
        bos, eos = np.array([codec.model.bos], "<u4"), np.array([codec.model.eos], "<u4")
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for a, b in chunks(offsets):
                ids, sizes = codec.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                rows, at = [], 0
                for n in sizes.tolist():
                    own = np.concatenate([bos, ids[at : at + n].astype("<u4"), eos])
                    at += n
                    plain = codec.decode(own)
                    row = [len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(plain).hexdigest()]
                    rows.append([*row, own.astype(np.int32).tolist(), plain.decode()] if keep_ids else row)
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
