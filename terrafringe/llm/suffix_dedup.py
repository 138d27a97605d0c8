"""Exact removal of repeated byte strings, by suffix sorting of the places that can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafringe.llm.common import chunks, cut, stored, text_bytes
from terrafringe.llm.shingles import mix, prefix_sums, span_hash
from terrafringe.llm.suffix_sort import equal_windows

#: Bytes of the anchors' strings.
GRAM = 24
#: Contexts that one sorting task takes; anchors with more are counted window by window.
TASK = 16384
#: Slots that anchors are counted in, and how far above the mean a slot is hot: at most 1 / `HOT` of the slots come to the driver.
SLOTS, HOT = 1 << 16, 4
#: Bytes of a text that are searched for anchors at a time.
STEP = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, row, first window, context length and the anchor's place in the context.

    Each window of `length` bytes has one anchor, its least string of `GRAM`
    bytes by hash, so that equal windows have equal anchors at the same place.
    The windows of one anchor stand side by side; the context is all they
    cover. About one anchor is left for (length - GRAM) / 2 bytes.
    """
    span = length - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4))
    if len(data) < length:
        return none
    sums = prefix_sums(data)
    start = np.arange(len(data) - GRAM + 1)
    gram = span_hash(sums, start, start + GRAM)
    least = (gram & ~_PLACE) | start.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    if not len(window):
        return none
    place = (least[window] & _PLACE).astype(np.int64)
    head = np.ones(len(window), bool)
    head[1:] = (place[1:] != place[:-1]) | (row[window][1:] != row[window][:-1])
    low = window[head]
    high = window[np.append(np.flatnonzero(head)[1:] - 1, len(window) - 1)]
    place = place[head]
    size = high - low + length
    context = mix(span_hash(sums, low, low + size) + (place - low).astype(np.uint64))
    return gram[place], context, row[low], low, size, place - low


def _all_anchors(column: pa.Array, length: int):
    """`anchors` of a whole column, with first windows relative to the text; long texts are searched in steps."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, STEP):
        base, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - base <= 4 * STEP:
            off = offsets[a : b + 1] - base
            h, c, row, low, size, at = anchors(data[base:end], off, length)
            yield h, c, row + a, low - off[row], size, at
        else:
            for s in range(0, end - base, STEP):
                part = data[base + s : min(base + s + STEP + length - 1, end)]
                h, c, row, low, size, at = anchors(part, np.array([0, len(part)]), length)
                yield h, c, row + a, low + s, size, at


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for h, c, row, low, size, at in _all_anchors(batch.column(1), length):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), nodes[row], low, size.astype(np.int32), at.astype(np.int32))], names=["h", "c", "node", "low", "size", "at"])

    return docs.mapInArrow(run, "h long, c long, node long, low long, size int, at int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (node, h, low, size, at) with the contexts' bytes."""
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("h", "low", "size", "at", "hot")).alias("want"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_doc"))
            want = batch.column("want")
            flat, counts = want.flatten(), np.diff(want.offsets.to_numpy())
            h, low, size, at, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            row = np.repeat(np.arange(len(counts)), counts)
            start = offsets[row] + low
            raw = data.tobytes()
            # A row that shares its id with a longer text may end before a context.
            inside = start + size <= offsets[row + 1]
            for a in range(0, len(h), 20000):
                k = np.flatnonzero(inside[a : a + 20000]) + a
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (h, batch.column("node").to_numpy()[row], low, at)] + [pa.array([raw[s : s + n] for s, n in zip(start[k].tolist(), size[k].tolist(), strict=True)], pa.binary()), pa.array(hot[k])], names=["h", "node", "low", "at", "context", "hot"])

    return docs.join(lists, "node").mapInArrow(run, "h long, node long, low long, at int, context binary, hot boolean")


def _spans(node: np.ndarray, start: np.ndarray, length: int) -> pa.Table:
    """Covered spans of repeated windows, side-by-side windows as one."""
    order = np.lexsort((start, node))
    node, start = node[order], start[order]
    head = np.ones(len(node), bool)
    head[1:] = (node[1:] != node[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(node)) - 1
    return pa.table({"node": pa.array(node[first], pa.int64()), "low": pa.array(start[first], pa.int64()), "size": pa.array(start[last] - start[first] + length, pa.int64())}) if len(node) else pa.table({k: pa.array([], pa.int64()) for k in ("node", "low", "size")})


def _sorted_repeats(contexts: DataFrame, tasks: int, length: int) -> DataFrame:
    """Spans whose windows equal an earlier window of the same anchor, by deep-shallow sorting in each task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("low", "ascending"), ("h", "ascending")])
        h, node, low = (table.column(k).to_numpy() for k in ("h", "node", "low"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1]) | (low[1:] != low[:-1])
        table = table.filter(pa.array(new))
        h, node, low, at = (table.column(k).to_numpy() for k in ("h", "node", "low", "at"))
        data, offsets = text_bytes(table.column("context"))
        counts = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(counts)), counts)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Equal windows have their anchor at the same place.
        group = mix(h[row].view(np.uint64) + (at[row] - shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((shift + low[row], node[row]))
        row, shift, group = row[order], shift[order], group[order]
        first = equal_windows(data, offsets[row] + shift, group, length)
        again = first != np.arange(len(first))
        return _spans(node[row[again]], (low[row] + shift)[again], length)

    return contexts.groupBy(F.pmod(F.xxhash64("h"), F.lit(tasks)).alias("task")).applyInArrow(run, "node long, low long, size long")


def _counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted by their hashes, over all tasks."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            if not len(data):
                continue
            counts = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(counts)), counts)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[row] + shift
            one = span_hash(prefix_sums(data), start, start + length)
            two = span_hash(prefix_sums(data[::-1].copy()), len(data) - start - length, len(data) - start)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row] + shift)], names=["w1", "w2", "node", "low"])

    windows = contexts.select("node", "low", "context").mapInArrow(run, "w1 long, w2 long, node long, low long")
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("node", "low")).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return windows.join(firsts, ["w1", "w2"]).filter(F.struct("node", "low") > F.col("first")).select("node", "low", F.lit(length).cast("long").alias("size"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(node, low, size) of the bytes covered by strings that start earlier, over documents of different texts (node, _doc)."""
    found = stored(_anchor_rows(docs, length)).withColumn("slot", F.pmod("h", F.lit(SLOTS)))
    # Anchors whose slot is far above the mean may be too many for a task; one byte a slot tells them.
    counts = cut(found.groupBy("slot").agg(F.count("*").alias("n")))
    most = HOT * (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS + TASK
    marked = bytearray(SLOTS)
    for row in counts.filter(F.col("n") > most).select("slot").toLocalIterator():
        marked[row.slot] = 1
    is_hot = F.substring(F.lit(bytes(marked)), F.col("slot").cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    place = F.struct("node", "low")
    named = ["h", "c", "node", "low", "size", "at"]
    cold = found.filter(~is_hot).select(*named)
    within, alike = Window.partitionBy("h"), Window.partitionBy("h", "c").orderBy("node", "low")
    cold = cold.withColumn("rank", F.dense_rank().over(alike)).withColumn("row", F.row_number().over(alike)).withColumn("k", F.sum((F.col("row") == 1).cast("long")).over(within))
    # Repeated rows tie with the first place and are it.
    cold = cold.filter("rank > 1 or k > 1").select(*named, (F.col("rank") > 1).alias("later"), "k")
    # The rows of a hot anchor are dealt by their contexts too; how many contexts it has is counted by partial sums.
    hot = found.filter(is_hot).select(*named)
    warm = hot.withColumn("rank", F.dense_rank().over(alike)).withColumn("later", F.col("rank") > 1).drop("rank")
    several = hot.groupBy("h", "c").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    first = warm.filter("not later").join(several.hint("merge"), "h").select(*named, "later", "k")
    warm = warm.filter("later").withColumn("k", F.lit(1).cast("long")).unionByName(first)
    # A context seen before is a repeat as a whole; the first of several different contexts needs its bytes.
    marks = stored(cold.unionByName(warm).select(F.when(~F.col("later"), F.col("h")).alias("h"), "node", "low", "size", "at", (F.col("k") > TASK).alias("hot")))
    wanted = marks.filter("h is not null")
    contexts = _contexts(docs, wanted)
    n = marks.groupBy("hot").agg(F.count("h").alias("n")).collect()
    many = {r["hot"]: r["n"] for r in n}
    parts = [marks.filter("h is null").select("node", "low", F.col("size").cast("long"))]
    if many.get(False):
        parts.append(_sorted_repeats(contexts.filter("not hot"), max(1, -(-many[False] // TASK)), length))
    if many.get(True):
        parts.append(_counted_repeats(contexts.filter("hot"), length))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts earlier.

    Earlier means in a document of a smaller id, or at a smaller place of the
    same one; overlaps count, matches don't cross documents, and all strings
    are judged on the input. Columns: `id_col`, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, with `keep_text`, kept_text
    (without bytes of characters that were cut), then the columns of `docs` named
    in `carry`, each from the row itself.

    Null text counts as empty. Rows that repeat an id and its text are one
    document and get the same result. Where an id has several texts, spans of
    any of them are removed from each as far as it reaches. A row with a null
    id loses nothing and is no one's earlier document. An empty table gives an
    empty table. Ids are integers. Other columns of `docs` are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    carried = [f"_carry{k}" for k in range(len(carry))]
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("_doc"), *[F.col(c).alias(a) for c, a in zip(carry, carried, strict=True)])
    named = own.select("node", "_doc").filter("node is not null")
    digests = named.select("node", F.md5("_doc").alias("md5"), F.octet_length("_doc").alias("n")).filter(F.col("n") >= length)
    firsts = cut(digests.groupBy("md5").agg(F.min("node").alias("first"), F.count("*").alias("k")))
    # Of equal texts the first document is searched; the others go as a whole.
    copied = firsts.filter("k > 1").select("md5", "first")
    copies = digests.join(copied, "md5").filter("node != first").select("node", F.lit(0).cast("long").alias("low"), F.lit(1 << 40).alias("size"))
    heads = named.join(firsts.select(F.col("first").alias("node")).hint("merge"), "node", "left_semi")
    spans = repeated_spans(heads, length).unionByName(copies)
    gathered = spans.groupBy("node").agg(F.flatten(F.collect_list(F.array("low", "size"))).alias("gone"))

    def merged(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column(1).offsets.to_numpy()) // 2)
            order = np.lexsort((flat[:, 0], row))
            row, low = row[order], flat[order, 0]
            top = low + flat[order, 1]
            # The furthest end so far within the row: rows are lifted above each other.
            lift = row * np.int64(1 << 40)
            reach = np.maximum.accumulate(np.minimum(top, (1 << 40) - 1) + lift)
            head = np.ones(len(row), bool)
            head[1:] = low[1:] + lift[1:] > reach[:-1]
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(row)) - 1
            ends = np.stack([low[first], reach[last] - lift[last]], 1).astype("<i8")
            counts = np.bincount(row[first], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.split(ends, np.cumsum(counts)[:-1])], pa.binary())], names=["node", "gone"])

    lists = cut(gathered.mapInArrow(merged, "node long, gone binary"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "") + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            gone = batch.column(2).to_pylist()
            out = []
            for i, cuts in enumerate(gone):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                kept, at, removed, runs = [], 0, 0, 0
                for a, b in np.frombuffer(cuts or b"", "<i8").reshape(-1, 2).tolist():
                    b = min(b, len(raw))
                    if a >= b:
                        continue
                    runs += 1
                    kept.append(raw[at:a])
                    removed += b - a
                    at = b
                kept = b"".join([*kept, raw[at:]])
                row = [len(raw), removed, runs, hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept.decode(errors="ignore")] if keep_text else row)
            columns = list(zip(*out, strict=True)) or [()] * (5 if keep_text else 4)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(columns) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key), *(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *batch.columns[3:]], names=[*names, *carry])

    key = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    return own.join(lists, "node", "left").select("node", "_doc", "gone", *carried).mapInArrow(run, schema)
