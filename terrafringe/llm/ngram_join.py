"""Near-duplicate documents: an exact Jaccard join of word shingle sets by prefix trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafringe.llm.common import cut, stored
from terrafringe.llm.components import components
from terrafringe.llm.prefix_tree import Forest, PrefixTree
from terrafringe.llm.shingles import mix, row_sets

#: Counters of the frequency sketch that orders the shingles.
SKETCH = 1 << 20
#: A shingle is frequent if its counter is over this many times the mean.
FREQUENT = 4
#: Most sets in one prefix tree; larger groups are split.
TREE = 256


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64) & (SKETCH - 1)


def frequent_slots(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """The counters, over the shingles of all documents, that are far above the mean: a bitmap of `SKETCH` bits.

    It only moves frequent shingles to the end of the global order; a counter
    shared by chance does no harm. At most 1 / `FREQUENT` of the counters come
    to the driver.
    """

    def run(batches):
        count = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, h, _ in row_sets(batch.column(0), width):
                count += np.bincount(_slot(h), minlength=SKETCH)
        blocks = count.astype("<i8").reshape(-1, SKETCH // 64)
        some = np.flatnonzero(blocks.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()], 0)
        at = np.flatnonzero(total)
        return pa.table({"slot": pa.array((table.column("block")[0].as_py() * (SKETCH // 64) + at).astype(np.int32)), "n": pa.array(total[at])})

    counts = cut(docs.select(text_col).mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "slot int, n long"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bits = np.zeros(SKETCH, bool)
    for row in counts.filter(F.col("n") > FREQUENT * total / SKETCH + 64).select("slot").toLocalIterator():
        bits[row.slot] = True
    return np.packbits(bits)


def ordered(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """`h` with its top bit set for frequent shingles, so that ascending is the global order: rare ones first."""
    slot = _slot(h)
    often = frequent[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
    return (h >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node, n and two 64-bit digests of every document's shingle set."""

    def run(batches):
        for batch in batches:
            for a, b, h, at in row_sets(batch.column(1), width):
                n = np.bincount(at, minlength=b - a)
                start = np.cumsum(n) - n
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(k)))]) for k in (1, 2)]
                digests = [(s[start + n] - s[start]).view(np.int64) for s in sums]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, digests)], names=["node", "n", "s1", "s2"])

    return docs.select(F.col(id_col).cast("long").alias("node"), text_col).mapInArrow(run, "node long, n long, s1 long, s2 long")


def postings(docs: DataFrame, text_col: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, node, k): the first k elements of each document's ordered set.

    Two sets of similarity `percent` or more share an element among their
    first n - ceil(n * percent / 100) + 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a, b, h, at in row_sets(batch.column(1), width):
                o = ordered(h, shared.value)
                order = np.lexsort((o, at))
                o, at = o[order], at[order]
                n = np.bincount(at, minlength=b - a)
                k = n + (-n * percent) // 100 + (n > 0)
                first = np.arange(len(o)) - (np.cumsum(n) - n)[at] < k[at]
                o, at = o[first], at[first]
                yield pa.RecordBatch.from_arrays([pa.array(o.view(np.int64)), pa.array(nodes[a:b][at]), pa.array(k[at].astype(np.int32))], names=["token", "node", "k"])

    return docs.select("node", text_col).mapInArrow(run, "token long, node long, k int")


def tree_links(groups: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Edges (a, b) that link the members of each group, found by walking one prefix tree a group.

    `groups` has (kind, x, y, node, comp): x and y name the group; members of
    one comp are connected already. Groups are bounded by their maker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(table: pa.Table) -> pa.Table:
        nodes, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        sets = []
        for a, b, h, at in row_sets(table.column("_text"), width):
            o = ordered(h, shared.value)
            order = np.lexsort((o, at))
            sets += np.split(o[order], np.cumsum(np.bincount(at, minlength=b - a))[:-1])
        # The group's own numbers for its elements, in the global order.
        known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        found = PrefixTree([np.searchsorted(known, s) for s in sets]).link(Forest(comp), percent)
        a, b = (np.array([nodes[p[k]] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    members = docs.select("node", F.col(text_col).alias("_text")).join(groups.hint("merge"), "node")
    return members.groupBy("x", "y").applyInArrow(run, "a long, b long")


def star_groups(tokens: DataFrame) -> DataFrame:
    """Groups around a leader: each document goes to the smallest document with which it shares most of its first elements.

    A first, incomplete round, which connects most of a large group of near
    copies at a cost in proportion to its size. Large stars are split; each
    part has the leader.
    """
    rivals = tokens.filter("node != leader").groupBy("node", "leader").agg(F.count("*").alias("c"), F.max("k").alias("k")).filter("10 * c >= 3 * k")
    best = cut(rivals.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader")))
    sizes = best.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(TREE - 1)).cast("int").alias("parts"))
    rest = best.join(sizes, "leader").select(F.col("leader").alias("x"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("y"), "node")
    heads = sizes.select(F.col("leader").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), F.col("leader").alias("node"))
    return rest.unionByName(heads).withColumn("comp", F.col("node"))


#: Least parts of the counting bound on an overlap, and the mean of shingles in a part that longer texts keep.
PARTS, FILL = 256, 2


def profiles(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, n, profile): how many of a document's shingles fall in each part of the hash range, at most 255.

    A power of two of parts, `PARTS` or more, so that about `FILL` fall in one.
    """

    def run(batches):
        for batch in batches:
            for a, b, h, at in row_sets(batch.column(1), width):
                n = np.bincount(at, minlength=b - a)
                bits = np.ceil(np.log2(np.maximum(n / FILL, PARTS))).astype(np.int64)
                size = np.int64(1) << bits
                first = np.cumsum(size) - size
                part = (h >> (np.uint64(64) - bits[at].astype(np.uint64))).astype(np.int64)
                counts = np.minimum(np.bincount(first[at] + part, minlength=int(size.sum())), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array([counts[x : x + k].tobytes() for x, k in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())], names=["node", "n", "profile"])

    return docs.select("node", text_col).mapInArrow(run, "node long, n long, profile binary")


def possible_links(n: np.ndarray, profile: list[np.ndarray], percent: int):
    """Yields (i, js): all pairs i < js of sets that can reach the limit, each pair once.

    Sets share at most the sum over all parts of the smaller count (a count cut
    off at 255 bounds nothing), and at most the smaller set. Sets of like sizes
    have as many parts or half as many; neighbouring parts are then added up.
    """
    parts = np.array([len(p) for p in profile])
    whole = 100 + percent
    for level in np.unique(parts):
        own, wide = np.flatnonzero(parts == level), np.flatnonzero(parts == 2 * level)
        at = np.concatenate([own, wide])
        table = np.zeros((len(at), level), np.int16)
        for k, i in enumerate(at):
            table[k] = profile[i] if len(profile[i]) == level else profile[i].astype(np.int16).reshape(-1, 2).sum(1)
        full = np.zeros(len(at), bool) if not len(at) else np.array([(profile[i] == 255).any() for i in at])
        for k, i in enumerate(own):
            others = np.arange(k + 1, len(at))
            fit = whole * np.minimum(n[i], n[at[others]]) >= percent * (n[i] + n[at[others]])
            others = others[fit]
            for s in range(0, len(others), 512):
                some = others[s : s + 512]
                bound = np.minimum(table[k], table[some]).sum(1, dtype=np.int64)
                can = (whole * bound >= percent * (n[i] + n[at[some]])) | full[k] | full[some]
                if can.any():
                    yield i, at[some[can]]


def rest_groups(tokens: DataFrame, comps: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """Groups that hold every pair the first round left open.

    Elements whose documents are not all connected yet are kept; of elements
    with the very same documents only one. Within such a list, pairs whose
    profiles or sizes can't reach the limit are put aside, and what hangs
    together by the other pairs is a group, split into pairs of blocks where
    it is larger than a tree. Long lists are split into pairs of blocks first.
    """
    labelled = tokens.select("token", "node").join(comps, "node", "left").select("token", "node", F.coalesce("component", "node").alias("comp"))
    stats = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    lists = cut(stats.filter("lo != hi").groupBy("c", "sum").agg(F.min("token").alias("token")))
    block = 4 * TREE
    open_ = cut(labelled.join(lists.select("token", F.ceil(F.col("c") / block).cast("int").alias("parts")), "token"))
    nodes = open_.select("node").distinct()
    known = profiles(docs.select("node", text_col).join(nodes.hint("merge"), "node", "left_semi"), text_col, width)
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    spread = open_.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("token", "node", "comp", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part").join(known, "node")

    def run(table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        profile = [np.frombuffer(x, np.uint8) for x in table.column("profile").to_pylist()]
        forest = Forest(np.arange(len(node)))
        hit = np.zeros(len(node), bool)
        for i, js in possible_links(n, profile, percent):
            for j in js[comp[js] != comp[i]].tolist():
                if forest.join(int(i), j):
                    hit[i] = hit[j] = True
        root = np.array([forest.root(i) for i in range(len(node))]) if len(node) else np.zeros(0, np.int64)
        x, y, out_n, out_c = [], [], [], []
        for r in np.unique(root[hit]):
            own = np.flatnonzero(root == r)
            own = own[np.argsort(node[own], kind="stable")]
            parts = np.array_split(own, -(-len(own) // (TREE // 2)))
            together = [own] if len(own) <= TREE else [np.concatenate([parts[i], parts[j]]) for i in range(len(parts)) for j in range(i + 1, len(parts))]
            for members in together:
                key = mix(np.array([len(members)], np.uint64) + mix(node[members].astype(np.uint64)).sum(dtype=np.uint64)[None]).view(np.int64)[0]
                x += [key] * len(members)
                out_n += node[members].tolist()
                out_c += comp[members].tolist()
        y = [0] * len(x)
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int32()), "node": pa.array(out_n, pa.int64()), "comp": pa.array(out_c, pa.int64())})

    return spread.groupBy("token", "p", "q").applyInArrow(run, "x long, y int, node long, comp long").dropDuplicates(["x", "node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """`id_col`, n_shingles and component_id of every row of `docs`.

    Two documents link when the Jaccard similarity of their sets of distinct
    `width`-word shingles is `percent` / 100 or more; components are the
    smallest id reachable by links. A text of fewer words has its whole
    sequence as its one shingle; null and blank texts have none and link with
    nothing. Documents with equal sets are one class, joined once. Rows that
    share an id are one node of the graph and keep a row each; a null id links
    with nothing and has a null component. An empty table gives an empty table.
    Ids are integers. Other columns of `docs` are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_doc"))
    frequent = frequent_slots(own, "_doc", width)
    sets = cut(signatures(own, "node", "_doc", width))
    classes = cut(sets.filter("n > 0 and node is not null").groupBy("n", "s1", "s2").agg(F.min("node").alias("head")))
    # One text of each class, met with its id by the same shuffle at every size; groups below hold ids of such texts only.
    heads = own.join(classes.select(F.col("head").alias("node")).hint("merge"), "node", "left_semi")
    posted = stored(postings(heads, "_doc", width, percent, frequent))
    # Sums by token come from all tasks' partial ones, and a join can be split where a token is hot; a window could not.
    shared = posted.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("top")).filter("leader != top").select("token", "leader")
    tokens = stored(posted.join(shared.hint("merge"), "token"))
    first = cut(tree_links(star_groups(tokens), own, "_doc", width, percent, frequent))
    groups = cut(rest_groups(tokens, components(first), own, "_doc", width, percent))
    second = tree_links(groups, own, "_doc", width, percent, frequent)
    found = components(first.unionByName(second))
    of_class = classes.join(found.withColumnRenamed("node", "head"), "head", "left").select("n", "s1", "s2", F.coalesce("component", "head").alias("component"))
    out = sets.join(of_class, ["n", "s1", "s2"], "left").withColumn("component", F.when(F.col("node").isNotNull(), F.coalesce("component", "node")))
    return out.select(F.col("node").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))
