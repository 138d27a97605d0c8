"""Near-duplicate embeddings: an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafringe.llm.common import cut
from terrafringe.llm.components import components
from terrafringe.llm.prefix_tree import Forest

#: Vectors of a cell's home that one task compares; larger homes are split.
BLOCK = 4096
#: At most this many pivots, whose vectors are sent to all tasks.
PIVOTS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def linked_pairs(own: np.ndarray, other: np.ndarray | None, least: float):
    """Index pairs of rows whose cosine, in double precision, is `least` or more; within `own` each pair once."""
    a = _unit(own)
    b = a if other is None else _unit(other)
    fast_a, fast_b = a.astype(np.float32), b.astype(np.float32)
    for s in range(0, len(a), 512):
        first = s if other is None else 0
        near = fast_a[s : s + 512] @ fast_b[first:].T >= least - 1e-5
        i, j = np.nonzero(near)
        i, j = i + s, j + first
        if other is None:
            i, j = i[i < j], j[i < j]
        # Single precision only chooses; the components' own doubles decide.
        sure = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            x, y = own[i[k : k + (1 << 16)]], (own if other is None else other)[j[k : k + (1 << 16)]]
            dot = np.einsum("ij,ij->i", x, y)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
            sure[k : k + (1 << 16)] = dot / norm >= least
        yield i[sure], j[sure]


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id_col`, n_links, component_id and kept of every row of `vectors`.

    Two vectors link when their cosine, in double precision, is `least` or
    more; n_links counts the other vectors linked directly, component_id is the
    smallest id reachable by links, and kept says that it is the row's own.
    Vectors that are null, zero, or hold a null or non-finite component link
    with nothing; so do vectors of different dimensions with each other. Equal
    vectors are one class, joined once and counted with its size. A null id
    takes part in nothing and has a null component; rows that repeat an id
    count as vectors of their own. An empty table gives an empty table. Other
    columns are not read.

    Directions are points on the sphere, where a cosine of `least` is a
    distance r. Each vector's home is the cell of its nearest pivot; it visits
    the cell of a later pivot q only if it can have a partner there: with home
    p, the triangle inequality asks for d(x, q) <= radius(q) + r, and Voronoi
    cells for (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r. Cells join
    independently, in blocks of at most `BLOCK` home vectors and as many
    others. Only counts and spanning links leave a block.
    """
    kind = dict(vectors.dtypes)[id_col]
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("node"), F.col(vector_col).cast("array<double>").alias("v"))
    good = own.filter(_usable("v") & F.col("node").isNotNull())
    classes = cut(good.groupBy("v").agg(F.min("node").alias("head"), F.count("*").alias("size")).withColumn("dim", F.size("v")))
    r = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    dims = [(row["dim"], row["n"]) for row in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    links = None
    for dim, n in dims:
        found = _links(classes.filter(F.col("dim") == dim), n, r, least)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, n long")
    links = cut(links)
    comps = components(links.filter("b is not null").select("a", "b"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n"))
    of_class = classes.join(counts, "head", "left").join(comps.withColumnRenamed("node", "head"), "head", "left")
    of_class = of_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    # Unusable vectors are kept out of the join by a null key.
    keyed = own.withColumn("v", F.when(_usable("v") & F.col("node").isNotNull(), F.col("v")))
    out = keyed.join(of_class, "v", "left").select("node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    return out.select(F.col("node").cast(kind).alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("node") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, r: float, least: float) -> DataFrame:
    """(a, null, n): n linked vectors of other classes; (a, b, null): spanning links. All by class heads."""
    spark = classes.sparkSession
    k = max(1, min(PIVOTS, n // BLOCK))
    pivots = _unit(np.array([row["v"] for row in classes.select("v", "head").orderBy(F.xxhash64("head"), "head").limit(k).collect()]))
    sent = spark.sparkContext.broadcast(pivots)

    def home(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ sent.value.T))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["v", "head", "size", "cell", "near"])

    homes = cut(classes.select("v", "head", "size").mapInArrow(home, "v array<double>, head long, size long, cell int, near double"))
    facts = homes.groupBy("cell").agg(F.max("near").alias("radius"), F.count("*").alias("n")).collect()
    radius, blocks = np.full(k, -np.inf), np.ones(k, np.int64)
    for row in facts:
        radius[row["cell"]], blocks[row["cell"]] = row["radius"], -(-row["n"] // BLOCK)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    bounds = spark.sparkContext.broadcast((pivots, radius, apart))

    def visit(batches):
        for batch in batches:
            p, far, between = bounds.value
            x, cell, near = _unit(_matrix(batch.column(0))), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
            gap = between[cell]
            can = (d <= far[None] + r + 1e-9) & (d * d - (near * near)[:, None] <= 2 * r * gap + 1e-9)
            can &= np.arange(len(p))[None] > cell[:, None]
            row, to = np.nonzero(can)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(to.astype(np.int32))], names=["v", "head", "size", "cell"])

    guests = homes.mapInArrow(visit, "v array<double>, head long, size long, cell int")
    counts = {row["cell"]: row["n"] for row in guests.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rooms = np.array([-(-counts.get(c, 0) // BLOCK) for c in range(k)])

    def numbers(values) -> Column:
        return F.array(*[F.lit(int(v)) for v in values])

    # Tasks of a cell: every pair of home blocks, and every home block with every room of guests.
    salt = F.xxhash64("head", F.lit(5))
    b = F.get(numbers(blocks), F.col("cell"))
    g = F.get(numbers(rooms), F.col("cell"))
    at_home = homes.select("v", "head", "size", "cell", F.pmod(salt, b).cast("int").alias("p"), b.alias("b"), g.alias("g"))
    pairs = at_home.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("v", "head", "size", "cell", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).alias("second"))
    hosts = at_home.filter("g > 0").withColumn("q", F.explode(F.sequence(F.lit(1), F.col("g")))).select("v", "head", "size", "cell", F.col("p").alias("x"), (-F.col("q")).alias("y"), F.lit(False).alias("second"))
    staying = guests.select("v", "head", "size", "cell", (F.lit(-1) - F.pmod(salt, g)).cast("int").alias("y"), b.alias("b")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    staying = staying.select("v", "head", "size", "cell", "x", "y", F.lit(True).alias("second"))

    def run(table: pa.Table) -> pa.Table:
        v, head, size, second = _matrix(table.column("v")), table.column("head").to_numpy(), table.column("size").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
        y, x = table.column("y")[0].as_py(), table.column("x")[0].as_py()
        n, forest, spanning = np.zeros(len(head), np.int64), Forest(np.arange(len(head))), []
        if x == y:
            own, other = np.arange(len(head)), None
        else:
            own, other = np.flatnonzero(~second), np.flatnonzero(second)
        for i, j in linked_pairs(v[own], None if other is None else v[other], least):
            i, j = own[i], (own if other is None else other)[j]
            np.add.at(n, i, size[j])
            np.add.at(n, j, size[i])
            for s, t in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(s, t):
                    spanning.append((s, t))
        some = np.flatnonzero(n)
        s, t = (np.array([p[k] for p in spanning], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.concatenate([head[some], head[s]]), pa.int64()), "b": pa.array([None] * len(some) + head[t].tolist(), pa.int64()), "n": pa.array(n[some].tolist() + [None] * len(s), pa.int64())})

    tasks = pairs.unionByName(hosts).unionByName(staying)
    return tasks.groupBy("cell", "x", "y").applyInArrow(run, "a long, b long, n long")
