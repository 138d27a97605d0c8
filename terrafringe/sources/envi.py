"""ENVI rasters (raw cells with a text header) as rows of pixels, through the reader of binary files and a Python writer."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ENVI's data type codes.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2"}


def parse_header(text: str) -> dict[str, str]:
    """`key = value` lines of a header, braces joined over lines."""
    joined = re.sub(r"\{([^}]*)\}", lambda m: " ".join(m[1].split()), text)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in joined.splitlines()) if v}


def read_envi(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """(path, band, gy, gx, v) of every raster below `path`: `<name>.hdr` beside `<name>`; no data and NaN are null.

    A header and its cells meet by name; each raster is decoded in one task, line by line.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    heads = files.filter(F.col("path").endswith(".hdr")).select(F.regexp_replace("path", r"\.hdr$", "").alias("path"), F.decode("content", "utf-8").alias("header"))
    cells = files.filter(~F.col("path").endswith(".hdr")).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, header, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = parse_header(header)
                width, lines, bands = (int(h[k]) for k in ("samples", "lines", "bands"))
                order = ">" if h.get("byte order", "0") == "1" else "<"
                data = np.frombuffer(raw, order + TYPES[int(h["data type"])], width * lines * bands, int(h.get("header offset", 0)))
                shape = {"bsq": (bands, lines, width), "bil": (lines, bands, width), "bip": (lines, width, bands)}[h.get("interleave", "bsq").lower()]
                cube = data.reshape(shape).transpose({"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (2, 0, 1)}[h.get("interleave", "bsq").lower()])
                fill = nodata if nodata is not None else float(h["data ignore value"]) if "data ignore value" in h else None
                for b in range(bands):
                    v = cube[b].astype(float)
                    bad = np.isnan(v) | (v == fill) if fill is not None else np.isnan(v)
                    y, x = np.divmod(np.arange(v.size), width)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), *(pa.array(c) for c in (np.full(v.size, b + 1), y, x)), pa.array(v.ravel(), mask=bad.ravel())], names=["path", "band", "gy", "gx", "v"])

    return heads.join(cells, "path").mapInArrow(run, "path string, band long, gy long, gx long, v double")


def write_envi(pixels: DataFrame, path: str, key: str, width: int, lines: int, nodata: float = 0.0) -> DataFrame:
    """Rasters of `pixels` (key, gy, gx, v) as ENVI cells and headers in one row each: (name, header, content).

    The result is written by the caller's choice of sink; pixels without a value hold `nodata`.
    """

    def run(table: pa.Table) -> pa.Table:
        grid = np.full((lines, width), nodata, "<f4")
        y, x = table.column("gy").to_numpy(), table.column("gx").to_numpy()
        v = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        inside = (y >= 0) & (y < lines) & (x >= 0) & (x < width) & ~np.isnan(v)
        grid[y[inside], x[inside]] = v[inside]
        header = f"ENVI\nsamples = {width}\nlines = {lines}\nbands = 1\nheader offset = 0\ndata type = 4\ninterleave = bsq\nbyte order = 0\ndata ignore value = {nodata}\n"
        return pa.table({"name": [str(table.column("_name")[0].as_py())], "header": [header], "content": pa.array([grid.tobytes()], pa.binary())})

    rows = pixels.select(F.col(key).cast("string").alias("_name"), "gy", "gx", "v")
    return rows.groupBy("_name").applyInArrow(run, "name string, header string, content binary")
