"""Raster files: raw float grids, 16-bit PNG heightmaps, metadata and collision meshes.

Files are read through Spark's binaryFile source, so any store that Spark
reads will do, and written as tiles, so that no grid passes through one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Metrics, cells, with_tiles


def encode_png16(grid: np.ndarray) -> bytes:
    """A greyscale PNG of 16-bit samples."""
    h, w = grid.shape
    rows = np.zeros((h, 1 + 2 * w), np.uint8)
    rows[:, 1:] = grid.astype(">u2").view(np.uint8).reshape(h, 2 * w)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Greyscale 8 or 16-bit samples of a PNG without interlacing, as 16-bit numbers."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if colour != 0 or depth not in (8, 16) or interlace:
                raise ValueError("only plain greyscale of 8 or 16 bits is read")
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    step = depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        line, mode = rows[y, 1:].astype(np.int64), rows[y, 0]
        if mode == 2:
            line = (line + above) & 255
        elif mode == 1:
            line = (np.cumsum(line.reshape(w, step), axis=0) & 255).reshape(-1)
        elif mode in (3, 4):
            for x in range(w * step):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                if mode == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    flat = out.view(">u2").astype(np.uint16) if depth == 16 else out.astype(np.uint16) * 257
    return flat.reshape(h, w)


def _decoded(spark: SparkSession, path: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                g = decode(content)
                for j in range(0, g.shape[0], 256):
                    part = g[j : j + 256]
                    jj, ii = np.mgrid[j : j + len(part), 0 : g.shape[1]]
                    yield pd.DataFrame({"path": name, "i": ii.ravel().astype("int32"), "j": jj.ravel().astype("int32"), "v": part.ravel().astype("float64")})

    return files.mapInPandas(run, "path string, i int, j int, v double")


def read_raw(spark: SparkSession, path: str, m: Metrics) -> DataFrame:
    """(i, j, h) of a row-major little-endian float file; a short file fails."""
    n = m.width * m.height

    def decode(content: bytes) -> np.ndarray:
        if len(content) < 4 * n:
            raise ValueError(f"a raw grid of {n} cells needs {4 * n} bytes, not {len(content)}")
        return np.frombuffer(content, "<f4", n).reshape(m.height, m.width)

    return _decoded(spark, path, decode).select("i", "j", F.col("v").alias("h"))


def read_png(spark: SparkSession, path: str, m: Metrics, size: tuple[int, int], scale: float, offset: float = 0.0) -> DataFrame:
    """(i, j, h): the nearest sample of a heightmap of size (width, height) under each cell's corner, scaled."""
    at = lambda k, n, s: F.least(F.floor(F.col(k) / n * s), F.lit(s - 1)).cast("int")
    want = cells(spark, m).withColumns({"si": at("i", m.width, size[0]), "sj": at("j", m.height, size[1])})
    have = _decoded(spark, path, decode_png).select(F.col("i").alias("si"), F.col("j").alias("sj"), "v")
    return want.join(have, ["si", "sj"]).select("i", "j", (F.col("v") / 65535.0 * scale + offset).alias("h"))


def quantised(df: DataFrame, value: str = "h") -> DataFrame:
    """q: value's place in its range as a 16-bit number, cut off."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    t = (F.col(value) - lo) / max(hi - lo, 1e-6)
    return df.withColumn("q", F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 65535.0).cast("int"))


def tile_bytes(df: DataFrame, m: Metrics, kind: str = "raw", value: str = "h") -> DataFrame:
    """tx, tz, width, height, content: each tile packed as raw floats or as a 16-bit PNG of value as given."""

    def pack(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["j", "i"])
        w, h = rows.i.nunique(), rows.j.nunique()
        g = rows[value].to_numpy().reshape(h, w)
        content = g.astype("<f4").tobytes() if kind == "raw" else encode_png16(g)
        return pd.DataFrame([(key[0], key[1], w, h, content)], columns=["tx", "tz", "width", "height", "content"])

    return with_tiles(df, m).groupBy("tx", "tz").applyInPandas(pack, "tx int, tz int, width int, height int, content binary")


def metadata(df: DataFrame, m: Metrics) -> DataFrame:
    """One row: range, size in cells and metres, and cell size."""
    r = df.agg(F.min("h").alias("min"), F.max("h").alias("max"))
    return r.select("min", "max", *(F.lit(v).alias(k) for k, v in (("width", m.width), ("height", m.height), ("world_size_x", m.world_x), ("world_size_z", m.world_z), ("dx", m.dx), ("dz", m.dz))))


def normals(df: DataFrame, m: Metrics) -> DataFrame:
    """r, g, b: the surface normal from forward differences, each part encoded in a byte."""
    from ..operators.stencil import forward

    d = forward(df, m)
    size = F.greatest(F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz") + 1.0), F.lit(1e-6))
    byte = lambda c: F.floor((c / size * 0.5 + 0.5) * 255.0).cast("int")
    return d.select("i", "j", byte(-F.col("gx")).alias("r"), byte(-F.col("gz")).alias("g"), byte(F.lit(1.0)).alias("b"))


def splat(df: DataFrame, slots: dict[int, int], value: str) -> DataFrame:
    """r, g, b, a: 255 in the channel of the cell's material."""
    return df.select("i", "j", *(F.when(F.col(value) == next((k for k, s in slots.items() if s == n), None), 255).otherwise(0).alias(c) for n, c in enumerate("rgba")))


def mesh(df: DataFrame, m: Metrics, stride: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z) and quads (a, b, c, d) of every stride-th cell; ids follow from the cell, so none is ranked."""
    stride = max(1, stride)
    cols, rows = -(-m.width // stride), -(-m.height // stride)
    picked = df.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))
    n = F.expr(f"j div {stride} * {cols} + i div {stride} + 1").cast("long")
    vertices = picked.select(n.alias("id"), (F.col("i") * m.dx).alias("x"), F.col("h").alias("y"), (F.col("j") * m.dz).alias("z"))
    inner = picked.where((F.col("i") < (cols - 1) * stride) & (F.col("j") < (rows - 1) * stride))
    quads = inner.select(n.alias("a"), (n + cols).alias("b"), (n + cols + 1).alias("c"), (n + 1).alias("d"))
    return vertices, quads


def write_tiles(df: DataFrame, m: Metrics, path: str, changed: DataFrame | None = None) -> None:
    """Parquet partitioned by tile; with changed, only those tiles are rewritten."""
    d = with_tiles(df, m)
    if changed is not None:
        d = d.join(changed.select("tx", "tz"), ["tx", "tz"], "left_semi")
    d.repartition("tx", "tz").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx", "tz").parquet(path)
