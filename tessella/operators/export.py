"""Exports of a settled layout: metadata, names, points with colours, and a PNG with the run's settings inside."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of categories, of rows without one, of the ground, and of the ring around outliers; opacity; ring.
PALETTE = ["#7FB2F0", "#7BD88F", "#C79BF0", "#5FD3BC", "#F2A14B", "#F2779B"]
INK, GROUND, RING = "#E8ECF3", "#141821", "#F2A14B"
POINT_ALPHA, RING_GAP, RING_WIDTH = 0.82, 3.0, 1.5
SIGNATURE = b"\x89PNG\r\n\x1a\n"
KEYWORD = "tessella:sim-config"


def metadata_json(seed: Column, step: Column, converged: Column, unstable: Column, rows: Column, mappings: Column) -> Column:
    return F.to_json(F.struct(seed.alias("seed"), step.alias("step"), converged.alias("converged"), unstable.alias("unstable"), rows.alias("rowCount"), mappings.alias("mappings")))


def coloured(points: DataFrame, category: Column | None = None, outlier: Column | None = None) -> DataFrame:
    """Adds colour (of a category number, else the default ink), alpha, and the ring's colour of outliers (null for others)."""
    odd = F.coalesce(outlier, F.lit(False)) if outlier is not None else F.lit(False)
    hue = F.when(category >= 0, F.element_at(F.array(*map(F.lit, PALETTE)), (F.greatest(category, F.lit(0)) % len(PALETTE) + 1).cast("int"))) if category is not None else F.lit(None)
    return points.withColumn("colour", F.coalesce(hue, F.lit(INK))).withColumn("alpha", F.when(odd, 1.0).otherwise(POINT_ALPHA)).withColumn("ring", F.when(odd, RING))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def embed(png: bytes, text: str, keyword: str = KEYWORD) -> bytes:
    """The image with an international text chunk right behind its header."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    head = len(SIGNATURE) + 12 + struct.unpack(">I", png[8:12])[0]
    body = keyword.encode("latin-1") + b"\0\0\0\0\0" + text.encode()
    return png[:head] + chunk(b"iTXt", body) + png[head:]


def _rgb(c: str) -> np.ndarray:
    return np.array([int(c[i:i + 2], 16) for i in (1, 3, 5)], float)


def raster(x: np.ndarray, y: np.ndarray, colours: list[str], width: int, height: int, radius: float = 3.2, alpha: np.ndarray | None = None, rings: list[str | None] | None = None) -> bytes:
    """An RGB image of filled circles on the ground, one after the other, outliers with a ring."""
    image = np.tile(_rgb(GROUND), (height, width, 1))
    reach = int(np.ceil(radius + RING_GAP + RING_WIDTH))
    for k, (cx, cy, c) in enumerate(zip(x, y, colours)):
        x0, x1, y0, y1 = max(0, int(cx) - reach), min(width, int(cx) + reach + 1), max(0, int(cy) - reach), min(height, int(cy) + reach + 1)
        if x0 < x1 and y0 < y1:
            gy, gx = np.mgrid[y0:y1, x0:x1]
            r = np.hypot(gx - cx, gy - cy)
            part, a = image[y0:y1, x0:x1], 1.0 if alpha is None else float(alpha[k])
            part[r <= radius] = a * _rgb(c) + (1 - a) * part[r <= radius]
            if rings is not None and rings[k]:
                part[np.abs(r - radius - RING_GAP) <= RING_WIDTH / 2] = _rgb(rings[k])
    lines = b"".join(b"\0" + row.tobytes() for row in np.rint(image).astype(np.uint8))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(screen: DataFrame, width: int, height: int) -> DataFrame:
    """One PNG per layout from (layout_id, row_idx, screen_x, screen_y, colour, alpha, ring, metadata); a layout is a row budget at most."""
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", kind="stable")
        png = raster(pdf["screen_x"].to_numpy(float), pdf["screen_y"].to_numpy(float), pdf["colour"].tolist(), width, height, alpha=pdf["alpha"].to_numpy(float), rings=pdf["ring"].tolist())
        return pd.DataFrame({"layout_id": [pdf["layout_id"].iloc[0]], "png": [embed(png, pdf["metadata"].iloc[0])]})
    return screen.groupBy("layout_id").applyInPandas(draw, "layout_id long, png binary")
