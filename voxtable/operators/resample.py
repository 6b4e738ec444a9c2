"""Slices turned by any angle: bicubic pixels, a canvas that grows to the turned box, and versions to go back to.

Places and weights are whole numbers: cosine and sine in 65,536ths, places in 131,072ths of a pixel, fractions in 256ths and the cubic's weights in
2^24ths.  A pixel is the weighted sum of the sixteen around its place, whatever the order of addition.  Each slice is one image and is turned in
one task; slices are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BACKGROUND = 255


def turns(transforms: DataFrame) -> DataFrame:
    """(z, dx, dy, c, s) of transforms (seq, z_start, z_end, dx, dy, angle_deg): ends in any order, of several for a slice the last holds."""
    a = F.radians("angle_deg")
    t = transforms.select("seq", "dx", "dy", F.round(F.cos(a) * 65536).cast("long").alias("c"), F.round(F.sin(a) * 65536).cast("long").alias("s"), F.explode(F.sequence(F.least("z_start", "z_end"), F.greatest("z_start", "z_end"))).alias("z"))
    return t.groupBy("z").agg(F.max(F.struct("seq", "dx", "dy", "c", "s")).alias("t")).select("z", "t.dx", "t.dy", "t.c", "t.s")


def box(height: int, width: int, c: int, s: int) -> tuple[int, int]:
    """Height and width of the turned image: the least whole box of the same parity that holds it."""
    h, w = (abs(c) * height + abs(s) * width, abs(s) * height + abs(c) * width)
    up = lambda v, like: v + ((v - like) % 2)
    return up(-(-h // 65536), height), up(-(-w // 65536), width)


def cubic(f: np.ndarray) -> np.ndarray:
    """(4, n) whole weights of the pixels at -1, 0, 1 and 2 for fractions in 256ths; they add up to 2^24."""
    one = 256
    return np.stack([-f * one * one + 2 * f * f * one - f**3, one**3 - 2 * f * f * one + f**3, f * one * one + f * f * one - f**3, -f * f * one + f**3])


def turned(image: np.ndarray, label: np.ndarray, c: int, s: int, dx: int, dy: int, canvas: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The image turned about its centre and laid on the canvas, centred and shifted; what lies outside is ``BACKGROUND`` and label 0."""
    (height, width), (rows, cols) = image.shape, canvas
    y, x = np.mgrid[0:rows, 0:cols].astype(np.int64)
    # Twice the distances from the canvas's centre; the centres of image and canvas meet.
    v, u = 2 * (y - dy) + 1 - rows, 2 * (x - dx) + 1 - cols
    sx, sy = c * u + s * v + width * 65536, c * v - s * u + height * 65536
    inside = (sx >= 0) & (sx < width * 131072) & (sy >= 0) & (sy < height * 131072)
    sx, sy = sx[inside], sy[inside]
    bx, by = (sx - 65536) >> 17, (sy - 65536) >> 17
    wx, wy = cubic(((sx - 65536) & 131071) >> 9), cubic(((sy - 65536) & 131071) >> 9)
    total = np.zeros(len(sx), np.int64)
    for i in range(4):
        line = np.clip(by + i - 1, 0, height - 1)
        for j in range(4):
            total += image[line, np.clip(bx + j - 1, 0, width - 1)] * wx[j] * wy[i]
    out, marks = np.full(canvas, BACKGROUND, np.int64), np.zeros(canvas, np.int64)
    out[inside] = np.clip(total >> 48, 0, 255)
    marks[inside] = label[sy >> 17, sx >> 17]
    return out, marks


def rotate(voxels: DataFrame, transforms: DataFrame, height: int, width: int, canvas: tuple[int, int] | None = None) -> DataFrame:
    """(z, y, x, gray, label): slices of dense voxels under transforms.  Without a canvas it grows to the largest turned box; slices that have no
    transform are centred on it too.  Grey is bicubic, labels take the nearest pixel."""
    t = turns(transforms)
    if canvas is None:
        sizes = [(height, width), *(box(height, width, r["c"], r["s"]) for r in t.select("c", "s").distinct().collect())]  # one row for each angle in use
        canvas = max(h for h, _ in sizes), max(w for _, w in sizes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, label = np.full((height, width), BACKGROUND, np.int64), np.zeros((height, width), np.int64)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        image[y, x], label[y, x] = pdf["gray"], pdf["label"]
        c, s, dx, dy = (int(pdf[k].iloc[0]) for k in ("c", "s", "dx", "dy"))
        gray, marks = turned(image, label, c, s, dx, dy, canvas)
        at = np.indices(canvas).reshape(2, -1)
        return pd.DataFrame({"z": pdf["z"].iloc[0], "y": at[0], "x": at[1], "gray": gray.ravel(), "label": marks.ravel()}).astype(np.int32)

    at = voxels.join(t, "z", "left").na.fill({"dx": 0, "dy": 0, "c": 65536, "s": 0})
    return at.groupBy("z").applyInPandas(run, "z int, y int, x int, gray int, label int")


def applied(versions: DataFrame, transforms: DataFrame, height: int, width: int, version: int) -> DataFrame:
    """Versions (version, z, y, x, gray, label) with one more: the slices in the transforms' ranges as they are under them, on the same canvas.  Other slices
    are not copied."""
    t = turns(transforms).select("z")
    moved = rotate(current(versions, version - 1).join(t, "z", "left_semi"), transforms, height, width, (height, width))
    return versions.unionByName(moved.select(F.lit(version).alias("version"), "z", "y", "x", "gray", "label"))


def current(versions: DataFrame, version: int) -> DataFrame:
    """Each slice as its last version up to ``version`` has it: a canceled transform is the version before it."""
    last = versions.where(F.col("version") <= version).groupBy("z").agg(F.max("version").alias("version"))
    return versions.join(last, ["z", "version"], "left_semi").drop("version")
