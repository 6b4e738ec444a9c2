"""Neighbourhood and coordinate operators on slices.

Coordinate maps are projections (no shuffle).  Connected components need a slice in one place: slices are independent
and bounded by an image's size, so they are the groups.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _label_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component numbers of pixels that touch by sides or corners: least number spreads along neighbours, with pointer jumps."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    width = int(x.max()) + 3
    code = (y.astype(np.int64) + 1) * width + x + 1
    order = np.argsort(code)
    ranked = code[order]
    pairs = []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(ranked, ranked + step), n - 1)
        hit = np.flatnonzero(ranked[at] == ranked + step)
        pairs.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.empty(n, np.int64)
    out[order] = order[root] if n else root
    return out


def components(voxels: DataFrame) -> DataFrame:
    """(z, label, y, x, comp): foreground voxels with their 8-connected 2-D component; comp is y * 2^20 + x of its first pixel in reading order."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        root = _label_components(y, x)
        code = y.astype(np.int64) * (1 << 20) + x
        first = np.full(len(pdf), np.iinfo(np.int64).max)
        np.minimum.at(first, root, code)
        return pdf.assign(comp=first[root])

    fore = voxels.where("label > 0").select("z", "label", "y", "x")
    return fore.groupBy("z", "label").applyInPandas(label, "z int, label int, y int, x int, comp long")


def component_sizes(voxels: DataFrame) -> DataFrame:
    return components(voxels).groupBy("z", "label", "comp").agg(F.count("*").alias("area"))


def remove_small_parts(voxels: DataFrame, label: int, threshold: int = 50) -> DataFrame:
    """The volume without that label's components of fewer than ``threshold`` pixels.  Only the label's own rows are grouped."""
    mine = components(voxels.where(F.col("label") == label))
    small = mine.groupBy("z", "comp").agg(F.count("*").alias("_a")).where(F.col("_a") < threshold).select("z", "comp")
    gone = mine.join(small, ["z", "comp"], "left_semi").select("z", "y", "x", F.lit(True).alias("_gone"))
    cleared = F.when(F.col("_gone"), 0).otherwise(F.col("label")).cast(dict(voxels.dtypes)["label"])
    return voxels.join(gone, ["z", "y", "x"], "left").withColumn("label", cleared).drop("_gone")


def dilate(voxels: DataFrame, r: int, height: int, width: int) -> DataFrame:
    """(label, z, y, x): each label grown by a (2r+1)-square, clipped at the border; labels may overlap.  Rows grow first and columns
    after, so a voxel is copied 2r+1 times a pass, and repeats go before the next."""
    grown = voxels.where("label > 0").select("label", "z", "y", F.explode(F.sequence(F.greatest(F.col("x") - r, F.lit(0)), F.least(F.col("x") + r, F.lit(width - 1)))).alias("x")).distinct()
    return grown.select("label", "z", F.explode(F.sequence(F.greatest(F.col("y") - r, F.lit(0)), F.least(F.col("y") + r, F.lit(height - 1)))).alias("y"), "x").distinct()


def max_canvas(sizes: DataFrame) -> DataFrame:
    """One row (height, width): the largest of each over the stack."""
    return sizes.agg(F.max("height").alias("height"), F.max("width").alias("width"))


def pad_to(voxels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Slices centred on the largest canvas; an odd pixel goes right and below.  sizes: (z, height, width), one row a slice."""
    most = sizes.agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    shift = sizes.crossJoin(F.broadcast(most)).select("z", F.expr("(_h - height) div 2").alias("_dy"), F.expr("(_w - width) div 2").alias("_dx"))  # most is one row
    return voxels.join(shift, "z").withColumn("y", (F.col("y") + F.col("_dy")).cast("int")).withColumn("x", (F.col("x") + F.col("_dx")).cast("int")).drop("_dy", "_dx")


def expand(voxels: DataFrame, margin: int = 100) -> DataFrame:
    return voxels.withColumn("y", F.col("y") + margin).withColumn("x", F.col("x") + margin)


def crop(voxels: DataFrame, x0: int, y0: int, x1: int, y1: int, height: int, width: int) -> DataFrame:
    """The box, clamped into the image, with its corner as the origin."""
    x0, x1 = sorted((max(0, min(x0, width)), max(0, min(x1, width))))
    y0, y1 = sorted((max(0, min(y0, height)), max(0, min(y1, height))))
    inside = voxels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return inside.withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def flip(voxels: DataFrame, height: int, width: int, left_right: bool = False, up_down: bool = False) -> DataFrame:
    out = voxels.withColumn("x", F.lit(width - 1) - F.col("x")) if left_right else voxels
    return out.withColumn("y", F.lit(height - 1) - F.col("y")) if up_down else out


def rot90(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """A quarter turn clockwise: the new image is ``height`` wide and ``width`` high."""
    return voxels.withColumn("_y", F.col("x")).withColumn("x", (F.lit(height - 1) - F.col("y")).cast("int")).withColumn("y", F.col("_y").cast("int")).drop("_y")


def orient(voxels: DataFrame, plane: str, dims: tuple[int, int, int], rotate: bool = True, left_right: bool = False, up_down: bool = True) -> DataFrame:
    """Slices of a plane from a volume (i, j, k, label) of ``dims``: axial cuts along k, coronal along j, sagittal along i; then a
    quarter turn, then the flips.  (z, y, x, label)."""
    cut, rows, cols = {"axial": ("k", "i", "j"), "coronal": ("j", "i", "k"), "sagittal": ("i", "j", "k")}[plane]
    size = dict(zip("ijk", dims, strict=True))
    out = voxels.select(F.col(cut).alias("z"), F.col(rows).alias("y"), F.col(cols).alias("x"), "label")
    h, w = size[rows], size[cols]
    if rotate:
        out, h, w = rot90(out, h, w), w, h
    return flip(out, h, w, left_right, up_down)


def resize_nearest(voxels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Each new pixel takes the pixel at floor(place * old / new): every old pixel lays itself out over the new ones that fall on it."""

    def fan(c: str, old: int, new: int):
        lo, hi = F.ceil(F.col(c) * F.lit(new) / old), F.ceil((F.col(c) + 1) * F.lit(new) / old) - 1
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    out = voxels.withColumn("_y", F.explode(fan("y", height, new_height))).withColumn("_x", F.explode(fan("x", width, new_width)))
    return out.withColumn("y", F.col("_y").cast("int")).withColumn("x", F.col("_x").cast("int")).drop("_y", "_x")


def rigid(voxels: DataFrame, transforms: DataFrame, height: int, width: int) -> DataFrame:
    """Slices turned about their centre and shifted, by nearest pixel.  transforms: (z_start, z_end, dx, dy, angle_deg), ends in any order;
    of several that meet a slice the last listed (``seq``) holds.  Each target pixel takes its source: an inverse map by join on the place."""
    t = transforms.select("seq", "dx", "dy", F.radians("angle_deg").alias("a"), F.explode(F.sequence(F.least("z_start", "z_end"), F.greatest("z_start", "z_end"))).alias("z"))
    t = t.groupBy("z").agg(F.max(F.struct("seq", "dx", "dy", "a")).alias("t")).select("z", "t.dx", "t.dy", "t.a")
    cy, cx = (height - 1) / 2, (width - 1) / 2
    sizes = voxels.select("z").distinct().join(t, "z", "left").na.fill(0, ["dx", "dy", "a"])
    aim = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    v, u = F.col("y") - F.col("dy") - cy, F.col("x") - F.col("dx") - cx
    # A turn by the negative angle, as the alignment tool has it.
    sy = F.floor(cy + v * F.cos("a") - u * F.sin("a") + 0.5).cast("int")
    sx = F.floor(cx + v * F.sin("a") + u * F.cos("a") + 0.5).cast("int")
    source = voxels.select("z", F.col("y").alias("sy"), F.col("x").alias("sx"), "gray", "label")
    out = aim.withColumn("sy", sy).withColumn("sx", sx).join(source, ["z", "sy", "sx"], "left")
    return out.select("z", "y", "x", F.coalesce("gray", F.lit(0)).alias("gray"), F.coalesce("label", F.lit(0)).alias("label"))


def gradient_edges(voxels: DataFrame, threshold: int) -> DataFrame:
    """(z, y, x): pixels whose grey differs from the right or lower neighbour by at least the threshold."""
    at = voxels.select("z", "y", "x", "gray")
    right = at.select("z", "y", (F.col("x") - 1).alias("x"), F.col("gray").alias("_r"))
    below = at.select("z", (F.col("y") - 1).alias("y"), "x", F.col("gray").alias("_b"))
    both = at.join(right, ["z", "y", "x"], "left").join(below, ["z", "y", "x"], "left")
    return both.where((F.abs(F.col("gray") - F.col("_r")) >= threshold) | (F.abs(F.col("gray") - F.col("_b")) >= threshold)).select("z", "y", "x")


def snap(points: DataFrame, edges: DataFrame, half: int = 7) -> DataFrame:
    """Points (id, z, y, x) with the nearest edge pixel (sy, sx) within half a window before and just under it after, or themselves.
    A range join by cells of the window's size: a place looks into the four cells that its window can touch.  Points at one place are looked up once, and
    distance and place of an edge pixel are one whole number, so the nearest is a minimum in a hash table and nothing is sorted."""
    side = 2 * half
    cell = lambda c: F.floor(c / side)
    near = points.select("z", "y", "x").distinct().withColumn("cy", F.explode(F.array_distinct(F.array(cell(F.col("y") - half), cell(F.col("y") + half - 1))))).withColumn("cx", F.explode(F.array_distinct(F.array(cell(F.col("x") - half), cell(F.col("x") + half - 1)))))
    e = edges.select("z", F.col("y").alias("ey"), F.col("x").alias("ex"), cell(F.col("y")).alias("cy"), cell(F.col("x")).alias("cx"))
    hit = near.join(e, ["z", "cy", "cx"]).where((F.col("ey") >= F.col("y") - half) & (F.col("ey") < F.col("y") + half) & (F.col("ex") >= F.col("x") - half) & (F.col("ex") < F.col("x") + half))
    dy, dx = (F.col("ey") - F.col("y")).cast("long"), (F.col("ex") - F.col("x")).cast("long")
    code = ((dy * dy + dx * dx) * side + dy + half) * side + dx + half  # by distance, then by row, then by column
    best = hit.groupBy("z", "y", "x").agg(F.min(code).alias("_b"))
    dy, dx = (F.expr(f"cast(_b div {side} % {side} - {half} as int)"), F.expr(f"cast(_b % {side} - {half} as int)"))
    return points.join(best, ["z", "y", "x"], "left").select("id", "z", "y", "x", F.coalesce(F.col("y") + dy, "y").alias("sy"), F.coalesce(F.col("x") + dx, "x").alias("sx"))
