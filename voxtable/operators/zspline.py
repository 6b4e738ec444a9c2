"""Slices between slices: masks of labels resampled along z by interpolating cubic splines, in slabs and tiles.

The spline's coefficients come from a recursive filter that runs up and down z, over all columns of a tile at once.  Its memory fades by the pole
(0.268 a slice), so a slab that overlaps its neighbours by ``HALO`` slices has the coefficients of the whole stack, to the last digits of a double; at
the ends of the stack it is mirrored.  A task holds one slab of one tile of one label, whatever the volume.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLE = 3**0.5 - 2
HALO = 32
#: Above a half by this much is inside: exact ties are outside, however they are rounded.
LEVEL = 0.5 + 1e-6


def factor(level: int) -> float:
    """Slices after for each slice before."""
    return 1 + 0.4 * level


def slices_after(depth: int, level: int) -> int:
    return int(round(depth * factor(level)))


def coefficients(values: np.ndarray) -> np.ndarray:
    """Spline coefficients along the first axis, mirrored at both ends."""
    n = len(values)
    if n == 1:
        return values.copy()
    c = 6 * values
    reach = np.arange(64)  # beyond this the pole's power is nothing
    mirrored = np.abs((reach + n - 1) % (2 * (n - 1)) - (n - 1))
    c[0] = np.tensordot(POLE**reach, c[mirrored], axes=1)
    for k in range(1, n):
        c[k] += POLE * c[k - 1]
    c[-1] = POLE / (POLE * POLE - 1) * (c[-1] + POLE * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = POLE * (c[k + 1] - c[k])
    return c


def sampled(c: np.ndarray, first: int, at: np.ndarray, depth: int) -> np.ndarray:
    """The spline's values at places ``at`` of a stack of ``depth`` slices; c: coefficients of the slices from ``first`` on."""
    base = np.floor(at).astype(int)
    out = np.zeros((len(at), *c.shape[1:]))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
        place = np.abs((base + k + depth - 1) % (2 * (depth - 1)) - (depth - 1)) - first if depth > 1 else np.zeros(len(at), int)
        out += w.reshape(-1, *[1] * (c.ndim - 1)) * c[np.clip(place, 0, len(c) - 1)]
    return out


def interpolated(voxels: DataFrame, level: int, depth: int, *, labels: list[int] | None = None, slab: int = 64, tile: int = 64) -> DataFrame:
    """(label, z, y, x): each label's mask over ``slices_after(depth, level)`` slices of a stack that had ``depth``, spread from the first slice to the
    last.  Masks may overlap.  Level 0 changes nothing."""
    fore = voxels.where(F.col("label") > 0 if labels is None else F.col("label").isin(labels) & (F.col("label") > 0)).select("label", "z", "y", "x")
    after = slices_after(depth, level)
    if after == depth or depth < 2:
        return fore
    # New slice m lies at m * step; slab s makes the new slices from s * slab on.
    step = (depth - 1) / (after - 1)
    last_slab = (after - 1) // slab
    reach = HALO + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, s, ty, tx = (int(pdf[c].iloc[0]) for c in ("label", "_s", "_ty", "_tx"))
        new = np.arange(s * slab, min((s + 1) * slab, after))
        first, last = max(0, int(new[0] * step) - reach), min(depth - 1, int(new[-1] * step) + 1 + reach)
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        mask = np.zeros((last - first + 1, int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1))
        z = pdf["z"].to_numpy() - first
        ok = (z >= 0) & (z < len(mask))
        mask[z[ok], pdf["y"].to_numpy()[ok] - y0, pdf["x"].to_numpy()[ok] - x0] = 1
        m, y, x = np.nonzero(sampled(coefficients(mask), first, new * step, depth) > LEVEL)
        return pd.DataFrame({"label": label, "z": new[m], "y": y + y0, "x": x + x0}).astype(np.int32)

    lo = F.greatest(F.floor((F.col("z") - reach - 1) / step / slab), F.lit(0))
    hi = F.least(F.floor((F.col("z") + reach + 1) / step / slab), F.lit(last_slab))
    rows = fore.withColumn("_s", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).withColumn("_ty", F.floor(F.col("y") / tile).cast("int")).withColumn("_tx", F.floor(F.col("x") / tile).cast("int"))
    return rows.groupBy("label", "_s", "_ty", "_tx").applyInPandas(run, "label int, z int, y int, x int")
