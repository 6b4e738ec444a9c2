"""Surfaces of labels: marching tetrahedra, smoothing, slice interpolation.

A label's mask is cut into slabs of slices that share one slice with the next, so surfaces are made in parallel and no task holds a whole
volume.  The cases of a tetrahedron follow from which corners are inside; no table of cubes is needed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIANGLES = "label int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
_CORNERS = np.array(list(itertools.product((0, 1), repeat=3)))
#: Six tetrahedra around the cube's long diagonal: a step along each axis, in every order.
_TETRAHEDRA = [[0, 4 >> a, (4 >> a) | (4 >> b), 7] for a, b in itertools.permutations(range(3), 2)]


def surface(mask: np.ndarray, spacing: tuple[float, float, float], origin: tuple[float, float, float] = (0, 0, 0), level: float = 0.5) -> np.ndarray:
    """(n, 3, 3) triangles around the cells above the level, as points (x, y, z), turned outwards.  mask: (z, y, x) values."""
    v = mask.astype(np.float64)
    if min(v.shape) < 2:
        return np.zeros((0, 3, 3))
    cubes = np.stack([v[dz : v.shape[0] - 1 + dz, dy : v.shape[1] - 1 + dy, dx : v.shape[2] - 1 + dx] for dz, dy, dx in _CORNERS], axis=-1)
    inside = (cubes > level).sum(axis=-1)
    at = np.argwhere((inside > 0) & (inside < 8))
    val = cubes[tuple(at.T)]
    out = []
    for tet in _TETRAHEDRA:
        pos = (at[:, None, :] + _CORNERS[tet][None]).astype(np.float64)
        w = val[:, tet]
        up = w > level
        n_up = up.sum(axis=1)
        for count in (1, 2, 3):
            rows = np.flatnonzero(n_up == count)
            if not len(rows):
                continue
            order = np.argsort(~up[rows] if count < 3 else up[rows], axis=1, kind="stable")
            p = np.take_along_axis(pos[rows], order[:, :, None], axis=1)
            q = np.take_along_axis(w[rows], order, axis=1)

            def cut(i: int, j: int, p: np.ndarray = p, q: np.ndarray = q) -> np.ndarray:
                t = ((level - q[:, i]) / (q[:, j] - q[:, i]))[:, None]
                return p[:, i] + t * (p[:, j] - p[:, i])

            if count == 2:
                a, b, c, d = cut(0, 2), cut(0, 3), cut(1, 3), cut(1, 2)
                tris = np.concatenate([np.stack([a, b, c], axis=1), np.stack([a, c, d], axis=1)])
                inner = np.concatenate([p[:, :2].mean(axis=1)] * 2)
            else:
                tris = np.stack([cut(0, 1), cut(0, 2), cut(0, 3)], axis=1)
                inner = p[:, 0] if count == 1 else p[:, 1:].mean(axis=1)
            normal = np.cross(tris[:, 1] - tris[:, 0], tris[:, 2] - tris[:, 0])
            inward = np.einsum("ij,ij->i", normal, inner - tris[:, 0]) > 0
            tris[inward] = tris[inward][:, [0, 2, 1]]
            out.append(tris)
    if not out:
        return np.zeros((0, 3, 3))
    points = np.concatenate(out) * np.array(spacing) + np.array(origin)
    turned = points[..., ::-1]  # to x, y, z: a mirror image, so turn each triangle round
    return np.ascontiguousarray(turned[:, [0, 2, 1]])


def triangles(voxels: DataFrame, sz: float, sy: float, sx: float, slab: int = 32) -> DataFrame:
    """Triangles of every label's surface: TRIANGLES."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, s = int(pdf["label"].iloc[0]), int(pdf["slab"].iloc[0])
        y0, x0, z0 = int(pdf["y"].min()) - 1, int(pdf["x"].min()) - 1, s * slab - 1
        mask = np.zeros((slab + 1, int(pdf["y"].max()) - y0 + 2, int(pdf["x"].max()) - x0 + 2))
        mask[pdf["z"] - z0, pdf["y"] - y0, pdf["x"] - x0] = 1
        t = surface(mask, (sz, sy, sx), (z0 * sz, y0 * sy, x0 * sx)).reshape(-1, 9)
        return pd.DataFrame(np.column_stack([np.full(len(t), label), t]), columns=[c.split()[0] for c in TRIANGLES.split(", ")]).astype({"label": np.int32})

    # Slab s holds cubes between slices s*slab-1 and (s+1)*slab-1, so a slice on a seam goes to both sides.
    own = F.floor((F.col("z") + 0) / slab).cast("int")
    sides = F.array_distinct(F.array(own, F.floor((F.col("z") + 1) / slab).cast("int")))
    rows = voxels.where("label > 0").select("label", "z", "y", "x", F.explode(sides).alias("slab"))
    return rows.groupBy("label", "slab").applyInPandas(run, TRIANGLES)


def mesh_size(tris: DataFrame) -> DataFrame:
    """(label, triangles, mm2, mm3): counts, area, and the enclosed volume by the divergence theorem."""
    u, v = [[F.col(f"{p}{c}") - F.col(f"a{c}") for c in "xyz"] for p in "bc"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    volume = (F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6
    return tris.groupBy("label").agg(F.count("*").alias("triangles"), F.sum(area).alias("mm2"), F.sum(volume).alias("mm3"))


def spline_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of n slices in m that are spread from the first to the last: cubic splines through every slice, mirrored at the ends.
    Solved as a whole; ``zspline`` does the same by a recursive filter."""
    at = np.arange(m) * (n - 1) / (m - 1) if m > 1 else np.zeros(1)
    mirror = lambda i: np.abs((i + n - 1) % (2 * (n - 1)) - (n - 1)) if n > 1 else i * 0
    system = np.zeros((n, n))
    for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
        np.add.at(system, (np.arange(n), mirror(np.arange(n) + k)), w)
    weights = np.zeros((m, n))
    base = np.floor(at).astype(int)
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
        np.add.at(weights, (np.arange(m), mirror(base + k)), w)
    return weights @ np.linalg.inv(system)


def interpolate_slices(mask: np.ndarray, level: int) -> tuple[np.ndarray, float]:
    """A small mask with 1 + 0.4 * level times the slices, and the factor; ``zspline.interpolated`` does it over tables."""
    factor, n = 1 + 0.4 * level, mask.shape[0]
    m = int(round(n * factor))
    if n < 2 or m == n:
        return mask > 0.5, factor
    values = spline_weights(n, m) @ mask.reshape(n, -1).astype(float)
    return values.reshape(m, *mask.shape[1:]) > 0.5, factor
