"""Indexed surfaces of labels: marching cubes as an aggregation and a join, and work on meshes as tables.

A cube lies between eight voxels; which of them a label holds is a code of eight bits, summed from rows that each voxel gives to its eight
cubes.  The code is joined with a table of cases, derived by rule: on each face of the cube every run of corners inside is cut off from the
corners outside (of two diagonal ones each on its own), so neighbouring cubes agree on their common face; the cuts of the six faces
chain to closed loops, and loops are fanned into triangles.  So surfaces are closed: each side of a triangle is met by as many the other way round.

A vertex lies in the middle of the grid edge that it cuts, and that edge is its number: cubes that share it name it alike, without
any meeting of theirs.  Coordinates are whole numbers (``UNIT`` to a voxel), and so are the steps of smoothing, so results do not depend on the order
of addition.  No label and no slab of a volume is held in one task.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from . import zspline

UNIT = 1 << 20
_SIDE = 1 << 20  # slices, rows and columns of a volume, at most
#: A cube's corners as (z, y, x), its edges as (axis, corner), and its faces as corners in a cycle, seen from outside.
CORNERS = list(itertools.product((0, 1), repeat=3))
EDGES = [(axis, c) for axis in range(3) for c in CORNERS if not c[axis]]


def _faces() -> list[list[tuple[int, int, int]]]:
    out = []
    for axis in range(3):
        u, v = [a for a in range(3) if a != axis]
        for side in (0, 1):
            cycle = []
            for du, dv in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = [0, 0, 0]
                c[axis], c[u], c[v] = side, du, dv
                cycle.append(tuple(c))
            # Right-handed about the outward normal: axes (z, y, x) taken in a cycle turn one way, the middle one the other.
            out.append(cycle if (side == 1) == (axis != 1) else cycle[::-1])
    return out


def _edge(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    axis = next(i for i in range(3) if a[i] != b[i])
    return EDGES.index((axis, min(a, b)))


@functools.cache
def cases() -> list[tuple[int, int, int, int, int]]:
    """(code, n, e1, e2, e3): the n-th triangle of a cube with that code, by the edges that its vertices cut."""
    out = []
    for code in range(256):
        inside = {c for i, c in enumerate(CORNERS) if code >> i & 1}
        follows = {}
        for cycle in _faces():
            for i in range(4):
                if cycle[i] in inside and cycle[(i + 1) % 4] not in inside:  # the end of a run of corners inside
                    j = i
                    while cycle[j - 1] in inside:
                        j -= 1
                    follows[_edge(cycle[i], cycle[(i + 1) % 4])] = _edge(cycle[j - 1], cycle[j])
        n = 0
        while follows:
            loop = [min(follows)]
            while (on := follows.pop(loop[-1])) != loop[0]:
                loop.append(on)
            for a, b in itertools.pairwise(loop[1:]):
                out.append((code, n, loop[0], a, b))
                n += 1
    return out


def case_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cases(), "code int, n int, e1 int, e2 int, e3 int")


def codes(voxels: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """(label, z, y, x, code) of the cubes that a label's surface goes through, by their lowest corner, from -1.  With ``labels``, of these only."""
    fore = voxels.where("label > 0") if labels is None else voxels.where(F.col("label").isin(labels) & (F.col("label") > 0))
    corner = F.explode(F.array(*[F.struct((F.col("z") - c[0]).alias("z"), (F.col("y") - c[1]).alias("y"), (F.col("x") - c[2]).alias("x"), F.lit(1 << i).alias("bit")) for i, c in enumerate(CORNERS)]))
    summed = fore.select("label", corner.alias("c")).groupBy("label", "c.z", "c.y", "c.x").agg(F.sum("c.bit").cast("int").alias("code"))
    return summed.where("code < 255")


def vertex_id(z: Column, y: Column, x: Column, axis: Column) -> Column:
    """The number of the grid edge from (z, y, x) along an axis; coordinates from -1."""
    return ((((z.cast("long") + 1) * _SIDE + y + 1) * _SIDE) + x + 1) * 4 + axis


def faces(voxels: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """(label, face, a, b, c): triangles by the numbers of their vertices, turned outwards for right-handed (x, y, z).

    ``face`` tells the label's triangles apart.  The case table has fewer than 1300 rows, whatever the volume: it is broadcast."""
    at = codes(voxels, labels).join(F.broadcast(case_table(voxels.sparkSession)), "code")

    def named(e: str) -> Column:
        table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("dz", "dy", "dx", "axis"), (*c, axis), strict=True)]) for axis, c in EDGES])
        edge = F.get(table, F.col(e))
        return vertex_id(F.col("z") + edge["dz"], F.col("y") + edge["dy"], F.col("x") + edge["dx"], edge["axis"])

    face = vertex_id(F.col("z"), F.col("y"), F.col("x"), F.lit(0)) * 2 + F.col("n")  # up to five triangles: below the next number, 8 on
    return at.select("label", face.alias("face"), named("e1").alias("a"), named("e2").alias("b"), named("e3").alias("c"))


def vertices(mesh: DataFrame) -> DataFrame:
    """(label, v, z, y, x): the vertices that faces name, in UNITs from the centre of voxel (0, 0, 0)."""
    v = mesh.select("label", F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    axis, cell = F.col("v") % 4, F.shiftright("v", 2)
    place = {"x": cell % _SIDE, "y": F.shiftright(cell, 20) % _SIDE, "z": F.shiftright(cell, 40)}
    return v.select("label", "v", *[((place[c] - 1) * UNIT + F.when(axis == i, UNIT // 2).otherwise(0)).alias(c) for i, c in enumerate("zyx")])


def sides(mesh: DataFrame) -> DataFrame:
    """(label, a, b): each neighbour b of each vertex a, once."""
    both = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in itertools.permutations("abc", 2)])
    return mesh.select("label", F.explode(both).alias("s")).select("label", "s.a", "s.b").distinct()


def counts(mesh: DataFrame) -> DataFrame:
    """(label, vertices, sides, faces, euler)."""
    n = mesh.groupBy("label").agg(F.count("*").alias("faces"))
    s = sides(mesh).groupBy("label", "a").agg(F.count("*").alias("k")).groupBy("label").agg(F.count("*").alias("vertices"), (F.sum("k") / 2).cast("long").alias("sides"))
    return n.join(s, "label").select("label", "vertices", "sides", "faces", (F.col("vertices") - F.col("sides") + F.col("faces")).alias("euler"))


def smooth(mesh: DataFrame, points: DataFrame, level: int = 5, percent: int = 50) -> DataFrame:
    """Vertices (label, v, z, y, x) after 10 + 5 * level rounds of Laplacian smoothing, each of which moves every vertex ``percent`` of the way to the
    mean of its neighbours, rounded down to whole units.

    A round is a join and an aggregation by vertex, which combines before its shuffle; every fifth is written as a table, so plans stay short."""
    near = settle(sides(mesh))
    rounds = 10 + 5 * level if level > 0 else 0
    high = UNIT * 4  # keeps sums positive, so that whole division rounds down
    for i in range(rounds):
        met = near.join(points.withColumnRenamed("v", "b"), ["label", "b"]).groupBy("label", F.col("a").alias("v"))
        sums = met.agg(F.count("*").alias("_k"), *[F.sum(F.col(c) + high).alias(f"_{c}") for c in "zyx"])
        moved = lambda c: F.expr(f"(({c} + {high}) * _k * {100 - percent} + _{c} * {percent}) div (_k * 100) - {high}")
        points = points.join(sums, ["label", "v"]).select("label", "v", *[moved(c).alias(c) for c in "zyx"])
        if i % 5 == 4 or i == rounds - 1:
            points = settle(points)
    return points


def triangles(mesh: DataFrame, points: DataFrame, sz: float, sy: float, sx: float) -> DataFrame:
    """(label, ax, ay, az .. cz): faces with the places of their corners, in millimetres."""
    corner = F.posexplode(F.array("a", "b", "c")).alias("i", "v")
    placed = mesh.select("label", "face", corner).join(points, ["label", "v"])
    mm = F.struct(*[(F.col(c) / UNIT * s).alias(c) for c, s in (("x", sx), ("y", sy), ("z", sz))])
    whole = placed.groupBy("label", "face").agg(*[F.max(F.when(F.col("i") == i, mm)).alias(p) for i, p in enumerate("abc")])
    return whole.select("label", *[F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "abc" for c in "xyz"])


def surface(voxels: DataFrame, sz: float, sy: float, sx: float, *, labels: list[int] | None = None, level: int = 0, depth: int | None = None, smoothing: bool = True) -> DataFrame:
    """Triangles (label, ax .. cz) of the visible labels' surfaces: what an STL file is written from.  At a ``level`` above 0 slices are put between those of a
    stack whose ``depth`` is given, which then lie closer together, and vertices are smoothed unless ``smoothing`` is off."""
    if depth is not None and zspline.slices_after(depth, level) != depth:
        voxels, sz = zspline.interpolated(voxels, level, depth, labels=labels), sz / zspline.factor(level)
    mesh = faces(voxels, labels)
    if level > 0 and smoothing:
        mesh = settle(mesh)
        return triangles(mesh, smooth(mesh, settle(vertices(mesh)), level), sz, sy, sx)
    return triangles(mesh, vertices(mesh), sz, sy, sx)
