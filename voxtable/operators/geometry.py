"""Paths and polygons: parsing, rasterising, lengths and areas, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def spans(paths: DataFrame, height: int, width: int) -> DataFrame:
    """(path_id, z, y, x0, x1, label): runs of pixel centres inside each closed path, ends included, by the even-odd rule.

    Edges are laid out over the rows they cross, and crossings of a row are paired: work in proportion to edges and rows, no join of pixels with
    paths.  ``paths``: (path_id, z, label, pts); several rows of one path_id are its subpaths.
    """
    pts = F.col("pts")
    edges = paths.where(F.size("pts") > 2).select("path_id", "z", "label", F.posexplode("pts").alias("i", "a"), pts).select("path_id", "z", "label", "a", F.expr("pts[(i + 1) % size(pts)]").alias("b")).where("a.y <> b.y")
    lo, hi = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    first, last = F.greatest(F.ceil(lo - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(hi - 0.5) - 1, F.lit(height - 1)).cast("int")
    rows = edges.withColumn("y", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    cross = rows.withColumn("cx", F.col("a.x") + (F.col("y") + 0.5 - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y")))
    row = Window.partitionBy("path_id", "z", "y").orderBy("cx")
    paired = cross.withColumn("n", F.row_number().over(row)).withColumn("to", F.lead("cx").over(row)).where("n % 2 = 1 and to is not null")
    x0, x1 = F.greatest(F.ceil(F.col("cx") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return paired.where(x0 <= x1).select("path_id", "z", "y", x0.alias("x0"), x1.alias("x1"), "label")


def rasterise(paths: DataFrame, height: int, width: int) -> DataFrame:
    """(path_id, z, y, x, label) of pixel centres inside each closed path: its ``spans`` laid out."""
    return spans(paths, height, width).select("path_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def parse_points(text: Column) -> Column:
    """Points of a ``points`` attribute; an odd number at the end is left out."""
    n = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda v: v.cast("double"))
    firsts = F.filter(F.sequence(F.lit(0), F.size(n)), lambda i: (i % 2 == 0) & (i + 1 < F.size(n)))
    return F.transform(firsts, lambda i: F.struct(F.get(n, i).alias("x"), F.get(n, i + 1).alias("y")))


def parse_subpaths(d: Column) -> Column:
    """array<array<point>> of a path's absolute M, L and Z commands; other commands are passed over."""
    parts = F.filter(F.split(d, "(?=M)"), lambda s: s.contains("M"))
    return F.transform(parts, lambda s: _points_of(F.regexp_extract_all(s, F.lit(rf"[ML]\s*({_NUMBER})[\s,]+({_NUMBER})"), F.lit(0))))


def _points_of(commands: Column) -> Column:
    pair = rf"({_NUMBER})[\s,]+({_NUMBER})"
    return F.transform(commands, lambda c: F.struct(F.regexp_extract(c, pair, 1).cast("double").alias("x"), F.regexp_extract(c, pair, 2).cast("double").alias("y")))


def rect_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))


def scale_points(pts: Column, fx: Column, fy: Column) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] * fx).alias("x"), (p["y"] * fy).alias("y")))


def shoelace(pts: Column) -> Column:
    """Area of a closed polygon."""
    n = F.size(pts)
    terms = F.transform(pts, lambda p, i: p["x"] * F.get(pts, (i + 1) % n)["y"] - F.get(pts, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def to_svg(pts: Column, closed: bool = True) -> Column:
    """``M x y L x y ... Z``."""
    words = F.array_join(F.transform(pts, lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), " ")
    return F.concat(words, F.lit(" Z")) if closed else words


def smooth_curve(pts: Column, steps: int = 8) -> Column:
    """Catmull-Rom curve through the points as cubic pieces with tension a sixth; end points are repeated as phantoms."""
    last = F.size(pts) - 1

    def at(i: Column) -> Column:
        return F.get(pts, F.least(F.greatest(i, F.lit(0)), last))

    def piece(i: Column) -> Column:
        p0, p1, p2, p3 = at(i - 1), at(i), at(i + 1), at(i + 2)

        def point(k: Column) -> Column:
            t = k / F.lit(float(steps))
            u = 1 - t

            def bez(c: str) -> Column:
                c1, c2 = p1[c] + (p2[c] - p0[c]) / 6, p2[c] - (p3[c] - p1[c]) / 6
                return u * u * u * p1[c] + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * p2[c]

            return F.struct(bez("x").alias("x"), bez("y").alias("y"))

        return F.transform(F.sequence(F.lit(1), F.lit(steps)), point)

    curve = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), piece))
    return F.when(F.size(pts) < 2, pts).otherwise(F.concat(F.slice(pts, 1, 1), curve))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether each point of an open line stays: the ends, and between two that stay the first of those farthest from the straight line through them,
    if it is farther than the tolerance (from the point itself, where both are the same)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        dx, dy, px, py = x[j] - x[i], y[j] - y[i], x[i + 1 : j] - x[i], y[i + 1 : j] - y[i]
        size = dx * dx + dy * dy
        far = (dx * py - dy * px) ** 2 if size else px * px + py * py
        k = int(np.argmax(far))
        if far[k] > tolerance * tolerance * (size or 1):
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def _simplified(pts: pd.Series, tolerance: pd.Series) -> pd.Series:
    out = []
    for line, t in zip(pts, tolerance, strict=True):
        if line is None or len(line) < 3:
            out.append(line)
            continue
        x, y = (np.array([p[c] for p in line], float) for c in "xy")
        out.append([line[i] for i in np.flatnonzero(kept_points(x, y, t))])
    return pd.Series(out, dtype=object)


def simplify(pts: Column, tolerance: float) -> Column:
    """The line with fewer points, none of those left out farther than the tolerance from the straight lines that stand for them (Douglas and Peucker).  Null
    stays null; lines of two points and fewer stay."""
    return F.pandas_udf(_simplified, POINTS)(pts, F.lit(float(tolerance)))


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def measure(lines: DataFrame, mm_per_px: Column | float | None) -> DataFrame:
    """Lines with ``px`` and ``mm`` (null before calibration)."""
    mm = F.lit(mm_per_px).cast("double") if not isinstance(mm_per_px, Column) else mm_per_px
    return lines.withColumn("px", length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn("mm", F.col("px") * mm)


def calibrate(real_mm: Column, px: Column) -> Column:
    """Millimetres a pixel; 1 for a line without length."""
    return F.when(px > 0, real_mm / px).otherwise(1.0)


def to_percent(v: Column, whole: Column) -> Column:
    return v / whole * 100


def from_percent(p: Column, whole: Column) -> Column:
    return (p / 100 * whole).cast("int")


def bring(paths: DataFrame, label: int, front: bool = True) -> DataFrame:
    """One label's paths after (or before) all others, otherwise in their order; ``seq`` is numbered anew within a slice."""
    first = F.when(F.col("label") == label, F.lit(1 if front else -1)).otherwise(0)
    return paths.withColumn("seq", F.row_number().over(Window.partitionBy("z").orderBy(first, "seq")))


def keep_large(paths: DataFrame, threshold: float) -> DataFrame:
    """Subpaths of at least that area (the polygon's own, not its pixels)."""
    return paths.where(shoelace(F.col("pts")) >= threshold)


def intersections(paths: DataFrame, height: int, width: int, chunk: int = 128) -> DataFrame:
    """(z, a, b, pixels) of paths that share pixels, each pair once with a < b.

    Equal paths of a slice are one class, and only the ``spans`` of one path of each class meet: two runs that overlap on a line add their common
    length, so pixels are neither laid out nor gathered.  Every pair of members follows: a class's members, in order, are cut into chunks and dealt to
    lists of four chunks (more would not do: a generator holds the pairs of one row in memory), and a pair of lists is a row that is laid out where it is, so a task holds lists and not their pairs, and a member is shuffled
    once for a list that it meets, as its distance from the chunk's first (a chunk ends where 31 bits would not hold it).  Pairs come chunk by chunk: ``a`` stays while ``b`` goes through a chunk, again and again the same one, and a task has
    neighbouring lists, so files of the result hold runs and repeated stretches, some bits a pair.  Sizes are misjudged here: no join may broadcast,
    and tasks are as many as the pairs need that there can be."""
    whole = paths.where("path_id is not null and z is not null").groupBy("z", "path_id").agg(F.sort_array(F.collect_list("pts")).alias("form"))
    order = Window.partitionBy("z", "form").orderBy("path_id")
    members = whole.select("z", "form", "path_id", F.first("path_id").over(order).alias("rep"), (F.row_number().over(order) - 1).alias("i"))
    runs = spans(members.where("i = 0").select("z", "path_id", F.lit(0).alias("label"), F.explode("form").alias("pts")), height, width)
    one = runs.select("z", "y", F.col("path_id").alias("a"), "x0", "x1")
    two = runs.select("z", "y", F.col("path_id").alias("b"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    met = one.join(two.hint("merge"), ["z", "y"]).where("a <= b and x0 <= _x1 and _x0 <= x1")
    met = met.groupBy("z", "a", "b").agg(F.sum(F.least("x1", "_x1") - F.greatest("x0", "_x0") + 1).cast("long").alias("pixels"))
    chunks = members.groupBy("z", "form", "rep", F.expr(f"i div {chunk}").alias("c"), F.shiftright("path_id", 31)).agg(F.sort_array(F.collect_list("path_id")).alias("ids"))
    chunks = chunks.select("z", "form", "rep", "c", F.expr("struct(ids[0] as at, transform(ids, k -> cast(k - ids[0] as int)) as on) as ids"))
    lists = chunks.groupBy("z", "form", "rep", F.expr("c div 4").alias("part")).agg(F.collect_list("ids").alias("ids"))
    left, right = (lists.select("z", F.col("rep").alias(c), F.col("part").alias(f"_{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
    units = met.join(left.hint("merge"), ["z", "a"]).join(right.hint("merge"), ["z", "b"]).where("a < b or _a <= _b").repartitionByRange(_tasks(paths), "z", "a", "_a", "b", "_b")
    there, back = (F.struct(F.col(f"ids_{a}").alias("l"), F.col(f"ids_{b}").alias("r")) for a, b in ("ab", "ba"))
    ways = units.select("z", F.explode(F.when(F.expr("a = b and _a = _b"), F.array(there)).otherwise(F.array(there, back))).alias("way"), "pixels")
    sides = ways.select("z", F.explode("way.l").alias("l"), "way.r", "pixels").select("z", "l", F.explode("r").alias("r"), "pixels").where("l.at < r.at + r.on[size(r.on) - 1]")
    ones = sides.select("z", "l.at", F.explode("l.on").alias("on"), "r", "pixels").select("z", F.expr("at + on").alias("a"), "r", "pixels")
    return ones.select("z", "a", "r.at", F.explode("r.on").alias("on"), "pixels").select("z", "a", F.expr("at + on").alias("b"), "pixels").where("a < b")


def _tasks(paths: DataFrame) -> int:
    """A task for each million pairs that there can be, if all paths of a slice meet; from 200 tasks on, for each 64 millions."""
    most = paths.groupBy("z").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    return int(max(1, min(most / 1e6, max(200, most / 64e6), 10_000)))


def recolored(first: DataFrame, second: DataFrame, labels: int = 20) -> DataFrame:
    """(label, new_label) for the second of two path sets to be laid together: labels that the first uses too move to free ones in order;
    when none is free, the last is used again.  Both inputs shrink to at most 20 labels before anything meets."""
    a, b = first.select("label").distinct(), second.select("label").distinct()
    order = Window.orderBy("label")
    taken = a.unionByName(b).distinct()
    free = first.sparkSession.range(1, labels + 1).select(F.col("id").cast("int").alias("label")).join(taken, "label", "left_anti")
    slots = free.select(F.row_number().over(order).alias("n"), F.col("label").alias("slot"))
    clash = b.join(a, "label", "left_semi").withColumn("n", F.row_number().over(order))
    moved = clash.join(slots, "n", "left").select("label", F.coalesce("slot", F.lit(labels)).alias("new_label"))
    return b.join(moved, "label", "left").select("label", F.coalesce("new_label", "label").alias("new_label"))


def outline(y: np.ndarray, x: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed outlines along pixel sides, holes included; only corners are kept.  Rasterising them gives back exactly the pixels."""
    here = set(zip(y.tolist(), x.tolist(), strict=True))
    sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in sorted(here):  # directed, the pixel on the right
        for other, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if other not in here:
                sides.setdefault(a, []).append(b)
    loops = []
    while sides:
        start = next(iter(sides))
        loop, at = [start], start
        while True:
            at, used = sides[at].pop(), at
            if not sides[used]:
                del sides[used]
            if at == start:
                break
            loop.append(at)
        turns = [p for q, p, n in zip([loop[-1], *loop[:-1]], loop, [*loop[1:], loop[0]], strict=True) if (p[0] - q[0]) * (n[1] - p[1]) != (p[1] - q[1]) * (n[0] - p[0])]
        loops.append([(float(a), float(b)) for a, b in turns])
    return loops


def contours(voxels: DataFrame) -> DataFrame:
    """(path_id, z, label, subpath, pts): the outlines of each label on each slice; path_id is z * 32 + label.  A slice's label is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, label = int(pdf["z"].iloc[0]), int(pdf["label"].iloc[0])
        loops = outline(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        return pd.DataFrame({"path_id": z * 32 + label, "z": z, "label": label, "subpath": range(len(loops)), "pts": [[{"x": a, "y": b} for a, b in p] for p in loops]})

    fore = voxels.where("label > 0").select("z", "label", "y", "x")
    return fore.groupBy("z", "label").applyInPandas(run, f"path_id long, z int, label int, subpath int, pts {POINTS}")
