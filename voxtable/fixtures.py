"""Deterministic volumes made from the driver's tables; whole numbers only, so that engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, HEIGHT, WIDTH = 12, 48, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, depth: int = DEPTH, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Every (z, y, x) of a box."""
    i = F.col("id")
    return spark.range(depth * height * width).select(
        F.expr(f"cast(id div {height * width} as int)").alias("z"), F.expr(f"cast((id div {width}) % {height} as int)").alias("y"), (i % width).cast("int").alias("x")
    )


def primitives(spark: SparkSession, sf_dir: str, depth: int = DEPTH, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Ellipsoids (k, label, cz, cy, cx, r), one for each supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as k", "cast(s_suppkey % 20 as int) + 1 as label", f"cast((s_suppkey * 5) % {depth} as int) as cz", f"cast((s_suppkey * 17 + s_nationkey) % {height} as int) as cy", f"cast((s_suppkey * 29 + 7) % {width} as int) as cx",
        f"(cast(s_suppkey % 5 as int) + 2) * {max(1, height // HEIGHT)} as r",
    )


def inside(prims: DataFrame, depth: int = DEPTH, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """(z, y, x, k, label) of the voxels within each ellipsoid: its bounding box is laid out and then cut, so no join."""
    span = lambda c, r, n: F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1)))
    boxes = prims.withColumn("z", F.explode(span("cz", F.expr("r div 2").cast("int"), depth))).withColumn("y", F.explode(span("cy", F.col("r"), height))).withColumn("x", F.explode(span("cx", F.col("r"), width)))
    return boxes.where("(z-cz)*(z-cz)*4 + (y-cy)*(y-cy) + (x-cx)*(x-cx) <= r*r").select("z", "y", "x", "k", "label")


def phantom(spark: SparkSession, sf_dir: str, depth: int = DEPTH, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """(z, y, x, gray, label): the ellipsoid with the highest key wins; 0 elsewhere.  The ellipsoids grow with the height.  Of equal ellipsoids only that
    with the highest key is laid out, and a voxel's winner is kept in a hash table (``max_by`` of numbers), so no task sorts what covers the voxels."""
    shape = (depth, height, width)
    shapes = primitives(spark, sf_dir, *shape).groupBy("cz", "cy", "cx", "r").agg(F.max_by("label", "k").alias("label"), F.max("k").alias("k"))
    top = inside(shapes, *shape).groupBy("z", "y", "x").agg(F.max_by("label", "k").alias("label"))
    return grid(spark, *shape).join(top, ["z", "y", "x"], "left").selectExpr("z", "y", "x", "cast((x*3 + y*5 + z*7) % 256 as int) as gray", "coalesce(label, 0) as label")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, label): every label that covers a voxel."""
    return inside(primitives(spark, sf_dir)).select("z", "y", "x", "label").distinct()


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, label, gray) from lineitem: many rows fall on each of 65,536 cells, the greatest values win."""
    cells = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey % 16 as int) as z", "cast(l_partkey % 64 as int) as y", "cast((l_suppkey*7 + l_linenumber*13 + cast(l_quantity as bigint)) % 64 as int) as x",
        "cast(l_quantity as int) % 21 as label", "cast(floor(l_extendedprice) as bigint) % 256 as gray",
    )
    return cells.groupBy("z", "y", "x").agg(F.max("label").alias("label"), F.max("gray").alias("gray"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, path_id, seq, label, pts): one quadrilateral for each part; they overlap."""
    corner = "array(struct(cast({0} as double) as x, cast({1} as double) as y), struct(cast({2} as double) as x, cast({1} + 3 as double) as y), struct(cast({2} - 2 as double) as x, cast({3} as double) as y), struct(cast({0} + 1 as double) as x, cast({3} - 4 as double) as y))"
    x0, y0 = "(p_partkey * 7 % 24)", "(p_partkey * 11 % 24)"
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey % 12 as int) as z", "p_partkey as path_id", "cast(p_partkey as int) as seq", "cast(p_partkey % 20 as int) + 1 as label",
        corner.format(x0, y0, f"({x0} + 12 + p_partkey % 9)", f"({y0} + 14 + p_partkey % 7)") + " as pts",
    )


GRID_SQL = f"select cast(i // {HEIGHT * WIDTH} as int) z, cast((i // {WIDTH}) % {HEIGHT} as int) y, cast(i % {WIDTH} as int) x from range(0, {DEPTH * HEIGHT * WIDTH}) t(i)"
PRIM_SQL = """select s_suppkey k, cast(s_suppkey % 20 as int)+1 label, cast((s_suppkey*5) % 12 as int) cz, cast((s_suppkey*17+s_nationkey) % 48 as int) cy,
  cast((s_suppkey*29+7) % 48 as int) cx, cast(s_suppkey % 5 as int)+2 r from supplier"""
#: Common table expressions ``v`` (phantom) and ``m`` (memberships), for DuckDB.
PHANTOM_SQL = f"""prim as ({PRIM_SQL}), grid as ({GRID_SQL}),
hits as (select g.z, g.y, g.x, p.k, p.label from grid g join prim p on (g.z-p.cz)*(g.z-p.cz)*4 + (g.y-p.cy)*(g.y-p.cy) + (g.x-p.cx)*(g.x-p.cx) <= p.r*p.r),
v as (select g.z, g.y, g.x, cast((g.x*3+g.y*5+g.z*7) % 256 as int) gray, coalesce(h.label, 0) label from grid g
  left join (select z, y, x, arg_max(label, k) label from hits group by z, y, x) h on g.z=h.z and g.y=h.y and g.x=h.x),
m as (select distinct z, y, x, label from hits)"""
SCATTER_SQL = """s as (select z, y, x, max(label) label, max(gray) gray from (
  select cast(l_orderkey % 16 as int) z, cast(l_partkey % 64 as int) y, cast((l_suppkey*7 + l_linenumber*13 + cast(l_quantity as bigint)) % 64 as int) x,
         cast(l_quantity as int) % 21 label, cast(floor(l_extendedprice) as bigint) % 256 gray from lineitem) group by 1, 2, 3)"""
_X0, _Y0 = "(p_partkey * 7 % 24)", "(p_partkey * 11 % 24)"
#: ``corners``: (z, path_id, label, i, x, y), and ``cover``: (path_id, z, y, x, label) of pixel centres inside by the even-odd rule.
POLYGON_SQL = f"""corners as (select cast(p_partkey % 12 as int) z, p_partkey path_id, cast(p_partkey % 20 as int)+1 label, unnest([
  {{'i': 0, 'x': {_X0}, 'y': {_Y0}}}, {{'i': 1, 'x': {_X0} + 12 + p_partkey % 9, 'y': {_Y0} + 3}}, {{'i': 2, 'x': {_X0} + 12 + p_partkey % 9 - 2, 'y': {_Y0} + 14 + p_partkey % 7}}, {{'i': 3, 'x': {_X0} + 1, 'y': {_Y0} + 14 + p_partkey % 7 - 4}}]) c
  from part),
edges as (select a.path_id, a.z, a.label, a.c.x ax, a.c.y ay, b.c.x bx, b.c.y by_ from corners a join corners b on a.path_id = b.path_id and b.c.i = (a.c.i + 1) % 4),
crossed as (select path_id, z, label, y, ax + (y + 0.5 - ay) * (bx - ax) / cast(by_ - ay as double) cx from edges, (select cast(i as int) y from range(0, {HEIGHT}) t(i))
  where (ay <= y + 0.5 and by_ > y + 0.5) or (by_ <= y + 0.5 and ay > y + 0.5)),
cover as (select path_id, c.z, y, px x, label from crossed c, (select cast(i as int) px from range(0, {WIDTH}) t(i)) where cx <= px + 0.5 group by path_id, c.z, y, px, label having count(*) % 2 = 1)"""
