"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import cubes, edges, edits, geometry, history, layers, mesh, raster, report, resample, roi, stack, tracking, zspline
from ..schema import COLORS, GRAYS, OVERLAY_ALPHA, PRESETS, palette
from ..runtime import fresh_folder
from ..sinks import writers
from ..sources import readers
from ..streaming import editlog

AREA, SZ = 0.25, 2.0  # half-millimetre pixels, slices two apart: exact in binary
D, H, W = fx.DEPTH, fx.HEIGHT, fx.WIDTH
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PALETTE_SQL = "pal(label, r, g, b, gray) as (values " + ", ".join(f"({i + 1}, {r}, {g}, {b}, {GRAYS[i]})" for i, (r, g, b) in enumerate(COLORS)) + ")"
LABELS_SQL = "labels20 as (select cast(i as int) as label from range(1, 21) t(i))"
P = "with " + fx.PHANTOM_SQL


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Measurements.


@query(f"""{P}, {LABELS_SQL} select l.label, coalesce(n, 0) as voxels, coalesce(n, 0) * {AREA * SZ} as mm3, coalesce(n, 0) * {AREA * SZ} / 1000 as cm3
from labels20 l left join (select label, count(*) n from v group by label) c on c.label = l.label""")
def label_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.label_volumes(fx.phantom(spark, sf_dir), AREA, SZ)


@query(f"""with {fx.SCATTER_SQL}, {LABELS_SQL} select l.label, coalesce(n, 0) as voxels, coalesce(n, 0) * {AREA * SZ} as mm3, coalesce(n, 0) * {AREA * SZ} / 1000 as cm3
from labels20 l left join (select label, count(*) n from s group by label) c on c.label = l.label""")
def label_volumes_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.label_volumes(fx.scatter(spark, sf_dir), AREA, SZ)


@query(f"""{P}, {LABELS_SQL} select z.z, l.label, coalesce(n, 0) as pixels, coalesce(n, 0) * {AREA} as mm2 from (select distinct z from v) z cross join labels20 l
left join (select z, label, count(*) n from v group by all) c on c.z = z.z and c.label = l.label""")
def slice_areas_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.slice_areas(fx.phantom(spark, sf_dir), AREA)


@query(f"{P} select z, " + ", ".join(f"count(*) filter (label = {i}) * {AREA} as obj_{i}" for i in range(1, 21)) + " from v group by z")
def slice_areas_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.slice_areas_wide(fx.phantom(spark, sf_dir), AREA)


@query(f"""{P} select target_n, extracted_n, target_n * {AREA * SZ} as target_mm3, extracted_n * {AREA * SZ} as extracted_mm3, case when target_n > 0 then extracted_n / target_n * 100.0 else 0.0 end as percent
from (select count(*) target_n, count(*) filter (label = 5) extracted_n from v where label in (10, 5))""")
def threshold_fraction_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.threshold_fraction(fx.phantom(spark, sf_dir), 10, 5, AREA, SZ)


@query(f"""{P} select z + 1 as slice, lpad(cast(z + 1 as varchar), 4, '0') as key, target_n, extracted_n, target_n * {AREA} as target_mm2, extracted_n * {AREA} as extracted_mm2,
case when target_n > 0 then extracted_n / target_n * 100.0 else 0.0 end as percent from (select z, count(*) filter (label in (10, 5)) target_n, count(*) filter (label = 5) extracted_n from v group by z)""")
def threshold_fraction_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.threshold_fraction_slices(fx.phantom(spark, sf_dir), 10, 5, AREA)


@query(f"""{P} select z, remaining_n, extracted_n, case when remaining_n + extracted_n > 0 then extracted_n / (remaining_n + extracted_n) * 100.0 end as percent
from (select z, count(*) filter (label = 10) remaining_n, count(*) filter (label = 10) extracted_n from v group by z)""")
def threshold_fraction_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.threshold_fraction_display(fx.phantom(spark, sf_dir), 10, 10)


@query(f"{P} select distinct label from v where label > 0")
def used_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.used_labels(fx.phantom(spark, sf_dir))


@query(f"{P} select label, count(*) n, min(z) z_min, max(z) z_max, min(y) y_min, max(y) y_max, min(x) x_min, max(x) x_max from v where label > 0 group by label")
def label_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.label_boxes(fx.phantom(spark, sf_dir))


@query(f"{P} select a.label a, b.label b, count(*) voxels, count(*) * {AREA * SZ} mm3 from m a join m b using (z, y, x) where a.label < b.label group by 1, 2")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overlap_pairs(fx.memberships(spark, sf_dir), AREA * SZ)


@query(f"""{P} select 'roi' || label as roi, count(*) voxels_count, 0.5 spacing_x_mm, 0.5 spacing_y_mm, 2.0 spacing_z_mm, 0.5 voxel_volume_mm3, count(*) * 0.5 total_volume_mm3, count(*) * 0.5 / 1000 total_volume_mL
from m group by label""".replace("0.5 spacing_x_mm, 0.5 spacing_y_mm, 2.0 spacing_z_mm, 0.5 voxel", "cast(0.5 as double) spacing_x_mm, cast(0.5 as double) spacing_y_mm, cast(2.0 as double) spacing_z_mm, cast(0.5 as double) voxel").replace("count(*) * 0.5", "count(*) * cast(0.5 as double)"))
def roi_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.roi_volumes(_rois(spark, sf_dir), 0.5, 0.5, 2.0)


@query(f"""{P}, f as (select label, unnest([{{'a': 0, 'z': z, 'y': y, 'x': x}}, {{'a': 0, 'z': z + 1, 'y': y, 'x': x}}, {{'a': 1, 'z': z, 'y': y, 'x': x}}, {{'a': 1, 'z': z, 'y': y + 1, 'x': x}}, {{'a': 2, 'z': z, 'y': y, 'x': x}}, {{'a': 2, 'z': z, 'y': y, 'x': x + 1}}]) f from v where label > 0),
o as (select label, f from f group by label, f having count(*) = 1)
select label, count(*) faces, count(*) filter (f.a = 0) * cast(0.25 as double) + count(*) filter (f.a > 0) * cast(1.0 as double) mm2 from o group by label""")
def exposed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.exposed_faces(fx.phantom(spark, sf_dir), AREA, 0.5 * SZ)


def _rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.memberships(spark, sf_dir).select("z", "y", "x", F.concat(F.lit("roi"), F.col("label").cast("string")).alias("roi"))


# Files: slices written from a table and read back.


@query(f"{P} select z, " + ", ".join(f"count(*) filter (label = {i}) * {AREA} as obj_{i}" for i in range(1, 21)) + " from v group by z")
def measured_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by slice of label masks that were saved as PNG files in a shared folder."""
    folder = fresh_folder(spark)
    writers.save(writers.pictures(fx.phantom(spark, sf_dir), H, W, ["label"]), folder)
    masks, _ = readers.label_masks(spark, folder)
    return report.slice_areas_wide(readers.voxels(masks.withColumn("z", F.col("key").cast("int") - 1), "label"), AREA)


@query(f"{P} select z, sum(label * 12) total, max(label * 12) most, count(*) n from v group by z".replace("sum(label * 12) total", "cast(sum(label * 12) as bigint) total"))
def stacked_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey levels by slice of pictures saved in descending order and read back as a stack, which runs the other way."""
    folder = fresh_folder(spark)
    image = _image(spark, sf_dir)
    writers.save(writers.pictures(image, H, W, ["gray"], "slice{}.png", descending=True), folder)
    slices, _ = readers.slices(spark, folder)
    gray = readers.voxels(slices).groupBy("z").agg(F.sum("gray").alias("total"), F.max("gray").alias("most"), F.count("*").alias("n"))
    return gray.withColumn("z", (F.lit(D - 1) - F.col("z")).cast("int"))


# Predicates and edits.

_COUNTED = "select z, label, count(*) as n from v group by z, label"


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("z", "label").agg(F.count("*").alias("n"))


S = f"with {fx.SCATTER_SQL}"


@query(f"{S} select z, count(*) n from s where gray between 100 and 140 group by z")
def extract_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scatter(spark, sf_dir).where(edits.in_threshold(100, 140)).groupBy("z").agg(F.count("*").alias("n"))


@query(f"{S} select z, count(*) n from s where gray between {PRESETS['CT Bone'][0]} and {PRESETS['CT Bone'][1]} group by z")
def extract_preset_ct_bone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scatter(spark, sf_dir).where(edits.in_preset("CT Bone")).groupBy("z").agg(F.count("*").alias("n"))


@query(f"{S} " + " union all ".join(f"select '{n}' preset, count(*) n from s where gray between {lo} and {hi}" for n, (lo, hi) in PRESETS.items()))
def preset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.preset_counts(fx.scatter(spark, sf_dir))


@query(f"{S} select z, count(*) n from (select z, gray r, (gray * 3) % 256 g, 255 - gray b from s) where r between 70 and 130 and g between 20 and 80 and b between 125 and 185 group by z")
def extract_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = fx.scatter(spark, sf_dir).selectExpr("z", "gray as r", "(gray * 3) % 256 as g", "255 - gray as b")
    return colored.where(edits.near_color(100, 50, 155, 30)).groupBy("z").agg(F.count("*").alias("n"))


@query(f"{P}, w as (select z, case when label = 10 and gray between 90 and 200 then 3 else label end label from v) select z, label, count(*) n from w group by z, label")
def extract_inside_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.apply(fx.phantom(spark, sf_dir), [edits.ExtractInside(10, 3, 200, 90)]))


@query(f"{P}, w as (select z, case when label = 15 then 2 else label end label from v) select z, label, count(*) n from w group by z, label")
def convert_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.apply(fx.phantom(spark, sf_dir), [edits.Convert(15, 2)]))


@query(f"{P} select z, count(*) changed from v where label = 15 group by z")
def convert_label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.changed(fx.phantom(spark, sf_dir), [edits.Convert(15, 2)])


@query(f"{P}, w as (select z, case when label = 6 or (label = 7 and z = 4) then 0 else label end label from v) select z, label, count(*) n from w group by z, label")
def delete_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.apply(fx.phantom(spark, sf_dir), [edits.Delete(6), edits.Delete(7, z=4)]))


_CHAIN = [edits.Convert(1, 2), edits.ExtractInside(2, 3, 0, 128), edits.Convert(3, 4), edits.Delete(4, z=5), edits.Convert(20, 1)]


@query(f"""{P}, a as (select z, gray, case when label = 1 then 2 else label end label from v), b as (select z, case when label = 2 and gray between 0 and 128 then 3 else label end label from a),
c as (select z, case when label = 3 then 4 else label end label from b), d as (select z, case when label = 4 and z = 5 then 0 else label end label from c),
e as (select z, case when label = 20 then 1 else label end label from d) select z, label, count(*) n from e group by z, label""")
def edit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.apply(fx.phantom(spark, sf_dir), _CHAIN))


@query(f"{P} select label, count(*) n from v where label in (3, 9, 15) group by label")
def visible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.phantom(spark, sf_dir).where(F.col("label").isin(3, 9, 15)).groupBy("label").agg(F.count("*").alias("n"))


# Paths.

C = f"with {fx.PHANTOM_SQL}, {fx.POLYGON_SQL}"


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.rasterise(fx.polygons(spark, sf_dir), H, W)


@query(f"with {fx.POLYGON_SQL} select path_id, z, y, x, label from cover")
def rasterize_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir)


_PATHS = ", k as (select z, y, x, count(*) n from cover group by z, y, x), w as (select z, {} label from v left join k using (z, y, x)) select z, label, count(*) n from w group by z, label"


@query(C + _PATHS.format("case when n > 0 then 8 else label end"))
def add_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.add_paths(fx.phantom(spark, sf_dir), _cover(spark, sf_dir), 8))


@query(C + _PATHS.format("case when n % 2 = 1 and label = 10 then 0 else label end"))
def erase_path_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.erase_paths(fx.phantom(spark, sf_dir), _cover(spark, sf_dir), 10))


@query(C + _PATHS.format("case when n % 2 = 1 and label = 15 then 16 else label end"))
def transfer_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.transfer_paths(fx.phantom(spark, sf_dir), _cover(spark, sf_dir), 15, 16))


@query(C.replace("cover as", "cover_all as") + ", cover as (select * from cover_all where z = 7 and path_id = (select max(path_id) from cover_all where z = 7))" + _PATHS.format("case when n > 0 then 8 else label end"))
def auto_add_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = geometry.rasterise(edits.latest(fx.polygons(spark, sf_dir), 7), H, W)
    return _counted(edits.add_paths(fx.phantom(spark, sf_dir), cover, 8))


@query(f"with {fx.POLYGON_SQL} select z, y, x, arg_max(label, path_id) label from cover group by z, y, x")
def last_path_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.last_writer(_cover(spark, sf_dir), "path_id")


@query(f"with {fx.POLYGON_SQL} select path_id, abs(sum(ax * by_ - bx * ay)) / 2 area from edges group by path_id".replace("abs(sum(ax * by_ - bx * ay)) / 2", "cast(abs(sum(ax * by_ - bx * ay)) as double) / 2"))
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.polygons(spark, sf_dir).select("path_id", geometry.shoelace(F.col("pts")).alias("area"))


@query(f"{P} select z, y, x, label from v where label > 0")
def contour_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.rasterise(geometry.contours(fx.phantom(spark, sf_dir)), H, W).select("z", "y", "x", "label")


@query(f"{P}, e as (select z, label, unnest([{{'a': 0, 'y': y, 'x': x}}, {{'a': 0, 'y': y + 1, 'x': x}}, {{'a': 1, 'y': y, 'x': x}}, {{'a': 1, 'y': y, 'x': x + 1}}]) e from v where label > 0), o as (select z, label, e from e group by z, label, e having count(*) = 1) select z, label, count(*) sides from o group by z, label")
def contour_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.concat("pts", F.slice("pts", 1, 1))
    steps = F.zip_with(F.slice(closed, 1, F.size("pts")), F.slice(closed, 2, F.size("pts")), lambda a, b: F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"]))
    around = F.aggregate(steps, F.lit(0.0), lambda t, d: t + d)
    return geometry.contours(fx.phantom(spark, sf_dir)).groupBy("z", "label").agg(F.sum(around).cast("long").alias("sides"))


@query(f"with {fx.POLYGON_SQL} select path_id, cast(abs(sum(ax * by_ - bx * ay)) as double) / 2 area from edges group by path_id having abs(sum(ax * by_ - bx * ay)) >= 400")
def remove_small_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.keep_large(fx.polygons(spark, sf_dir), 200).select("path_id", geometry.shoelace(F.col("pts")).alias("area"))


@query(f"with {fx.POLYGON_SQL} select a.z, a.path_id a, b.path_id b, count(*) pixels from cover a join cover b using (z, y, x) where a.path_id < b.path_id group by 1, 2, 3")
def path_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.intersections(fx.polygons(spark, sf_dir), H, W)


@query(f"""with {fx.POLYGON_SQL}, {LABELS_SQL}, a as (select distinct label from cover where label <= 9), b as (select distinct label from cover where label between 6 and 14),
f as (select label slot, row_number() over (order by label) n from labels20 where label not in (select label from a) and label not in (select label from b)),
c as (select label, row_number() over (order by label) n from b where label in (select label from a))
select b.label, cast(case when c.label is null then b.label else coalesce(slot, 20) end as int) new_label from b left join c on c.label = b.label left join f on f.n = c.n""")
def recolor_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fx.polygons(spark, sf_dir)
    return geometry.recolored(paths.where("label <= 9"), paths.where("label between 6 and 14"))


_LATEST = C.replace("cover as", "cover_all as") + ", cover as (select * from cover_all where z = 7 and path_id = (select max(path_id) from cover_all where z = 7))"


@query(_LATEST + _PATHS.format("case when n % 2 = 1 and label = 10 then 0 else label end"))
def auto_erase_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = geometry.rasterise(edits.latest(fx.polygons(spark, sf_dir), 7), H, W)
    return _counted(edits.erase_paths(fx.phantom(spark, sf_dir), cover, 10))


@query(_LATEST + _PATHS.format("case when n % 2 = 1 and label = 15 then 16 else label end"))
def auto_transfer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = geometry.rasterise(edits.latest(fx.polygons(spark, sf_dir), 7), H, W)
    return _counted(edits.transfer_paths(fx.phantom(spark, sf_dir), cover, 15, 16))


@query("select p_partkey path_id, cast(p_partkey % 12 as int) z, cast(row_number() over (partition by p_partkey % 12 order by case when p_partkey % 20 + 1 = 5 then 1 else 0 end, p_partkey) as int) seq from part")
def bring_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.bring(fx.polygons(spark, sf_dir), 5).select("path_id", "z", "seq")


@query("select p_partkey path_id, cast(p_partkey % 12 as int) z from part qualify p_partkey < max(p_partkey) over (partition by p_partkey % 12)")
def paths_without_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.without_latest(fx.polygons(spark, sf_dir)).select("path_id", "z")


@query("select p_partkey id, cast((p_partkey % 17) * 2.0 * ((p_partkey % 11) * 0.5) as double) area from part")
def rect_areas_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pts = geometry.scale_points(geometry.rect_points(k % 7, k % 5, k % 17, k % 11), F.lit(2.0), F.lit(0.5))
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), geometry.shoelace(pts).alias("area"))


@query("select c_custkey id, cast(c_custkey % 64 as double) / 64 * 100 percent, cast(trunc(cast(c_custkey % 64 as double) / 64 * 100 / 100 * 48) as int) px from customer")
def box_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = geometry.to_percent(F.col("c_custkey") % 64, F.lit(64))
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), percent.alias("percent"), geometry.from_percent(percent, F.lit(48)).alias("px"))


@query("""with l as (select c_custkey id, cast(c_custkey % 48 as int) x1, cast(c_custkey * 7 % 48 as int) y1, cast(c_custkey * 3 % 48 as int) x2, cast(c_custkey * 5 % 48 as int) y2 from customer)
select id, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) px, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * cast(0.5 as double) mm from l""")
def line_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 48 as int) as x1", "cast(c_custkey * 7 % 48 as int) as y1", "cast(c_custkey * 3 % 48 as int) as x2", "cast(c_custkey * 5 % 48 as int) as y2")
    return geometry.measure(lines, 0.5)


@query("select n_nationkey id, case when n_nationkey % 5 > 0 then cast(10 as double) / (n_nationkey % 5) else 1.0 end mm_per_px from nation")
def calibrate_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), geometry.calibrate(F.lit(10.0), F.col("n_nationkey") % 5).alias("mm_per_px"))


@query("""with c as (select s_suppkey id, case when s_suppkey % 2 = 0 then cast(s_suppkey % 7 + 1 as double) / 4 end sx, case when s_suppkey % 6 = 0 then cast(0.25 as double) end sy, case when s_suppkey % 4 = 0 then cast(2 as double) end sz,
case when s_suppkey % 3 = 0 then cast(s_suppkey % 5 + 1 as double) / 8 end m, case when s_suppkey % 5 = 0 then cast(3 as double) end zs from supplier)
select id, coalesce(sx, m, 1) sx, coalesce(sy, m, sx, 1) sy, coalesce(sz, zs, 1) sz, cast(0 as double) ox from c""")
def spacing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id", "case when s_suppkey % 2 = 0 then (s_suppkey % 7 + 1) / 4D end as sx", "case when s_suppkey % 6 = 0 then 0.25D end as sy", "case when s_suppkey % 4 = 0 then 2D end as sz",
        "case when s_suppkey % 3 = 0 then (s_suppkey % 5 + 1) / 8D end as mm_per_px", "case when s_suppkey % 5 = 0 then 3D end as z_spacing", "cast(null as double) as ox", "cast(null as double) as oy", "cast(null as double) as oz",
    )
    return report.spacing(known).select("id", "sx", "sy", "sz", "ox")


@query(f"""{P}, p as (select c_custkey id, cast(c_custkey % 13 as int) z, cast(c_custkey * 7 % 49 as int) y, cast(c_custkey * 5 % 48 as int) x from customer)
select id, p.z, p.y, p.x, gray, label from p left join v using (z, y, x)""")
def pixel_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 13 as int) as z", "cast(c_custkey * 7 % 49 as int) as y", "cast(c_custkey * 5 % 48 as int) as x")
    return report.picked(fx.phantom(spark, sf_dir), points)


@query("""with recursive p as (select user_id id, cast(row_number() over (partition by user_id order by event_id) as int) i, cast(event_id * 7919 % 97 as bigint) y, count(*) over (partition by user_id) n from events),
seg(id, a, b) as (select id, 1, cast(n as int) from p where i = n
  union all select id, unnest([a, k]), unnest([k, b]) from (
    select s.id, s.a, s.b, arg_min(m.i, struct_pack(f := -((b.i - a.i) * (m.y - a.y) - (b.y - a.y) * (m.i - a.i)) * ((b.i - a.i) * (m.y - a.y) - (b.y - a.y) * (m.i - a.i)), i := m.i)) k,
      max(((b.i - a.i) * (m.y - a.y) - (b.y - a.y) * (m.i - a.i)) * ((b.i - a.i) * (m.y - a.y) - (b.y - a.y) * (m.i - a.i))) far, max((b.i - a.i) * (b.i - a.i) + (b.y - a.y) * (b.y - a.y)) size
    from seg s join p a on a.id = s.id and a.i = s.a join p b on b.id = s.id and b.i = s.b join p m on m.id = s.id and m.i > s.a and m.i < s.b group by s.id, s.a, s.b) where far > 900 * size)
select id, cast(i as double) x, cast(y as double) y from p where (id, i) in (select (id, a) from seg) or (id, i) in (select (id, b) from seg)""")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through each user's events, with the points that a tolerance of 30 leaves."""
    point = F.struct(F.col("event_id").alias("i"), F.expr("cast(event_id * 7919 % 97 as double)").alias("y"))
    lines = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("pts"))
    pts = F.transform("pts", lambda p, i: F.struct((i + 1).cast("double").alias("x"), p["y"].alias("y")))
    return lines.select("id", F.explode(geometry.simplify(pts, 30)).alias("p")).select("id", "p.x", "p.y")


# Slices in order.

_NAMES = "select n_nationkey id, concat('Image', cast(n_nationkey * 37 % 101 as {}), '.jpg') name from nation"


@query("with f as (" + _NAMES.format("varchar") + ") select id, name, cast(row_number() over (order by cast(regexp_extract(name, '[0-9]+') as int), name) - 1 as int) z, lpad(cast(row_number() over (order by cast(regexp_extract(name, '[0-9]+') as int), name) as varchar), 4, '0') key from f")
def natural_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Image"), (F.col("n_nationkey") * 37 % 101).cast("string"), F.lit(".jpg")).alias("name"))
    return stack.ordered(names)


@query("select n_nationkey id, case when n_nationkey % 3 = 0 then lpad(cast(row_number() over (order by concat(case when n_nationkey % 3 = 0 then 'mask' else 'm' || n_nationkey || '_' end, translate(n_name, '0123456789', 'abcdefghij'))) as varchar), 4, '0') else lpad(cast(n_nationkey as varchar), 4, '0') end key from nation")
def mask_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    names = fx.table(spark, sf_dir, "nation").select(k.alias("id"), F.concat(F.when(k % 3 == 0, "mask").otherwise(F.concat(F.lit("m"), k.cast("string"), F.lit("_"))), F.translate("n_name", "0123456789", "abcdefghij")).alias("name"))
    return stack.mask_keys(names).select("id", "key")


@query("select n_nationkey id, right('scan_' || lpad(cast(n_nationkey * 37 as varchar), 6, '0'), 4) key from nation")
def stem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    names = fx.table(spark, sf_dir, "nation").select(k.alias("id"), F.concat(F.lit("scan_"), F.lpad((k * 37).cast("string"), 6, "0"), F.lit(".png")).alias("name"))
    return names.select("id", stack.stem_key(F.col("name")).alias("key"))


@query("select n_nationkey id, concat_ws('-', cast(n_nationkey * 37 as varchar), cast(n_nationkey as varchar)) numbers from nation")
def number_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.lit("scan"), F.lpad((k * 37).cast("string"), 6, "0"), F.lit("_slice"), k.cast("string"), F.lit(".png"))
    return fx.table(spark, sf_dir, "nation").select(k.alias("id"), F.array_join(F.transform(stack.number_tuple(name), lambda n: n.cast("string")), "-").alias("numbers"))


@query("select min(n_nationkey * 37 + 12) starting_index from nation where n_nationkey % 2 = 0".replace("min(n_nationkey * 37 + 12)", "cast(min(n_nationkey * 37 + 12) as int)"))
def web_starting_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    number = F.when(k % 2 == 0, F.lpad((k * 37 + 12).cast("string"), 4, "0")).otherwise("none")
    return readers.web_index(fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("img"), number, F.lit(".jpg")).alias("name")))


@query(f"{S} select z, cast(row_number() over (order by z desc) as int) export_index from (select distinct z from s)")
def export_index_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.renumbered(report.slice_table(fx.scatter(spark, sf_dir)), descending=True).select("z", "export_index")


@query(f"{P}, w as (select z, case when x >= 8 and x < 30 and y >= 6 and y < 20 then 7 else label end label from v) select z, label, count(*) n from w group by z, label")
def set_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(edits.set_where(fx.phantom(spark, sf_dir), edits.in_box(8, 6, 30, 20), 7))


@query(f"{P}, t as (select distinct z from v), k as (select z, row_number() over (order by z) - 1 i from t) select k.i // 3 new_z, label, count(*) n from v join k using (z) where k.i % 3 = 0 group by 1, 2".replace("k.i // 3 new_z", "cast(k.i // 3 as int) new_z"))
def thin_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.phantom(spark, sf_dir)
    kept = stack.thin(report.slice_table(v), 3)
    return v.join(kept, "z").groupBy("new_z", "label").agg(F.count("*").alias("n"))


@query(f"{P} select {D - 1} - z z, {H - 1} - y y, x, label from v where label > 0")
def reverse_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.reverse(fx.phantom(spark, sf_dir).where("label > 0"), D, H).select("z", "y", "x", "label")


@query("""with s as (select event_id idx, cast(event_id * 7919 % 4001 as double) / 4 + case when event_id % 10 = 0 then 0.0000001 else 0 end position from events),
d as (select abs(position - lag(position) over (order by position)) d from s), k as (select list_sort(list(d)) l from d where d > 0.000001) select l[len(l) // 2 + 1] spacing from k""")
def z_spacing_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "events").selectExpr("event_id as idx", "cast(null as double) as spacing_between", "cast(null as double) as thickness", "cast(event_id * 7919 % 4001 as double) / 4 + case when event_id % 10 = 0 then 0.0000001D else 0D end as position")
    return stack.z_spacing(s)


@query(f"{S} select a.z, a.y, a.x, cast(case when b.gray is null then a.gray else floor(a.gray * 0.5 + b.gray * 0.5) end as int) mixed from s a left join s b on b.z = a.z - 1 and b.y = a.y and b.x = a.x")
def neighbor_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.neighbor_overlay(fx.scatter(spark, sf_dir))


@query(f"with {fx.SCATTER_SQL} select z, y, x, cast(floor(cast(cast(cast(gray - min(gray) over (partition by z) as float) as double) / cast(cast(max(gray) over (partition by z) - min(gray) over (partition by z) as float) + cast(1e-8 as float) as double) as float) * cast(255 as float)) as int) norm from s")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.normalise(fx.scatter(spark, sf_dir))


@query(f"{P}, {PALETTE_SQL} select z, y, x, coalesce(pal.gray, 0) as level from v left join pal using (label)")
def grayscale_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.gray_levels(fx.phantom(spark, sf_dir), palette(spark))


_OVER = "case when pal.label is null then v.gray else cast(floor(least(greatest((1 - {a}) * cast(v.gray as double) + {a} * pal.{c}, 0.0), 255.0)) as int) end as {c}"


@query(f"{P}, {PALETTE_SQL} select z, y, x, " + ", ".join(_OVER.format(a="(cast(77 as double) / 255)", c=c) for c in "rgb") + " from v left join pal on pal.label = v.label and pal.label in (3, 9, 10, 15)")
def overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.overlay(fx.phantom(spark, sf_dir), palette(spark), OVERLAY_ALPHA, [3, 9, 10, 15])


@query(f"{P}, {PALETTE_SQL} select z, y, x, coalesce(pal.r, 0) r, coalesce(pal.g, 0) g, coalesce(pal.b, 0) b from v left join pal using (label)")
def preview_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.previews(fx.phantom(spark, sf_dir), palette(spark))


# Neighbourhoods and coordinates.

_COMPONENTS = """pix as (select z, label, y, x, y * 1048576 + x as code from v where label > 0),
comp(z, label, y, x, comp) using key (z, label, y, x) as (
  select z, label, y, x, cast(code as bigint) from pix
  union
  select q.z, q.label, q.y, q.x, min(c.comp) from comp c join pix q on q.z = c.z and q.label = c.label and abs(q.y - c.y) <= 1 and abs(q.x - c.x) <= 1
  join recurring.comp o on o.z = q.z and o.label = q.label and o.y = q.y and o.x = q.x where c.comp < o.comp group by q.z, q.label, q.y, q.x)"""
R = "with recursive " + fx.PHANTOM_SQL + ", " + _COMPONENTS


@query(f"{R} select z, label, comp, count(*) area from comp group by z, label, comp")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.component_sizes(fx.phantom(spark, sf_dir))


@query(f"""{R}, gone as (select z, comp from comp where label = 10 group by z, comp having count(*) < 12), w as (select v.z, case when v.label = 10 and g.z is not null then 0 else v.label end label
from v left join comp c on c.z = v.z and c.y = v.y and c.x = v.x and c.label = v.label left join gone g on g.z = c.z and g.comp = c.comp and c.label = 10) select z, label, count(*) n from w group by z, label""")
def remove_small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(raster.remove_small_parts(fx.phantom(spark, sf_dir), 10, 12))


@query(f"""{P} select distinct label, z, cast(y + dy as int) y, cast(x + dx as int) x from v, range(-2, 3) a(dy), range(-2, 3) b(dx) where label > 0 and y + dy between 0 and {H - 1} and x + dx between 0 and {W - 1}""")
def dilate_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(fx.phantom(spark, sf_dir), 2, H, W)


@query("select cast(max(40 + p_size * 3) as int) height, cast(max(60 + p_partkey % 97 - p_size) as int) width from part")
def max_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.max_canvas(fx.table(spark, sf_dir, "part").selectExpr("p_partkey as z", "40 + p_size * 3 as height", "cast(60 + p_partkey % 97 - p_size as int) as width"))


@query(f"{P}, s as (select z, {H} - z h, {W} - 2 * z w from (select distinct z from v)) select v.z, v.y + z // 2 y, v.x + (2 * z) // 2 x, label from v where label > 0 and y < {H} - z and x < {W} - 2 * z")
def pad_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.phantom(spark, sf_dir)
    sizes = report.slice_table(v).selectExpr("z", f"{H} - z as height", f"{W} - 2 * z as width")
    return raster.pad_to(v.where(f"label > 0 and y < {H} - z and x < {W} - 2 * z"), sizes).select("z", "y", "x", "label")


@query(f"{P} select z, y + 100 y, x + 100 x, label from v where label > 0")
def expand_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.expand(fx.phantom(spark, sf_dir).where("label > 0")).select("z", "y", "x", "label")


@query(f"{P} select z, y - 5 y, x x, label from v where y >= 5 and y < 40 and x >= 0 and x < 30")
def crop_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.crop(fx.phantom(spark, sf_dir), 30, 5, -4, 40, H, W).select("z", "y", "x", "label")


@query(f"{P} select z, {H - 1} - x y, {H - 1} - y x, label from v where label > 0")
def flip_rot90(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = raster.rot90(fx.phantom(spark, sf_dir).where("label > 0"), H, W)
    return raster.flip(turned, W, H, up_down=True).select("z", "y", "x", "label")


@query(f"{P} select y z, {D - 1} - z x, {W - 1} - ({W - 1} - x) y, label from v where label > 0".replace(f"{W - 1} - ({W - 1} - x) y", f"{W - 1} - x y"))
def orient_coronal(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = fx.phantom(spark, sf_dir).where("label > 0").select(F.col("z").alias("i"), F.col("y").alias("j"), F.col("x").alias("k"), "label")
    return raster.orient(volume, "coronal", (D, H, W)).select("z", "y", "x", "label")


@query(f"{P} select z, cast(ny as int) y, cast(nx as int) x, label from v, range(0, 31) a(ny), range(0, 70) b(nx) where v.y = ny * {H} // 31 and v.x = nx * {W} // 70 and label > 0")
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resize_nearest(fx.phantom(spark, sf_dir).where("label > 0"), H, W, 31, 70).select("z", "y", "x", "label")


@query(f"""{P}, t(z, dx, dy, a) as (select z, case when z between 5 and 8 then 3 when z <= 6 then -2 else 0 end, case when z between 5 and 8 then -4 when z <= 6 then 5 else 0 end, case when z between 5 and 8 then 0 when z <= 6 then 180 else 0 end from (select distinct z from v)),
aim as (select z, cast(i // {W} as int) y, cast(i % {W} as int) x, dx, dy, a from t, range(0, {H * W}) g(i)),
src as (select z, y, x, case when a = 180 then {H - 1} - (y - dy) else y - dy end sy, case when a = 180 then {W - 1} - (x - dx) else x - dx end sx from aim)
select src.z, src.y, src.x, coalesce(gray, 0) gray, coalesce(label, 0) label from src left join v on v.z = src.z and v.y = sy and v.x = sx""")
def rigid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = spark.createDataFrame([(1, 6, 0, -2, 5, 180.0), (2, 5, 8, 3, -4, 0.0)], "seq int, z_start int, z_end int, dx int, dy int, angle_deg double")
    return raster.rigid(fx.phantom(spark, sf_dir), moves, H, W)


@query(f"""{P}, e as (select a.z, a.y, a.x from v a left join v r on r.z = a.z and r.y = a.y and r.x = a.x + 1 left join v b on b.z = a.z and b.y = a.y + 1 and b.x = a.x where abs(a.gray - r.gray) >= 100 or abs(a.gray - b.gray) >= 100),
p as (select c_custkey id, cast(c_custkey % 12 as int) z, cast(c_custkey * 7 % 48 as int) y, cast(c_custkey * 5 % 48 as int) x from customer),
h as (select p.id, e.y ey, e.x ex, row_number() over (partition by p.id order by (e.y - p.y) * (e.y - p.y) + (e.x - p.x) * (e.x - p.x), e.y, e.x) n from p join e on e.z = p.z and e.y >= p.y - 7 and e.y < p.y + 7 and e.x >= p.x - 7 and e.x < p.x + 7)
select p.id, p.z, p.y, p.x, coalesce(ey, p.y) sy, coalesce(ex, p.x) sx from p left join h on h.id = p.id and n = 1""")
def snap_nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 12 as int) as z", "cast(c_custkey * 7 % 48 as int) as y", "cast(c_custkey * 5 % 48 as int) as x")
    return raster.snap(points, raster.gradient_edges(fx.phantom(spark, sf_dir), 100))


# Edges and turned slices.


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phantom with its labels for grey levels, so that objects have borders to find."""
    return fx.phantom(spark, sf_dir).withColumn("gray", F.col("label") * 12)


_AROUND = {"l": (0, -1), "r": (0, 1), "u": (-1, 0), "d": (1, 0), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}
_CANNY = f"""with recursive {fx.PHANTOM_SQL}, i as (select z, y, x, label * 12 g from v),
h as (select z, y, x, coalesce(lead(g) over a, g) - coalesce(lag(g) over a, g) st, coalesce(lag(g) over a, g) + 2 * g + coalesce(lead(g) over a, g) me from i window a as (partition by z, y order by x)),
gr as (select z, y, x, coalesce(lag(st) over b, st) + 2 * st + coalesce(lead(st) over b, st) gx, coalesce(lead(me) over b, me) - coalesce(lag(me) over b, me) gy from h window b as (partition by z, x order by y)),
mg as (select *, abs(gx) + abs(gy) m, abs(gx) ax, cast(abs(gy) as bigint) * 32768 ay from gr),
nb as (select c.*, {", ".join(f"coalesce({k}.m, 0) m_{k}" for k in _AROUND)} from mg c {" ".join(f"left join mg {k} on {k}.z = c.z and {k}.y = c.y + {dy} and {k}.x = c.x + {dx}" for k, (dy, dx) in _AROUND.items())}),
pix as (select z, y, x, m from nb where m > 50 and case when ay < ax * 13573 then m > m_l and m >= m_r when ay > ax * 13573 + ax * 65536 then m > m_u and m >= m_d
  when (gx < 0) <> (gy < 0) then m > m_ur and m > m_dl else m > m_ul and m > m_dr end),
comp(z, y, x, comp) using key (z, y, x) as (
  select z, y, x, cast(y * 1048576 + x as bigint) from pix
  union
  select q.z, q.y, q.x, min(c.comp) from comp c join pix q on q.z = c.z and abs(q.y - c.y) <= 1 and abs(q.x - c.x) <= 1
  join recurring.comp o on o.z = q.z and o.y = q.y and o.x = q.x where c.comp < o.comp group by q.z, q.y, q.x),
e as (select z, y, x from comp where (z, comp) in (select (c.z, c.comp) from comp c join pix p on p.z = c.z and p.y = c.y and p.x = c.x where p.m > 150))"""


@query(f"{_CANNY} select z, y, x from e")
def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.canny(_image(spark, sf_dir))


@query(f"""{_CANNY}, p as (select c_custkey id, cast(c_custkey % 12 as int) z, cast(c_custkey * 7 % 48 as int) y, cast(c_custkey * 5 % 48 as int) x from customer),
near as (select p.id, e.y ey, e.x ex, row_number() over (partition by p.id order by (e.y - p.y) * (e.y - p.y) + (e.x - p.x) * (e.x - p.x), e.y, e.x) n from p join e on e.z = p.z and e.y >= p.y - 7 and e.y < p.y + 7 and e.x >= p.x - 7 and e.x < p.x + 7)
select p.id, p.z, p.y, p.x, coalesce(ey, p.y) sy, coalesce(ex, p.x) sx from p left join near on near.id = p.id and n = 1""")
def snap_canny_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 12 as int) as z", "cast(c_custkey * 7 % 48 as int) as y", "cast(c_custkey * 5 % 48 as int) as x")
    return raster.snap(points, edges.canny(_image(spark, sf_dir)))


_TURNS = "select n_nationkey as seq, cast(n_nationkey % 9 as int) as z_start, cast(n_nationkey % 9 as int) + 1 as z_end, cast(n_nationkey % 5 as int) - 2 as dx, cast(n_nationkey % 7 as int) - 3 as dy, cast(n_nationkey * 18 - 90 as double) as angle_deg from nation"
_UP = "cast(({v} + 65535) // 65536 + ((({v} + 65535) // 65536) - {n}) % 2 as int)"
_WEIGHTS = "case {k} when 0 then -{f} * 65536 + 512 * {f} * {f} - {f} * {f} * {f} when 1 then 16777216 - 512 * {f} * {f} + {f} * {f} * {f} when 2 then {f} * 65536 + 256 * {f} * {f} - {f} * {f} * {f} else -256 * {f} * {f} + {f} * {f} * {f} end"


def _turned_sql(grown: bool) -> str:
    """``turned`` (z, y, x, gray, label), on the canvas of the largest turned box or on the image's own."""
    rows, cols = (_UP.format(v=f"max(abs(t.{a}) * {H} + abs(t.{b}) * {W})", n=n) for a, b, n in (("c", "s", H), ("s", "c", W)))
    canvas = f"select greatest({H}, {rows}) r, greatest({W}, {cols}) c from t" if grown else f"select {H} r, {W} c"
    return f"""moves as ({_TURNS}), t as (select z, unnest(arg_max(struct_pack(dx := dx, dy := dy, c := cast(round(cos(radians(angle_deg)) * 65536) as bigint), s := cast(round(sin(radians(angle_deg)) * 65536) as bigint)), seq)) from moves, range(0, {D}) r(z) where r.z between z_start and z_end group by z),
canvas as ({canvas}),
aim as (select z.z, cast(gy as int) y, cast(gx as int) x, 2 * (gx - coalesce(dx, 0)) + 1 - canvas.c u, 2 * (gy - coalesce(dy, 0)) + 1 - canvas.r v, coalesce(t.c, 65536) c, coalesce(t.s, 0) s from (select distinct z from v) z left join t on t.z = z.z, canvas, range(0, 200) a(gy), range(0, 200) b(gx) where gy < canvas.r and gx < canvas.c),
src as (select z, y, x, c * u + s * v + {W * 65536} sx, c * v - s * u + {H * 65536} sy from aim),
fit as (select z, y, x, sx, sy, (sx - 65536 + 131072) // 131072 - 1 bx, (sy - 65536 + 131072) // 131072 - 1 by_ from src where sx >= 0 and sx < {W * 131072} and sy >= 0 and sy < {H * 131072}),
part as (select z, y, x, bx, by_, (sx - 65536 - bx * 131072) // 512 fx, (sy - 65536 - by_ * 131072) // 512 fy from fit),
mix as (select p.z, p.y, p.x, sum(cast(v.gray as hugeint) * ({_WEIGHTS.format(k="i", f="fy")}) * ({_WEIGHTS.format(k="j", f="fx")})) total from part p, range(0, 4) a(i), range(0, 4) b(j), v where v.z = p.z and v.y = least(greatest(by_ + i - 1, 0), {H - 1}) and v.x = least(greatest(bx + j - 1, 0), {W - 1}) group by p.z, p.y, p.x),
turned as (select src.z, src.y, src.x, cast(case when m.total is null then 255 when m.total <= 0 then 0 else least(m.total // 281474976710656, 255) end as int) gray, coalesce(v.label, 0) label
  from src left join mix m on m.z = src.z and m.y = src.y and m.x = src.x left join fit f on f.z = src.z and f.y = src.y and f.x = src.x left join v on v.z = f.z and v.y = f.sy // 131072 and v.x = f.sx // 131072)"""


@query(f"{P}, {_turned_sql(True)} select z, y, x, gray, label from turned")
def rotate_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.rotate(fx.phantom(spark, sf_dir), _turns(spark, sf_dir), H, W)


@query(f"""{P}, {_turned_sql(False)}, s as (select 0 as version, z, gray, label from v union all select 1, z, gray, label from turned where z in (select z from t) union all select 1, z, gray, label from v where z not in (select z from t))
select version, z, sum(gray) gray, sum(label) label from s group by version, z""".replace("sum(gray) gray, sum(label) label", "cast(sum(gray) as bigint) gray, cast(sum(label) as bigint) label"))
def rotate_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fx.phantom(spark, sf_dir).withColumn("version", F.lit(0)).select("version", "z", "y", "x", "gray", "label")
    versions = resample.applied(first, _turns(spark, sf_dir), H, W, 1)
    states = [resample.current(versions, n).groupBy("z").agg(F.sum("gray").alias("gray"), F.sum("label").alias("label")).select(F.lit(n).alias("version"), "z", "gray", "label") for n in (0, 1)]
    return states[0].unionByName(states[1])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move for each nation, at angles from -90 to 342 degrees; of several on a slice the last holds."""
    k = F.col("n_nationkey")
    cols = [k.alias("seq"), (k % 9).cast("int").alias("z_start"), ((k % 9) + 1).cast("int").alias("z_end"), ((k % 5) - 2).cast("int").alias("dx"), ((k % 7) - 3).cast("int").alias("dy"), (k * 18 - 90).cast("double").alias("angle_deg")]
    return fx.table(spark, sf_dir, "nation").select(*cols)


# Regions, history, tracking, stream and meshes.

_CATALOG_SQL = "cat as (select p_brand as task, p_name as roi from part)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by task: a part's name by its brand; each pair many times."""
    return fx.table(spark, sf_dir, "part").selectExpr("p_brand as task", "p_name as roi")


@query(f"{P}, k as (select label, row_number() over (order by label desc) place from (select distinct label from m)) select z, y, x, cast(max(place) as int) label from m join k using (label) where place <= 15 group by z, y, x")
def merge_roi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _rois(spark, sf_dir)
    number = F.regexp_extract("roi", "[0-9]+", 0).cast("int")
    picked = members.select("roi").distinct()
    return roi.merge_labels(members, picked.select("roi", F.row_number().over(Window.orderBy(number.desc())).alias("place")), 15)


@query(f"with {_CATALOG_SQL} select distinct roi, task from cat")
def roi_task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.task_index(_catalog(spark, sf_dir))


@query(f"with {_CATALOG_SQL} select count(distinct task) tasks, count(*) as rows, count(distinct roi) rois from cat")
def roi_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.counts(_catalog(spark, sf_dir))


_TYPED = "concat(' ', p_name, ', ', p_type, chr(10), p_name, ',,', p_brand)"


@query(f"""with {_CATALOG_SQL}, t as (select p_partkey as id, string_split_regex({_TYPED}, '[,\\s]+') as w from part),
w as (select id, unnest(w) as roi, generate_subscripts(w, 1) - 1 as place from t), f as (select id, roi, cast(min(place) as int) place from w where roi <> '' group by id, roi),
words as (select distinct unnest(string_split(roi, ' ')) as roi from cat) select id, place, roi from f where roi not in (select roi from words)""")
def roi_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _catalog(spark, sf_dir).select(F.explode(F.split("roi", " ")).alias("roi")).distinct()
    typed = fx.table(spark, sf_dir, "part").selectExpr("p_partkey as id", _TYPED + " as typed")
    return roi.invalid(roi.requests(typed), words).select("id", "place", "roi")


_LOG = "l as (select user_id as session, event_id seq, case when event_id % 5 = 3 then 'undo' when event_id % 7 = 4 then 'redo' else 'edit' end as action, event_id % 12 z, cast(event_id % 20 + 1 as int) as label from events)"
_FOLD = "list_reduce(list(struct_pack(seq := seq, action := action, done := []::bigint[], undone := []::bigint[]) order by seq), lambda a, e: case {} else a end, struct_pack(seq := cast(-1 as bigint), action := '', done := []::bigint[], undone := []::bigint[]))".format(
    "when e.action = 'edit' then struct_pack(seq := e.seq, action := e.action, done := list_append(a.done, e.seq), undone := []::bigint[]) "
    "when e.action = 'undo' and len(a.done) > 0 then struct_pack(seq := e.seq, action := e.action, done := a.done[:-2], undone := list_append(a.undone, a.done[-1])) "
    "when e.action = 'redo' and len(a.undone) > 0 then struct_pack(seq := e.seq, action := e.action, done := list_append(a.done, a.undone[-1]), undone := a.undone[:-2])"
)


_DONE = f"{_LOG}, d as (select session, unnest(({_FOLD}).done) seq from l group by session)"


@query(f"with {_DONE} select session, seq, action, z, label from l join d using (session, seq)")
def undo_redo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.active(_log(spark, sf_dir), "session")


@query(f"""{P}, {_DONE}, w as (select z, arg_max(label, seq) label from l join d using (session, seq) group by z)
select v.z, coalesce(case when v.label > 0 then w.label end, v.label) label, count(*) n from v left join w on w.z = v.z group by 1, 2""")
def undo_redo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history.active(_log(spark, sf_dir), "session")
    return _counted(history.restored(fx.phantom(spark, sf_dir), log))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id as seq", "case when event_id % 5 = 3 then 'undo' when event_id % 7 = 4 then 'redo' else 'edit' end as action", "event_id % 12 as z", "cast(event_id % 20 + 1 as int) as label")


_ACTS = """case event_type when 'signup' then case when event_id % 3 = 0 then 'clear_all' else 'edit_all' end when 'error' then case when event_id % 4 = 0 then 'redo' else 'undo' end
  when 'view' then case when event_id % 2 = 0 then 'draw' else 'undo' end when 'purchase' then case when event_id % 5 = 0 then 'clear' else 'redo_line' end else 'edit' end"""


@query()
def layered_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's events leave on twelve slices, read as edits of one slice or of all, lines, undo and redo."""
    log = fx.table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id as seq", f"{_ACTS} as action", "cast(event_id * 7 % 12 as int) as z")
    return layers.left(log)


@query("select event_id version, event_id % 12 as key, value from events where event_id <= 500 qualify row_number() over (partition by event_id % 12 order by event_id desc) = 1")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fx.table(spark, sf_dir, "events").selectExpr("event_id as version", "event_id % 12 as key", "value")
    return history.as_of(snapshots, 500)


_PROMPTS = "select s_suppkey obj_id, cast(s_suppkey * 3 % 40 as int) x0, cast(s_suppkey * 5 % 40 as int) y0, cast(s_suppkey * 3 % 40 as int) + 6 x1, cast(s_suppkey * 5 % 40 as int) + 5 y1, cast(s_suppkey % 3 as int) z_start, cast(s_suppkey % 3 as int) + 6 z_end, cast(s_suppkey % 3 as int) + 2 z_box from supplier"


@query(f"""{P}, q as ({_PROMPTS}), t as (select z, y, x, max(obj_id) o from v join q on v.z between z_start and z_end and v.y >= y0 and v.y < y1 and v.x >= x0 and v.x < x1 group by z, y, x),
w as (select v.z, cast(coalesce((o - 1) % 20 + 1, label) as int) label from v left join t using (z, y, x)) select z, label, count(*) n from w group by z, label""")
def track_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _prompts(spark, sf_dir)
    masks = tracking.merge_directions(tracking.track(prompts, packed=True))
    order = prompts.selectExpr("obj_id", "obj_id as seq", "cast((obj_id - 1) % 20 + 1 as int) as label")
    return _counted(tracking.write_labels(fx.phantom(spark, sf_dir), masks, order))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as obj_id", "cast(s_suppkey * 3 % 40 as int) as x0", "cast(s_suppkey * 5 % 40 as int) as y0", "cast(s_suppkey * 3 % 40 as int) + 6 as x1", "cast(s_suppkey * 5 % 40 as int) + 5 as y1",
        "cast(s_suppkey % 3 as int) as z_start", "cast(s_suppkey % 3 as int) + 6 as z_end", "cast(s_suppkey % 3 as int) + 2 as z_box",
    )


_FLOOD = f"""with recursive {fx.PHANTOM_SQL}, q as ({_PROMPTS}), pix as (select z, y, x from v where label between 1 and 10),
comp(z, y, x, comp) using key (z, y, x) as (
  select z, y, x, cast(y * 1048576 + x as bigint) from pix
  union
  select p.z, p.y, p.x, min(c.comp) from comp c join pix p on p.z = c.z and abs(p.y - c.y) <= 1 and abs(p.x - c.x) <= 1
  join recurring.comp o on o.z = p.z and o.y = p.y and o.x = p.x where c.comp < o.comp group by p.z, p.y, p.x),
touch as (select distinct a.z, a.comp, b.z z2, b.comp comp2 from comp a join comp b on b.y = a.y and b.x = a.x and abs(b.z - a.z) = 1),
ways as (select obj_id, unnest([1, -1]) dir, unnest([z_end, z_start]) z_to, z_box, x0, y0, x1, y1 from q),
track(obj_id, dir, z_to, z, comp) as (
  select distinct obj_id, dir, z_to, c.z, c.comp from ways join comp c on c.z = z_box and c.y >= y0 and c.y < y1 and c.x >= x0 and c.x < x1
  union
  select t.obj_id, t.dir, t.z_to, n.z2, n.comp2 from track t join touch n on n.z = t.z and n.comp = t.comp and n.z2 = t.z + t.dir where (t.z_to - n.z2) * t.dir >= 0)"""


@query(f"{_FLOOD} select obj_id, case dir when 1 then 'forward' else 'backward' end direction, c.z, c.y, c.x from track t join comp c on c.z = t.z and c.comp = t.comp")
def track_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = tracking.frames_of(_image(spark, sf_dir), H, W)
    return tracking.propagate(_prompts(spark, sf_dir), frames, tracking.gray_flood(12, 120), span=4)


_EDITS = "select event_id seq, case when event_id % 3 > 0 then cast(event_id % 12 as int) end z, case when event_id % 4 = 3 then 'delete' else 'convert' end kind, cast(event_id * 7 % 20 + 1 as int) src, cast(event_id * 11 % 20 + 1 as int) dst from events"


@query(f"""{P}, e as ({_EDITS}), zs as (select distinct z from v), own as (select zs.z, list(struct_pack(s := src, d := case when kind = 'delete' then 0 else dst end) order by seq) es from zs join e on e.z is null or e.z = zs.z group by zs.z),
mm as (select z, l as label, list_reduce(list_prepend(struct_pack(s := -1, d := cast(l as int)), es), lambda a, e: case when a.d = e.s then struct_pack(s := -1, d := e.d) else a end).d as dst from own, range(0, 21) t(l)),
w as (select v.z, coalesce(mm.dst, v.label) label from v left join mm on mm.z = v.z and mm.label = v.label) select z, label, count(*) n from w group by z, label""")
def edit_log_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "case when event_id % 3 > 0 then cast(event_id % 12 as int) end as z", "case when event_id % 4 = 3 then 'delete' else 'convert' end as kind",
        "cast(event_id * 7 % 20 + 1 as int) as src", "cast(event_id * 11 % 20 + 1 as int) as dst",
    )
    return _counted(editlog.apply_batch(fx.phantom(spark, sf_dir), log))


#: A cube's corners as bits (4 z + 2 y + x), and the six tetrahedra around its diagonal as sets of them: one triangle for one or three corners inside, two for two.
_TETS = [1 | 1 << (4 >> a) | 1 << ((4 >> a) | (4 >> b)) | 1 << 7 for a in range(3) for b in range(3) if a != b]


@query(f"""{P}, corner as (select label, z - dz cz, y - dy cy, x - dx cx, 1 << cast(4 * dz + 2 * dy + dx as int) as bit from v, range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) c(dx) where label > 0),
cube as (select label, cz, cy, cx, cast(sum(bit) as int) as m from corner group by all)
select label, cast(sum({" + ".join(f"[0, 1, 2, 1, 0][bit_count(m & {t}) + 1]" for t in _TETS)}) as bigint) as triangles from cube group by label""")
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangles(fx.phantom(spark, sf_dir), SZ, 0.5, 0.5, slab=6).groupBy("label").agg(F.count("*").alias("triangles"))


@query()
def mesh_triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_size(mesh.triangles(fx.phantom(spark, sf_dir), SZ, 0.5, 0.5, slab=6))


_VID = "cast((((({0} + 1) * 1048576 + {1} + 1) * 1048576) + {2} + 1) * 4 + {3} as bigint)"
_EDGE_SQL = "[" + ", ".join(f"[{c[0]}, {c[1]}, {c[2]}, {axis}]" for axis, c in cubes.EDGES) + "]"
_NAMED = ", ".join("cast((((cz + e.{0}[1] + 1) * 1048576 + cy + e.{0}[2] + 1) * 1048576 + cx + e.{0}[3] + 1) * 4 + e.{0}[4] as bigint) {0}".format(p) for p in "abc")


def _mesh_sql(source: str) -> str:
    """``face`` (label, a, b, c), ``side`` (label, a, b) and ``point`` (label, v, z, y, x) of the labelled voxels of a table."""
    return f"""corner as (select label, cast(z - dz as bigint) cz, cast(y - dy as bigint) cy, cast(x - dx as bigint) cx, 1 << cast(4 * dz + 2 * dy + dx as int) as bit from {source}, range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) c(dx) where label > 0),
cube as (select label, cz, cy, cx, cast(sum(bit) as int) as code from corner group by all),
cas(code, a, b, c) as (values {", ".join(f"({code}, {a}, {b}, {c})" for code, _, a, b, c in cubes.cases())}),
face as materialized (select label, row_number() over () as i, {_NAMED} from (select label, cz, cy, cx, struct_pack(a := el[a + 1], b := el[b + 1], c := el[c + 1]) e from cube join cas using (code), (select {_EDGE_SQL} as el) l)),
side as (select distinct label, unnest([a, a, b, b, c, c]) a, unnest([b, c, a, c, a, b]) b from face),
cut as (select label, unnest([{{'t': 0, 'z': z, 'y': y, 'x': x}}, {{'t': 0, 'z': z - 1, 'y': y, 'x': x}}, {{'t': 1, 'z': z, 'y': y, 'x': x}}, {{'t': 1, 'z': z, 'y': y - 1, 'x': x}}, {{'t': 2, 'z': z, 'y': y, 'x': x}}, {{'t': 2, 'z': z, 'y': y, 'x': x - 1}}]) e from {source} where label > 0),
point as materialized (select label, {_VID.format("cast(e.z as bigint)", "e.y", "e.x", "e.t")} v, cast(e.z as bigint) * 1048576 + case when e.t = 0 then 524288 else 0 end z, cast(e.y as bigint) * 1048576 + case when e.t = 1 then 524288 else 0 end y, cast(e.x as bigint) * 1048576 + case when e.t = 2 then 524288 else 0 end x
  from (select label, e from cut group by label, e having count(*) = 1))"""


_M = f"{P}, {_mesh_sql('v')}"


@query(f"{_M} select label, v, z, y, x from point")
def mesh_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.vertices(cubes.faces(fx.phantom(spark, sf_dir)))


@query(f"{_M} select label, a, b, c from face")
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.faces(fx.phantom(spark, sf_dir)).select("label", "a", "b", "c")


@query(f"""{_M}, n as (select label, count(*) faces from face group by label), s as (select label, count(*) // 2 sides from side group by label), p as (select label, count(*) vertices from point group by label)
select label, vertices, cast(sides as bigint) sides, faces, cast(vertices - sides + faces as bigint) euler from n join s using (label) join p using (label)""")
def mesh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.counts(cubes.faces(fx.phantom(spark, sf_dir)))


def _size_sql(sz: float, sy: float, sx: float, points: str) -> str:
    """Areas and volumes of ``face`` over a table of points, rounded to whole cubic micrometres, so that the order of addition doesn't show."""
    placed = ", ".join(f"max({c} / cast(1048576 as double) * {s}) filter (k = {i}) {p}_{c}" for i, p in enumerate("abc") for c, s in (("x", sx), ("y", sy), ("z", sz)))
    u, w = [[f"({p}_{c} - a_{c})" for c in "xyz"] for p in "bc"]
    n = [f"({u[1]} * {w[2]} - {u[2]} * {w[1]})", f"({u[2]} * {w[0]} - {u[0]} * {w[2]})", f"({u[0]} * {w[1]} - {u[1]} * {w[0]})"]
    return f"""select label, count(*) triangles, round(sum(sqrt({" + ".join(f"{x} * {x}" for x in n)}) / 2), 3) mm2, round(sum((a_x * {n[0]} + a_y * {n[1]} + a_z * {n[2]}) / 6), 3) mm3
from (select f.label, f.i, {placed} from (select label, i, unnest([a, b, c]) v, unnest([0, 1, 2]) k from face) f join {points} p on p.label = f.label and p.v = f.v group by f.label, f.i) group by label"""


def _rounded(size: DataFrame) -> DataFrame:
    return size.select("label", "triangles", F.round("mm2", 3).alias("mm2"), F.round("mm3", 3).alias("mm3"))


@query(f"{P}, shown as (select * from v where label in (3, 9, 15)), {_mesh_sql('shown')} {_size_sql(SZ, 0.5, 0.5, 'point')}")
def visible_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mesh.mesh_size(cubes.surface(fx.phantom(spark, sf_dir), SZ, 0.5, 0.5, labels=[3, 9, 15])))


_HIGH = 4 * 1048576
_MOVED = ", ".join(f"cast(((max({c}) filter (own) + {_HIGH}) * count(*) filter (not own) * 50 + sum({c} + {_HIGH}) filter (not own) * 50) // (count(*) filter (not own) * 100) - {_HIGH} as bigint)" for c in "zyx")


@query(f"""with recursive {fx.PHANTOM_SQL}, {_mesh_sql('v')}, near as (select label, a, b, false own from side union all select label, v, v, true from point),
r(i, label, v, z, y, x) as (select 0, label, v, z, y, x from point union all select r.i + 1, n.label, n.a, {_MOVED} from r join near n on n.label = r.label and n.b = r.v where r.i < 15 group by r.i, n.label, n.a),
done as (select label, v, z, y, x from r where i = 15) {_size_sql(SZ, 0.5, 0.5, 'done')}""")
def smooth_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mesh.mesh_size(cubes.surface(fx.phantom(spark, sf_dir), SZ, 0.5, 0.5, level=1)))


_BETWEEN = zspline.slices_after(D, 1)


def _spline_sql() -> str:
    """Weights (m, z, w) of the slices between, from the spline's linear system solved as a whole."""
    w = mesh.spline_weights(D, _BETWEEN)
    return ", ".join(f"({m}, {z}, cast('{float(w[m, z])!r}' as double))" for m in range(_BETWEEN) for z in range(D))


@query(f"""{P}, w(m, z, w) as (values {_spline_sql()}) select label, cast(m as int) z, y, x from v join w using (z) where label > 0 group by label, m, y, x having sum(w) > {zspline.LEVEL}""")
def interpolated_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zspline.interpolated(fx.phantom(spark, sf_dir), 1, D, slab=5, tile=16)
