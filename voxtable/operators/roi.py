"""Regions of interest: catalogues, choice and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_table(spark: SparkSession, catalog: dict[str, list[str]]) -> DataFrame:
    """(task, roi) rows of a task -> names mapping, which the caller supplies (e.g. read from JSON)."""
    rows = [(task, i, roi) for task, names in catalog.items() for i, roi in enumerate(names)]
    return spark.createDataFrame(rows, "task string, place int, roi string")


def task_index(catalog: DataFrame) -> DataFrame:
    """(roi, task), sorted by both: what a search shows."""
    return catalog.select("roi", "task").distinct().orderBy("roi", "task")


def for_task(catalog: DataFrame, task: str) -> DataFrame:
    return catalog.where(F.col("task") == task).select("roi", "task").orderBy("roi")


def counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("rows"), F.count_distinct("roi").alias("rois"))


def requests(typed: DataFrame) -> DataFrame:
    """(id, place, roi) of lists typed with commas, blanks or line ends (id, typed): empties left out, the first of repeats in a list kept."""
    words = typed.select("id", F.posexplode(F.split("typed", r"[,\n\s]+")).alias("place", "roi")).where("roi <> ''")
    return words.groupBy("id", "roi").agg(F.min("place").alias("place")).select("id", "place", "roi")


def requested(spark: SparkSession, text: str) -> DataFrame:
    """(place, roi) of one typed list."""
    return requests(spark.createDataFrame([(0, text)], "id int, typed string")).select("place", "roi")


def invalid(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    return wanted.join(catalog, "roi", "left_anti")


def valid(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    return wanted.join(catalog, "roi", "left_semi")


def resolve_task(task: str, modality: str) -> str:
    """Auto means the whole body of the modality; a lock sign in front is dropped."""
    task = task.lstrip("\U0001f512 ").strip()
    return ("total_mr" if modality.lower() == "mr" else "total") if task.lower() == "auto" else task


def match_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(roi, file): the file of the very name, else the first whose name contains it (case aside).  A name has at most as many parts of a
    given length as letters, so names are met by equality with their parts of the lengths that are wanted."""
    w = wanted.select("roi").distinct().withColumn("_k", F.lower("roi"))
    sizes = [r["n"] for r in w.select(F.length("_k").alias("n")).distinct().where("n between 1 and 255").collect()]  # a file's name has at most 255 signs
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.nii(\.gz)?$", "")
    named = files.select("file", stem.alias("_s"), F.lower(stem).alias("_l"))

    def parts_of(n: int) -> Column:
        starts = F.when(F.length("_l") >= n, F.sequence(F.lit(1), F.length("_l") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.col("_l").substr(i, F.lit(n)))

    parts = F.array_distinct(F.flatten(F.array(*map(parts_of, sizes)))) if sizes else F.array().cast("array<string>")
    met = named.select("file", "_s", F.explode(parts).alias("_k")).join(w, "_k").withColumn("_r", F.when(F.col("_s") == F.col("roi"), 0).otherwise(1))
    return met.groupBy("roi").agg(F.min(F.struct("_r", "file"))["file"].alias("file"))


def merge_labels(members: DataFrame, order: DataFrame, most: int = 20) -> DataFrame:
    """(z, y, x, label) of regions laid over each other: the label is the place in the selection (from 1), later ones
    overwrite, only the first ``most`` are taken.  members: (z, y, x, roi); order: (roi, place from 1)."""
    first = order.where(F.col("place") <= most)
    return members.join(F.broadcast(first), "roi").groupBy("z", "y", "x").agg(F.max("place").cast("int").alias("label"))


def object_ids(n: int, start: int = 0) -> list[int]:
    """Label of each region when numbering goes round from a start colour."""
    return [(start + i) % 20 + 1 for i in range(n)]
