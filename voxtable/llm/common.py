"""Helpers that all text operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a temporary one will do if all run in one process
    (as in tests); on a cluster it must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="voxtable-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        found = "file://" + _local[0]
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and its folder with it
        pass


def fresh_path(spark: SparkSession) -> str:
    """A place in the shared folder for a table, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/voxtable-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def add_to(df: DataFrame, path: str) -> None:
    """Append rows to the table at a path."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def settle(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of any executor and is
    never computed twice.  The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Remove a table that ``settle`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_settled_path", None):
        _remove(df.sparkSession, path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, empty: bool = True) -> DataFrame:
    """Only (doc_id long, text string): extra columns, whatever their names, stay out of the operator."""
    text = F.coalesce(F.col(text_col), F.lit("")) if empty else F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("string").alias("text"))


def named(name: str) -> Column:
    """The column of that very name, dots and blanks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*map(named, df.columns))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame, rows: int = 500) -> None:
    """Whole texts go to Python in batches of a few hundred: a worker holds one batch at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def within_share(key: Column, share: Column) -> Column:
    """Whether the hash of ``key`` falls in the first ``share`` of its range: a sample that any task can draw alone."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)


def stretch(text: Column, most: int) -> Column:
    """The text, or of a longer one ``most`` code points from a place that its hash says: for training, never for results."""
    at = F.pmod(F.xxhash64(text), F.length(text) - most + 1).cast("int")
    return F.when(F.length(text) <= most, text).otherwise(text.substr(at + 1, F.lit(most)))
