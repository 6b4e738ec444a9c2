"""Getting this package to where Python workers run, and tables to where all executors can read them."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Give the package's modules to all Python workers of the session, once; Spark's file server takes the archive from the driver.

    Workers need it wherever the package is not installed on the executors: functions are sent to them by reference."""
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent
    if app not in _shipped and root.is_dir():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        path = Path(tempfile.mkdtemp(prefix="voxtable-")) / f"{root.name}.zip"
        path.write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names, which driver and executors share (in local mode in a temporary one).  It goes when the
    driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _folders:
            _folders.append(tempfile.mkdtemp(prefix="voxtable-"))
            atexit.register(shutil.rmtree, _folders[0], ignore_errors=True)
        folder = "file://" + _folders[0]
    path = f"{folder.rstrip('/')}/voxtable-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a table in a fresh folder, read back: what took long is computed once and survives lost executors."""
    path = fresh_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
