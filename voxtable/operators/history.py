"""Undo and redo as a log: each action names slices (or all), and a state is what the log leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active(log: DataFrame, session: str | None = None) -> DataFrame:
    """The edits in force after a log (seq, action, ...) of ``edit``, ``undo`` and ``redo``, of each ``session`` for itself (without one, of all rows as one).

    An edit clears what could be redone; undo takes the last edit in force, redo brings the last undone back.  Sessions are folded in
    parallel, each in one pass over its (seq, action) pairs: a session is what one user does, so it fits a task."""
    by = [session] if session else []

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        done: list[int] = []
        top = 0  # edits in force; what lies above can be redone
        for seq, action in zip(pdf["seq"], pdf["action"], strict=True):
            if action == "edit":
                del done[top:]
                done.append(seq)
                top += 1
            elif action == "undo":
                top = max(top - 1, 0)
            elif action == "redo":
                top = min(top + 1, len(done))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * top for c in by}, "seq": done[:top]})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields if f.name in [*by, "seq"])
    names = [f.name for f in log.schema.fields if f.name in [*by, "seq"]]
    kept = log.select(*by, "seq", "action").groupBy(*by).applyInPandas(lambda pdf: fold(pdf)[names], keys)
    return log.join(kept, [*by, "seq"], "left_semi")


def restored(voxels: DataFrame, log: DataFrame) -> DataFrame:
    """The volume after the edits in force (seq, z, label): each gives its slice's labelled voxels its label, so the last of a slice stays."""
    last = log.groupBy("z").agg(F.max_by("label", "seq").alias("_l"))
    kind = dict(voxels.dtypes)["label"]
    return voxels.join(last, "z", "left").withColumn("label", F.when(F.col("label") > 0, F.coalesce("_l", "label")).otherwise(F.col("label")).cast(kind)).drop("_l")


def as_of(snapshots: DataFrame, version: int) -> DataFrame:
    """Each key's row of the last version up to ``version``: snapshots (version, key, ...) of slices or of single voxels."""
    last = Window.partitionBy("key").orderBy(F.desc("version"))
    return snapshots.where(F.col("version") <= version).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def without_latest(paths: DataFrame) -> DataFrame:
    """Paths with each slice's last one taken back."""
    top = paths.groupBy("z").agg(F.max("seq").alias("_top"))
    return paths.join(top, "z").where("seq < _top").drop("_top")
