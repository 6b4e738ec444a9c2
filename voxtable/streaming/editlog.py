"""An edit log as a stream: each batch of edits is applied to the label snapshot and saved as its next version."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import LABELS

EDITS = "seq long, z int, kind string, src int, dst int"


def apply_batch(voxels: DataFrame, edits: DataFrame) -> DataFrame:
    """Convert and delete edits of a batch, in order of ``seq``, on their slices (null: on all).

    A batch's edits compose to one map of labels for each slice: a table of 20 labels by slices, joined once, however many edits there are.
    """
    spread = edits.select("seq", "z", F.col("src"), F.when(F.col("kind") == "delete", 0).otherwise(F.col("dst")).alias("dst"))
    slices = voxels.select("z").distinct()
    own = spread.where("z is not null").join(slices, "z", "left_semi").unionByName(spread.where("z is null").drop("z").crossJoin(slices))  # a batch's edits on all slices: few, by slices
    listed = own.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("seq", "src", "dst"))).alias("edits"))
    maps = listed.select("z", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda x: F.aggregate("edits", x.cast("int"), lambda a, e: F.when(a == e["src"], e["dst"]).otherwise(a)))).alias("label", "_to"))
    kind = dict(voxels.dtypes)["label"]
    joined = voxels.join(maps.withColumn("label", F.col("label").cast(kind)), ["z", "label"], "left")
    return joined.withColumn("label", F.coalesce("_to", "label").cast(kind)).select(voxels.columns)


def autosave(edits: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the stream: ``load`` gives the latest snapshot, ``save`` stores the next with the batch's number (storing a number again must replace it,
    which makes each batch count once)."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(apply_batch(load(), batch), number)

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def edit_counts(edits: DataFrame) -> DataFrame:
    """(z, edits, last_seq): running totals by slice, kept as custom state."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for pdf in rows:
            n, last = n + len(pdf), max(last, int(pdf["seq"].max()))
        state.update((n, last))
        yield pd.DataFrame({"z": [key[0]], "edits": [n], "last_seq": [last]})

    return edits.where("z is not null").groupBy("z").applyInPandasWithState(update, "z int, edits long, last_seq long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


class LabelMaps(StatefulProcessor):
    """Keeps what the edits so far make of each label of a slice, and the last edit's number, so that edits which come again are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.to = handle.getMapState("to", "label int", "dst int")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        edits = pd.concat(list(rows))
        edits = edits[edits["seq"] > last].drop_duplicates("seq").sort_values("seq")
        if edits.empty:
            return
        to = {k[0]: v[0] for k, v in self.to.iterator()}
        changed = set()
        for src, dst in zip(edits["src"].tolist(), edits["dst"].tolist(), strict=True):
            for label in range(LABELS + 1):
                if to.get(label, label) == src:
                    to[label] = dst
                    changed.add(label)
        last = int(edits["seq"].iloc[-1])
        self.last.update((last,))
        for label in changed:
            self.to.updateValue((label,), (to[label],))
        found = sorted(changed)
        yield pd.DataFrame({"z": [key[0]] * len(found), "label": found, "dst": [to[x] for x in found], "seq": [last] * len(found)})

    def close(self) -> None:
        pass


def label_maps(edits: DataFrame, depth: int) -> DataFrame:
    """(z, label, dst, seq) as the stream of EDITS goes on: what the edits up to ``seq`` make of a slice's label, for labels that a batch has changed.

    State is a map and a number for each slice, kept by ``transformWithState``; a stream that starts again from its checkpoint goes on where it was, and
    edits that it has seen change nothing.  Edits without a slice go to all of them.  Later edits must come in later batches."""
    slices = F.when(F.col("z").isNull(), F.sequence(F.lit(0), F.lit(depth - 1))).otherwise(F.array("z"))
    dst = F.when(F.col("kind") == "delete", 0).otherwise(F.col("dst"))
    own = edits.select("seq", F.explode(slices).alias("z"), "src", dst.alias("dst"))
    return own.groupBy("z").transformWithStateInPandas(statefulProcessor=LabelMaps(), outputStructType="z int, label int, dst int, seq long", outputMode="Update", timeMode="None")


def apply_maps(voxels: DataFrame, maps: DataFrame) -> DataFrame:
    """The volume under the last of each slice's and label's maps."""
    kind = dict(voxels.dtypes)["label"]
    last = maps.groupBy("z", F.col("label").cast(kind).alias("label")).agg(F.max_by("dst", "seq").alias("_to"))
    joined = voxels.join(last, ["z", "label"], "left")
    return joined.withColumn("label", F.coalesce("_to", "label").cast(kind)).select(voxels.columns)
