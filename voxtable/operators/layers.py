"""Undo and redo on two levels, with drawn lines on top: each slice has a stack of its own, and edits of all slices have one of theirs.

A log has rows (session, seq, action, z).  ``edit`` changes slice z, ``edit_all`` every slice, ``draw`` adds a line to slice z.  ``undo`` takes back, with slice z
on the screen, its last line; if it has none, its last edit; if it has none, the last edit of all slices, which brings back every slice as it was before.
``redo`` looks at edits of all slices first and at those of slice z after; ``redo_line`` brings back the line of slice z taken back last, ``clear``
takes all its lines, and ``clear_all`` those of every slice.  A new edit forgets what could be redone on its own level, a new line what
lines of its slice could be.  Actions that find nothing to do are nothing; other ones are unknown and change nothing.

Sessions are folded in parallel, as streams of rows sorted by session, many in a task.  A long session is cut into chunks, and its state goes from chunk to
chunk as a row of a table: a task holds the stacks of one session and a batch of rows.  Rows of equal ``seq`` are taken in the order of action and slice, nulls first.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import settle

CHUNK = 100_000


class Layers:
    """What one session's actions have left so far.  A slice's content is the number of the edit that made it, None where none has; ``base`` holds
    for slices that are not in ``own``, so an edit of all slices costs no more than one of them."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.own: dict[int, int | None] = {}
        self.undo: dict[int, list] = defaultdict(list)
        self.redo: dict[int, list] = defaultdict(list)
        self.undo_all: list[tuple] = []
        self.redo_all: list[tuple] = []
        self.lines: dict[int, list[int]] = defaultdict(list)
        self.lines_back: dict[int, list[int]] = defaultdict(list)

    def _at(self, z: int) -> int | None:
        return self.own.get(z, self.base)

    def _swap_slice(self, source: dict, target: dict, z: int) -> None:
        target[z].append(self._at(z))
        self.own[z] = source[z].pop()

    def _swap_all(self, source: list, target: list) -> None:
        target.append((self.base, self.own))
        self.base, self.own = source.pop()

    def act(self, seq: int, action: str, z: int | None) -> None:
        if action == "edit_all":
            self.undo_all.append((self.base, self.own))
            self.redo_all.clear()
            self.base, self.own = seq, {}
        elif action == "clear_all":
            self.lines.clear()
        elif action == "redo" and self.redo_all:
            self._swap_all(self.redo_all, self.undo_all)
        elif z is None:
            if action == "undo" and self.undo_all:
                self._swap_all(self.undo_all, self.redo_all)
        elif action == "edit":
            self.undo[z].append(self._at(z))
            self.redo[z].clear()
            self.own[z] = seq
        elif action == "draw":
            self.lines[z].append(seq)
            self.lines_back[z].clear()
        elif action == "undo":
            if self.lines[z]:
                self.lines_back[z].append(self.lines[z].pop())
            elif self.undo[z]:
                self._swap_slice(self.undo, self.redo, z)
            elif self.undo_all:
                self._swap_all(self.undo_all, self.redo_all)
        elif action == "redo" and self.redo[z]:
            self._swap_slice(self.redo, self.undo, z)
        elif action == "redo_line" and self.lines_back[z]:
            self.lines[z].append(self.lines_back[z].pop())
        elif action == "clear":
            self.lines[z] = []

    def rows(self) -> list[tuple[str, int | None, int | None]]:
        """(kind, z, seq): contents by slice (z None: of all other slices) and lines."""
        out = [("label", None, self.base), *(("label", z, v) for z, v in self.own.items() if v != self.base)]
        return out + [("line", z, seq) for z, lines in self.lines.items() for seq in lines]


def left(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session, kind, z, seq) of what a log has left: ``label`` rows name the edit that made a slice's content (seq null: none; z null: the slices
    without a row of their own), ``line`` rows the lines that are drawn."""
    rows = log.select("session", F.col("seq").cast("long").alias("seq"), "action", F.col("z").cast("int").alias("z"))
    longest = rows.groupBy("session").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, -(-longest // chunk))  # one round, unless a session is longer than a chunk
    if rounds > 1:
        place = F.row_number().over(Window.partitionBy("session").orderBy("seq", "action", "z")) - 1
        rows = settle(rows.withColumn("part", F.floor(place / chunk).cast("int")))
    session = rows.schema["session"]
    state_type = T.StructType([session, T.StructField("state", T.BinaryType())])
    out_type = T.StructType([session, T.StructField("kind", T.StringType()), T.StructField("z", T.IntegerType()), T.StructField("seq", T.LongType())])

    def told(key: object, layers: Layers) -> list[tuple]:
        return [(key, *r) for r in layers.rows()]

    def kept(key: object, layers: Layers) -> list[tuple]:
        return [(key, pickle.dumps(layers))]

    def folded(batches: Iterator[pa.RecordBatch], tell: Callable, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
        """Rows (session, state, seq, action, z) by session, a session's state before its actions; one session is held at a time."""
        key, layers, out = None, None, []

        def packed() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k or kind) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("session").type
            for who, state, seq, action, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if layers is None or who != key and (who == who or key == key):
                    if layers is not None:
                        out += tell(key, layers)
                    key, layers = who, Layers()
                if state is not None:
                    layers = pickle.loads(state)
                else:
                    layers.act(seq, action, z)
            if len(out) > 10_000:
                yield packed()
                out = []
        if layers is not None:
            out += tell(key, layers)
            yield packed()

    state = None
    for part in range(rounds):
        acts = (rows if rounds == 1 else rows.where(F.col("part") == part)).select("session", F.lit(None).cast("binary").alias("state"), "seq", "action", "z")
        if state is not None:
            acts = acts.unionByName(state, allowMissingColumns=True)
        dealt = acts.repartition("session").sortWithinPartitions("session", F.col("state").isNull(), "seq", "action", "z")
        if part == rounds - 1:
            return dealt.mapInArrow(lambda b: folded(b, told, ["session", "kind", "z", "seq"], [None, pa.string(), pa.int32(), pa.int64()]), out_type)
        state = settle(dealt.mapInArrow(lambda b: folded(b, kept, ["session", "state"], [None, pa.binary()]), state_type))


def contents(found: DataFrame, slices: DataFrame) -> DataFrame:
    """(session, z, seq) of every slice (z) for every session: the edit that made its content, null where none has."""
    labels = found.where("kind = 'label'")
    base = labels.where("z is null").select("session", F.col("seq").alias("_base"))
    own = labels.where("z is not null").select("session", "z", "seq", F.lit(True).alias("_own"))
    spine = base.crossJoin(slices.select("z").distinct())  # a row a session, by a row a slice: what is asked for
    return spine.join(own, ["session", "z"], "left").select("session", "z", F.when(F.col("_own"), F.col("seq")).otherwise(F.col("_base")).alias("seq"))
