"""Point-in-time join: which version was usable at a time, by reverse sparse tables.

A version is usable over the half-open interval from the later of event and arrival to its expiry.  Time falls into windows of
``2 ** BITS`` units, and each window of a key has a reverse sparse table: row k has a cell for each block of 2^k units.  An interval
within a window is covered by two blocks of the largest power of two that fits, which may overlap; a cell takes the greatest version of all
that are put there; then winners are pushed down, each cell to the two blocks of half its size below it, so that row 0 has the winner of
every unit of time, where the labels' times are looked up.

An interval over several windows has a head and a tail of this kind, and whole windows between them: these are an interval again, in units of
windows, in a table of the next order.  So an interval of any length costs at most four blocks an order, and beyond the last order one row for
each window of it.

Nothing that grows with the input meets in one task: blocks are maxima, combined before the shuffle, so a window gets at most
(BITS + 1) * 2^BITS of them, and of the labels only distinct times come to it, at most 2^BITS.  Labels meet their versions again in joins,
whose hot keys Spark can split (one side has one row a key); none is broadcast.

Defined results: versions with a null key, id or time take no part, and none whose interval is empty.  Labels with a null key or time get no version.
Of versions with equal event, arrival and id the one with the greatest further fields wins (null lowest).  Equal labels get a row each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

BITS, ORDERS = 10, 3  # windows of 1024 units, of 2^20 and of 2^30


def push_down(level: np.ndarray, place: np.ndarray, rank: np.ndarray, bits: int) -> np.ndarray:
    """The greatest rank over each of ``2 ** bits`` units, -1 where there is none, of blocks ``[place, place + 2 ** level)``."""
    table = np.full((bits + 1, 1 << bits), -1, np.int64)
    np.maximum.at(table, (level, place), rank)
    for k in range(bits, 0, -1):
        half, last = 1 << (k - 1), (1 << bits) - (1 << k) + 1
        np.maximum(table[k - 1, :last], table[k, :last], out=table[k - 1, :last])
        np.maximum(table[k - 1, half : half + last], table[k, :last], out=table[k - 1, half : half + last])
    return table[0]


def _piece(order: int, window: Column, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(order).alias("order"), window.alias("window"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _each(order: int, first: Column, last: Column, lo: Column, hi: Column) -> Callable[[Column], Column]:
    """A window of the last order as a piece."""
    return lambda w: _piece(order, w, F.when(w == first, lo).otherwise(0), F.when(w == last, hi).otherwise(1 << BITS))


def pieces(spans: DataFrame) -> DataFrame:
    """Spans (start, end, ...) cut into pieces ``p`` (order, window, lo, hi), each within a window of its order; places count from the window's start."""
    width, others = 1 << BITS, [c for c in spans.columns if c not in ("start", "end")]
    out = spans.where("start < end").withColumnsRenamed({"start": "_s0", "end": "_e0"})
    for o in range(ORDERS):  # of order o + 1: the windows between the first and the last
        s, e = F.col(f"_s{o}"), F.col(f"_e{o}")
        out = out.withColumns({f"_f{o}": F.shiftright(s, BITS), f"_l{o}": F.shiftright(e - 1, BITS)})
        out = out.withColumns({f"_s{o + 1}": F.col(f"_f{o}") + 1, f"_e{o + 1}": F.when(s < e, F.col(f"_l{o}")).otherwise(F.col(f"_f{o}"))})
    none = F.array().cast("array<struct<order:int,window:bigint,lo:int,hi:int>>")
    parts = []
    for o in range(ORDERS):
        s, e, f, last = [F.col(f"_{c}{o}") for c in "sefl"]
        lo, hi = s - F.shiftleft(f, BITS), e - F.shiftleft(last, BITS)
        ends = F.array(_piece(o, f, lo, F.lit(width)), _piece(o, last, F.lit(0), hi))
        if o == ORDERS - 1:  # beyond the last order: its windows one by one
            ends = F.transform(F.sequence(f, last), _each(o, f, last, lo, hi))
        parts.append(F.when(s >= e, none).when(f == last, F.array(_piece(o, f, lo, hi))).otherwise(ends))
    return out.select(*others, F.explode(F.concat(*parts)).alias("p"))


def winners(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, order, at, w): the winner over each place asked for, where there is one.

    versions: (key, start, end, w), w a struct whose order decides; asked: (key, at), in units of time.  ``at`` is counted in units of the order."""
    length = F.col("p.hi") - F.col("p.lo")
    level = (F.length(F.bin(length)) - 1).cast("int")
    blocks = pieces(versions).withColumn("level", level)
    second = F.col("p.hi") - F.call_function("shiftleft", F.lit(1), F.col("level"))
    blocks = blocks.select("key", "w", "p.order", "p.window", "level", F.explode(F.array_distinct(F.array("p.lo", second))).alias("place"))
    blocks = blocks.groupBy("key", "order", "window", "level", "place").agg(F.max("w").alias("w"))
    places = asked.select("key", F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.shiftright("at", o * BITS).alias("at")) for o in range(ORDERS)])).alias("a")).select("key", "a.*").distinct()
    places = places.withColumn("window", F.shiftright("at", BITS))
    fields = [f"w.{f.name}" for f in versions.schema["w"].dataType.fields]
    names = [f.name for f in versions.schema["w"].dataType.fields]

    def look_up(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if have.empty or want.empty:
            return pd.DataFrame(columns=["key", "order", "at", *names])
        have = have.sort_values(names, na_position="first", ignore_index=True)  # a row's number is its rank
        best = push_down(have["level"].to_numpy(), have["place"].to_numpy(), np.arange(len(have)), BITS)
        best = best[(want["at"] & ((1 << BITS) - 1)).to_numpy()]
        found = want.loc[best >= 0, ["key", "order", "at"]].reset_index(drop=True)
        return pd.concat([found, have.loc[best[best >= 0], names].reset_index(drop=True)], axis=1)

    schema = T.StructType([versions.schema["key"], T.StructField("order", T.IntegerType()), T.StructField("at", T.LongType()), *versions.schema["w"].dataType.fields])
    by = ["key", "order", "window"]
    met = blocks.select(*by, "level", "place", *fields).groupBy(*by).cogroup(places.groupBy(*by)).applyInPandas(look_up, schema)
    return met.select("key", "order", "at", F.struct(*names).alias("w"))


def latest(versions: DataFrame, labels: DataFrame, *, stale: int = 20) -> DataFrame:
    """(doc_id, t, version_id, age, status, n_chars, lang), one row a label.

    versions: (key string, doc_id, event, arrival, expiry longs, n_chars long, lang string); labels: (doc_id, key, t long).  Of the usable versions
    the latest event wins, then the latest arrival, then the largest id; it is stale when its event is more than ``stale`` units back."""
    known = versions.dropna(subset=["key", "doc_id", "event", "arrival", "expiry"])
    # No field is null on its way through pandas: -1 stands for no length, and a sign stands before each language.
    fields = [F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang")]
    known = known.select("key", F.greatest("event", "arrival").alias("start"), F.col("expiry").alias("end"), F.struct("event", "arrival", F.col("doc_id").alias("version"), *fields).alias("w"))
    found = settle(winners(known, labels.select("key", F.col("t").alias("at")).dropna().distinct()))
    out = labels
    for order in range(ORDERS):  # merge: a broadcast would grow with the labels
        mine = found.where(F.col("order") == order).select(F.col("key").alias("_k"), F.col("at").alias("_at"), F.col("w").alias(f"_w{order}"))
        out = out.join(mine.hint("merge"), (F.col("key") == F.col("_k")) & (F.shiftright("t", order * BITS) == F.col("_at")), "left").drop("_k", "_at")
    w = F.greatest(*[F.col(f"_w{o}") for o in range(ORDERS)])
    out = out.select("doc_id", "t", w.alias("w")).withColumn("age", F.col("t") - F.col("w.event"))
    status = F.when(F.col("w").isNull(), "none").when(F.col("age") > stale, "stale").otherwise("fresh")
    fresh = status == "fresh"
    n_chars, lang = F.col("w.n_chars"), F.col("w.lang")
    return out.select("doc_id", "t", F.col("w.version").alias("version_id"), "age", status.alias("status"), F.when(fresh & (n_chars >= 0), n_chars).alias("n_chars"), F.when(fresh & (lang != ""), F.substring(lang, 2, 1 << 30)).alias("lang"))


def _numbers(doc_id: Column) -> list[Column]:
    digest = F.sha2(doc_id.cast("string"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def document_versions(docs: DataFrame) -> DataFrame:
    """Documents as versions of their source, at times that their ids give."""
    a, b, c, _ = _numbers(F.col("doc_id"))
    event = F.pmod(a, F.lit(200_000))
    return docs.select(
        F.col("source").cast("string").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), event.alias("event"), (event - 60 + F.pmod(b, F.lit(1200))).alias("arrival"), (event + F.pmod(c, F.lit(900))).alias("expiry"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"),
    )


def label_times(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels ask about their document's source (of repeated ids: the smallest) at a time that their id gives."""
    sources = docs.where("doc_id is not null and source is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("source").cast("string")).alias("key"))
    asks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(_numbers(F.col("doc_id"))[3], F.lit(200_000)).alias("t"))
    return asks.join(sources.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "key", "t")


def oracle_sql() -> str:
    return """
with n as (select doc_id, source, n_chars, lang, [cast('0x' || substr(sha256(cast(doc_id as varchar)), 1 + 8 * i, 8) as bigint) for i in range(4)] as g from documents),
v as (select source, doc_id, n_chars, lang, g[1] % 200000 as event, g[1] % 200000 - 60 + g[2] % 1200 as arrival, g[1] % 200000 + g[3] % 900 as expiry from n),
l as (select l.doc_id, n.source, cast('0x' || substr(sha256(cast(l.doc_id as varchar)), 25, 8) as bigint) % 200000 as t, row_number() over () as i from labels l left join n on n.doc_id = l.doc_id),
m as (select l.i, v.*, row_number() over (partition by l.i order by v.event desc, v.arrival desc, v.doc_id desc) as place from l join v on v.source = l.source and v.event <= l.t and v.arrival <= l.t and l.t < v.expiry)
select l.doc_id, l.t, m.doc_id as version_id, l.t - m.event as age, case when m.i is null then 'none' when l.t - m.event > 20 then 'stale' else 'fresh' end as status,
  case when l.t - m.event <= 20 then m.n_chars end as n_chars, case when l.t - m.event <= 20 then m.lang end as lang
from l left join m on m.i = l.i and m.place = 1
"""
