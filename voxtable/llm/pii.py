"""Personal data: base patterns with checks, and contextual extraction bootstrapped from them.

Everything here is column expressions and joins.  Base kinds (e-mail, IP address, payment card,
phone) are leftmost, non-overlapping matches of a pattern each, of which those that fail their check are dropped.
Their positions follow from ``split``: the gaps between matches and the matches themselves add up.

Bootstrapping: identifier-like tokens and their left contexts form a graph of instances and patterns.
Seeds (base spans where they stand, and long mixed strings of letters and digits as keys and digests have) score 1.  In each round a
pattern scores the share of its distinct instances that are believed, damped by its support, and an instance
the chance that any of its patterns is right.  Patterns above a confidence and support then mark every
instance they meet, seeds or not, as ``identifier`` spans, where no base span lies.  An instance is a token's stretch of at least six
letters, digits and ``_+/@.-`` that holds a digit or an ``@``; a word of a context has at most 40 signs, and longer ones end it.

Work is in proportion to a text's length and matches (sums and maxima over its spans go by chunks, see ``running``).
Null and empty texts have no spans; ``base_sha256`` is then that of the empty string.  Row ids may repeat or be null: each row
gets the spans of its own text.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, named, settle

#: Kinds in their order.  The patterns are those of the contract, made safe for long runs: a class that cannot hold the next sign
#: is matched possessively, and a match begins only where the run does or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "identifier"]
#: A text without this has no match of the kind; a cheap look first.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _doubled(back.substr(i, F.lit(1)).cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whichever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers, all before it taken together by ``step`` (associative, with ``zero``).

    Arrays grow by copying, so the scan goes by chunks of 64, and chunks of chunks: the work stays in proportion to the elements."""

    def plain(x: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, first, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def chunks(x: Column) -> Column:
        n = F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * _CHUNK + 1, F.lit(_CHUNK)))

    def whole(x: Column) -> Column:
        return F.aggregate(x, zero, step)

    def level(x: Column, above: Callable[[Column], Column]) -> Column:
        return let(chunks(x), lambda parts: F.flatten(F.zip_with(parts, above(F.transform(parts, whole)), lambda part, before: F.transform(plain(part), lambda v: step(before, v)))))

    return let(a, lambda x: level(x, lambda totals: let(totals, lambda y: level(y, plain))))


_REACH = 128  # code points before a span that are looked at; two words and what is glued to it take at most 126


def located(text: Column, pattern: str, gate: str, *, before: bool = False) -> Column:
    """array<struct<start,text[,before]>> of a pattern's matches, in order; empty for a text that fails the gate.  ``before``: up to 128
    code points in front of the match, after a 0 where they begin inside a text or behind another match."""
    near = lambda x, at: F.when((at == 0) & (F.length(x["g"]) <= _REACH), x["g"]).otherwise(F.concat(F.lit("0"), F.right(x["g"], F.lit(_REACH))))
    one = lambda x, at: F.struct((at + F.length(x["g"])).alias("start"), x["m"].alias("text"), *[near(x, at).alias("before")] * before)
    ends = lambda steps: running(F.transform(steps, lambda x: F.length(x["g"]) + F.length(x["m"])), F.lit(0), lambda a, b: a + b)
    steps = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g")))
    out = let(steps, lambda x: F.zip_with(x, ends(x), one))
    return F.when(text.rlike(gate), out).otherwise(F.array().cast("array<struct<start:int,text:string" + ",before:string" * before + ">>"))


def _fits(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["text"])


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start,kind,end>> of a base kind."""
    kept = F.filter(located(text, PATTERNS[kind], _GATES[kind]), _fits(kind))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(x["text"])).alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def base(rows: DataFrame) -> DataFrame:
    """(doc_id, text) rows with ``base``: array<struct<start,kind,end>>, by start, then kind."""
    text = F.col("text")
    per_kind = rows.select("*", *[_spans(text, k).alias(f"_{k}") for k in PATTERNS])
    return per_kind.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in PATTERNS]))).drop(*[f"_{k}" for k in PATTERNS])


#: Up to two tokens without digits, then one with a digit or an @.
_OCCURRENCE = r"(?<!\S)(?:[^\s0-9@]{1,40}\s{1,3})?(?:[^\s0-9@]{1,40}\s{1,3})?\S*[0-9@]\S*"
_CORE = r"(?=[A-Za-z0-9_+/@.-]*[0-9@])[A-Za-z0-9][A-Za-z0-9_+/@.-]{4,}[A-Za-z0-9_/]"


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, _key, start, end, value, patterns): identifier-like tokens and the left contexts they have."""
    at = rows.select("doc_id", F.xxhash64("text").alias("_key"), located(F.col("text"), _OCCURRENCE, "[0-9@]").alias("_all")).select("doc_id", "_key", F.explode("_all").alias("o"))
    token = F.regexp_extract("o.text", r"(\S+)$", 1)
    value = F.regexp_extract(token, _CORE, 0)
    at = at.withColumn("_token", token).withColumn("value", value).where(F.length("value") >= 6)
    glue = F.lower(F.expr("substring(_token, 1, instr(_token, value) - 1)"))
    before = F.lower(F.expr("substring(o.text, 1, char_length(o.text) - char_length(_token))"))
    start = F.col("o.start") + F.length("o.text") - F.length("_token") + F.length("_glue")
    at = at.withColumn("_glue", glue).withColumn("_words", F.split(F.trim(before), r"\s+"))
    return at.select("doc_id", "_key", start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"), "value", _contexts().alias("patterns"))


def _contexts() -> Column:
    """The patterns of a left context, which is the words ``_words`` and what is glued to the value, ``_glue``: the glue alone, with one
    word, with two.  Which of them mean anything is for the scores to say."""
    one = F.concat(F.element_at("_words", -1), F.lit(" "), F.col("_glue"))
    two = F.concat_ws(" ", F.col("_words"), F.col("_glue"))
    found = F.array(F.concat(F.lit("0 "), F.when(F.col("_glue").rlike(r"\w"), F.col("_glue"))), F.concat(F.lit("1 "), F.when(one.rlike(r"\w"), one)), F.concat(F.lit("2 "), F.when(F.size("_words") > 1, two)))
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def base_contexts(rows: DataFrame) -> DataFrame:
    """(value, patterns, seed): the base spans of all kinds, blanks or not, with their left contexts."""
    text = F.col("text")
    kinds = [F.filter(located(text, PATTERNS[k], _GATES[k], before=True), _fits(k)) for k in PATTERNS]
    at = rows.select(F.explode(F.concat(*kinds)).alias("b")).select(F.col("b.text").alias("value"), F.col("b.before").alias("_before"))
    at = at.withColumn("_glue", F.lower(F.regexp_extract("_before", r"(\S*)$", 1))).where(F.length("_glue") <= 40)
    words = F.lower(F.regexp_extract("_before", r"((?<!\S)(?:[^\s0-9@]{1,40}\s{1,3}){0,2})\S*$", 1))
    return at.withColumn("_words", F.split(F.trim(words), r"\s+")).select("value", _contexts().alias("patterns"), F.lit(True).alias("seed"))


def _is_seed(v: Column) -> Column:
    fits = F.lit(False)
    for kind, p in PATTERNS.items():
        fits = fits | (v.rlike(f"^(?:{p})$") & _valid(kind, v))
    key = v.rlike("^[A-Za-z0-9_/+-]{16,}$") & v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    return fits | key


def patterns(found: DataFrame, spans: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """(pattern) that the seeds among ``occurrences`` and ``base_contexts`` lead to.  Instances and patterns meet once each (distinct edges), so common ones weigh no more."""
    met = found.select("value", "patterns", _is_seed(F.col("value")).alias("seed")).unionByName(spans)
    edges = settle(met.select(F.xxhash64("value").alias("instance"), F.explode("patterns").alias("pattern"), "seed").groupBy("instance", "pattern").agg(F.max("seed").alias("seed")))
    believed = edges.select("instance", "pattern", F.col("seed").cast("double").alias("score"), "seed")
    for i in range(rounds):
        scored = believed.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("sure"), F.count("*").alias("n"))
        if i == rounds - 1:
            break
        scored = settle(scored.where(F.col("n") >= 2))
        reach = edges.join(scored, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("sure"), F.lit(0.99)))))).alias("reached"))
        believed = settle(edges.join(reach, "instance", "left").select("instance", "pattern", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score"), "seed"))
    return scored.where((F.col("sure") >= confidence) & (F.col("n") >= support)).select("pattern")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rounds: int = 3, confidence: float = 0.8, support: int = 5, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, base, found): base spans of each row, and array<struct<start,kind,end>> of what the contexts add; with
    ``keep`` also ``row``, a struct of the input columns named there."""
    rows = id_text(docs, id_col, text_col)
    seen = settle(occurrences(rows))
    good = patterns(seen, base_contexts(rows), rounds, confidence, support)
    hits = seen.select("doc_id", "_key", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    hits = hits.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(KINDS.index("identifier")).alias("kind"), "end"))).alias("hits"))
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *([F.struct(*map(named, keep)).alias("row")] if keep else []))
    based = base(kept).withColumn("_key", F.xxhash64("text"))
    # The same plan at every size: hits grow with the corpus, so they are never sent to all executors.
    joined = based.join(hits.hint("merge"), based["doc_id"].eqNullSafe(hits["doc_id"]) & (based["_key"] == hits["_key"]), "left").drop(hits["doc_id"], hits["_key"])
    clear = F.when(F.col("hits").isNull(), _no_spans()).when(F.size("base") == 0, F.col("hits")).otherwise(_clear(F.col("base"), F.col("hits")))
    return joined.select("doc_id", "text", "base", clear.alias("found"), *(["row"] if keep else []))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _clear(base_spans: Column, hits: Column) -> Column:
    """The hits that no base span meets: of all spans in order, none that begins before reaches into a hit, and none begins within it."""
    added = KINDS.index("identifier")

    def free(spans: Column) -> Column:
        reached = running(F.transform(spans, lambda s: F.when(s["kind"] == added, F.lit(0)).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] == added, F.lit(2**31 - 1)).otherwise(s["start"]))), F.lit(2**31 - 1), lambda a, b: F.least(a, b)))
        near = F.arrays_zip(reached.alias("r"), begins.alias("b"))
        return F.filter(F.zip_with(spans, near, lambda s, x: F.when((s["kind"] == added) & (x["r"] <= s["start"]) & (x["b"] >= s["end"]), s)), lambda s: s.isNotNull())

    return let(F.array_sort(F.concat(base_spans, hits)), free)


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and span lists of ``find``'s rows."""
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_identifier"))


_BLOCK = 4096


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text[, row]) with each span replaced by its kind in brackets; of overlapping spans the first covers the others."""
    names = F.array(*map(F.lit, KINDS))
    more = [c for c in found.columns if c == "row"]
    rows = found.select("doc_id", "text", F.array_sort(F.concat("base", "found")).alias("_spans"), *more)

    def cut(blocks: Column, lo: Column, n: Column) -> Column:
        first = F.floor(lo / _BLOCK).cast("int")
        last = F.floor((lo + n) / _BLOCK).cast("int")
        return F.array_join(F.slice(blocks, first + 1, last - first + 1), "").substr(lo - first * _BLOCK + 1, n)

    def put(spans: Column, at: Column, blocks: Column) -> Column:
        parts = F.zip_with(spans, at, lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"] - at), F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]"))))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), ""), cut(blocks, last, F.length("text") - last))

    # A place in a text is found by walking to it, so the text is cut into blocks first: no walk is longer than a few of them.
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    ends = lambda spans: running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    done = let(F.col("_spans"), lambda spans: let(blocks, lambda b: put(spans, ends(spans), b)))
    return rows.select("doc_id", F.when(F.size("_spans") > 0, done).otherwise(F.col("text")).alias("text"), *more)
