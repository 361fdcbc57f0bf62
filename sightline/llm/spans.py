"""Native span arithmetic: regex matches of a text column as (start, end) code-point spans, without Python workers.

Spark gives the matches (regexp_extract_all) and the pieces between them (split); running lengths of both give the
positions. All of it stays in one row, so nothing shuffles. What an inner loop reads is a column of its own that is named outside the loop as
well: otherwise the optimizer would move its expression into the loop. Work is about in proportion to a text's matches: a running value is
carried through an array in chunks, as appending to one array one by one would copy it each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: l and r: up to LEFT code points before the match (back to the match before the last of its kind at most) and RIGHT behind it.
SPAN = "array<struct<s:int,e:int,k:int,m:string,ok:boolean,l:string,r:string>>"
LEFT, RIGHT = 40, 2
CHUNK, PAGE = 128, 1024


def fold(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, flush: Callable[[Column], Column] | None = None) -> Column:
    """Carries a state through an array from the left. step(state, item): the next state, and what is emitted (nothing where null). flush(state): what is
    emitted at the end. kind: the type of the array of all that is emitted."""
    none = F.array().cast(kind)

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), F.when(out.isNull(), a["out"]).otherwise(F.array_append(a["out"], out)).alias("out"))

    def chunk(a: Column, c: Column) -> Column:
        last = F.aggregate(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), F.struct(a["last"]["state"].alias("state"), none.alias("out")), one)
        return F.struct(last.alias("last"), F.array_append(a["done"], a["last"]["out"]).alias("done"))

    def end(a: Column) -> Column:
        out = F.flatten(F.array_append(a["done"], a["last"]["out"]))
        return out if flush is None else F.concat(out, F.filter(F.array(flush(a["last"]["state"])), lambda x: x.isNotNull()))

    zero = F.struct(F.struct(start.alias("state"), none.alias("out")).alias("last"), F.array().cast(f"array<{kind}>").alias("done"))
    chunks = F.sequence(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)
    return F.when(F.size(items) > 0, F.aggregate(chunks, zero, chunk, end)).otherwise(none)


@dataclass(frozen=True)
class Rule:
    """A span kind. regex: leftmost non-overlapping matches; group: the group that `ok` gets besides the match."""

    kind: str
    regex: str
    ok: Callable[[Column, Column], Column] = field(default=lambda m, g: F.lit(True))
    guard: Callable[[Column], Column] | None = None
    group: int = 0
    #: Whether matches that fail `ok` are kept as candidates with ok = false.
    candidates: bool = False


def add_spans(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """Adds one column span_<i> of type SPAN for each rule, ordered by start. text: a non-null string column."""
    t = F.col(text)
    for i, r in enumerate(rules):
        found = F.regexp_extract_all(t, F.lit(r.regex), F.lit(0))
        df = df.withColumn(f"m_{i}", F.when(r.guard(t), found) if r.guard else found)
    for i, r in enumerate(rules):
        some = F.size(F.col(f"m_{i}")) > 0
        df = df.withColumn(f"p_{i}", F.when(some, F.split(t, r.regex, -1)))
        if r.group:
            df = df.withColumn(f"g_{i}", F.when(some, F.regexp_extract_all(t, F.lit(r.regex), F.lit(r.group))))
    for i, r in enumerate(rules):
        m, p, g = F.col(f"m_{i}"), F.col(f"p_{i}"), F.col(f"g_{i}" if r.group else f"m_{i}")
        none, empty = F.array().cast(SPAN), F.lit("")
        steps = F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x).alias("n")))
        df = df.withColumn(f"z_{i}", steps)
        df = df.withColumn(f"s_{i}", F.when(F.size(m) > 0, fold(F.col(f"z_{i}"), F.lit(0), lambda at, x: (at + x["gap"] + x["n"], at + x["gap"]), "array<int>")))

        def span(start, j):
            x = F.get(m, j)
            before = F.concat(F.coalesce(F.get(p, j - 1), empty), F.coalesce(F.get(m, j - 1), empty), F.get(p, j)) if r.candidates else None
            after = F.concat(F.get(p, j + 1), F.coalesce(F.get(m, j + 1), empty)) if r.candidates else None
            context = (F.when(j > 0, F.right(before, F.lit(LEFT))).otherwise(F.right(F.get(p, j), F.lit(LEFT))), F.substring(after, 1, RIGHT)) if r.candidates else (F.lit(None).cast("string"),) * 2
            return F.struct(start.alias("s"), (start + F.length(x)).cast("int").alias("e"), F.lit(i).alias("k"), x.alias("m"), r.ok(x, F.get(g, j)).alias("ok"), context[0].alias("l"), context[1].alias("r"))

        # The lambda is evaluated here, so the loop's names are those of this round.
        spans = F.transform(F.col(f"s_{i}"), span)
        df = df.withColumn(f"span_{i}", F.when((F.size(m) > 0) & (F.size(g) > 0), spans if r.candidates else F.filter(spans, lambda x: x["ok"])).otherwise(none))
    return df.drop(*(f"{x}_{i}" for x in "mpgsz" for i in range(len(rules))))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(df: DataFrame, text: str, spans: str, by: Callable[[Column], Column]) -> DataFrame:
    """df with each run of overlapping spans of the text replaced; spans: sorted by start; by: the placeholder of a run's first span.

    The text is cut into pages of PAGE code points first, so that a gap is read from the pages it touches, not from the text's start."""
    t, x = F.col(text), F.col(spans)
    step = lambda at, v: (F.greatest(at, v["e"]), F.when(v["s"] >= at, F.struct(at.alias("a"), v["s"].alias("b"), by(v).alias("by"))))
    last = lambda at: F.struct(at.alias("a"), F.length(t).alias("b"), F.lit("").alias("by"))
    df = df.withColumn("pages_", F.when(F.size(x) > 0, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))))
    df = df.withColumn("gaps_", F.when(F.size(x) > 0, fold(x, F.lit(0), step, "array<struct<a:int,b:int,by:string>>", last)))
    pages = F.col("pages_")

    def part(a: Column, b: Column) -> Column:
        first = F.floor(a / PAGE).cast("int")
        touched = F.array_join(F.slice(pages, first + 1, F.greatest(F.floor((b - 1) / PAGE).cast("int") - first + 1, F.lit(0))), "")
        return F.substring(touched, a - first * PAGE + 1, b - a)

    out = F.array_join(F.transform("gaps_", lambda v: F.concat(part(v["a"], v["b"]), v["by"])), "")
    return df.withColumn(text, F.when(F.size(pages) > 0, out).otherwise(t)).drop("pages_", "gaps_")
