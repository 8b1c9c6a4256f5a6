"""Native span search: where a pattern matches, in code points, with built-in expressions alone.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern what lies between them, so
running sums of the pieces' and matches' lengths are the positions.  Patterns only differ from the plain
ones in possessive quantifiers and look-behinds, which change no match but keep the search linear and
free of recursion on texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lens: Column, levels: int = 3) -> Column:
    """Sums of the elements before each one.

    An element's sum is that of the blocks of 16 before its own, found likewise level by level, plus that of
    its block's earlier elements, so the work is linear in arrays of any length that a text can give.
    """
    block = 16
    none = F.array().cast("array<bigint>")
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def short(lens: Column) -> Column:
        return F.transform(lens, lambda _, i: total(F.slice(lens, 1, i)))

    def long(lens: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), lambda k: total(F.slice(lens, k * block + 1, block)))
        within = lambda s: F.transform(lens, lambda _, i: F.get(s, F.floor(i / block).cast("int")) + total(F.slice(lens, (i - i % block) + 1, i % block)))
        return let(prefix_sums(blocks, levels - 1), within)

    if not levels:
        return let(lens, lambda x: F.when(F.size(x) == 0, none).otherwise(short(x)))
    return let(lens, lambda x: F.when(F.size(x) == 0, none).when(F.size(x) <= block, short(x)).otherwise(long(x)))


def with_spans(df: DataFrame, name: str, text: str, pattern: str, may_match: Column, ok: Callable[[Column, Column], Column] | None = None, group: int | None = None) -> DataFrame:
    """Adds ``name``: the spans of ``pattern`` in ``text``, leftmost and non-overlapping.

    Each is a struct of start, end, value, grp.  ``may_match`` is a cheap necessary condition.
    ``ok(value, group)`` keeps a match or drops it without a retry.
    """
    none = F.array().cast("array<string>")
    m = f"__{name}_m"
    df = df.withColumn(m, F.when(may_match, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    groups = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else F.col(m)

    def spans(pieces: Column) -> Column:
        before = F.slice(pieces, 1, F.size(m))
        sums = prefix_sums(F.zip_with(before, F.col(m), lambda a, b: (F.length(a) + F.length(b)).cast("long")))
        rows = F.arrays_zip(F.col(m).alias("m"), groups.alias("g"), sums.alias("s"), before.alias("p"))
        return F.transform(rows, struct)

    def struct(z: Column) -> Column:
        at, value, piece = (z[i] for i in ("s", "m", "p"))
        start = at + F.length(piece)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), z["g"].alias("grp"))

    empty = "array<struct<start:bigint,end:bigint,value:string,grp:string>>"
    found = F.when(F.size(m) > 0, let(F.split(F.col(text), pattern, -1), spans)).otherwise(F.array().cast(empty))
    if ok is not None:
        found = F.filter(found, lambda s: ok(s["value"], s["grp"]))
    return df.withColumn(name, found).drop(m)


def tagged(spans: Column, order: int, kind: str) -> Column:
    """Spans as structs that sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


NO_TAGGED = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"
