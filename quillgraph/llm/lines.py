"""Line deduplication, exact and within a few edits, with built-in expressions alone.

Lines are parts of a text between newlines; all with a word take part.  Of equal lines, however short, the
first occurrence (by document id, null last, then place) stays.  Of lines within a few edits of each other
the one whose first occurrence comes first stays: a line goes if any line within that distance occurs before
it, so what stays never depends on the order of the work.  The distance is an edit per ``PER_EDIT`` code
points of the shorter line, ``EDITS`` at most: below ``PER_EDIT`` code points lines must be equal.

The near pairs come from a segment-partition join.  A line of length l is cut into EDITS + 1 segments; by the
pigeonhole principle a line within EDITS edits holds one of them unchanged, at a place that differs by no
more than the edits left.  Segments are indexed by length, number and content, the other line probes the
few substrings that can match, and candidates are verified by a banded bit-parallel edit distance: one
machine word holds the 2 * EDITS + 1 cells of a column's band.  Segments are taken from the line in four
bytes a code point, where a place is a byte offset.

Equal lines are one row before the join.  Lines that share a busy segment must agree in a sketch that no
pair within the bound can fail.  A segment that more than ``HOT`` lines share is not joined: the lines that
meet in it go on without it, as shorter strings under the same bound, and are cut again, until the parts
that tell them apart decide.  Nothing is capped: after ``DEPTH`` such rounds the rest is joined.

Null texts have no lines, empty ones a line without a word; a null id orders last.  Rows that agree in id and
text are one document: their lines stay together.  Very long texts and lines are worked on whole.  An empty
table gives an empty result, and extra columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import NULL_ID, Table, id_key, scratch, table
from quillgraph.llm.spans import let

EDITS, PER_EDIT = 2, 12
WORD = "[^\\x20\\x09-\\x0D]"
#: Lines that share a segment: up to BUSY they are joined as they are, beyond HOT the segment is refined.
BUSY, HOT, DEPTH = 4, 2048, 8


def document_key(id_col: str, text: Column) -> list[Column]:
    return [id_key(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")]


def occurrences(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, h, place, line: the lines with a word."""
    text = F.col(text_col).cast("string")
    lines = df.select(*document_key(id_col, text), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(WORD))


def line_key() -> list[Column]:
    """128 bits of a line."""
    return [F.xxhash64("line").alias("k0"), F.xxhash64(F.lit(77), "line", F.length("line")).alias("k1")]


def _entries(edits: int, probe: bool) -> list[tuple[int, int, int]]:
    """(delta, i, shift): segment i of a line shorter by delta, looked for with that shift.

    The shift is bounded by the edits on either side of the segment.
    """
    return [
        (delta, i, shift)
        for delta in (range(edits + 1) if probe else [0])
        for i in range(edits + 1)
        for shift in (range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1) if probe else [0])
    ]


def _place(edits: int, delta: int, i: int, shift: int) -> tuple[str, str]:
    """SQL of start and size of an entry in a string ``s`` of length ``n``; segments differ by one at most."""
    size = lambda j: f"((n - {delta} + {j}) div {edits + 1})"
    return " + ".join([*(size(j) for j in range(i)), f"{shift}"]), size(i)


def _keyed(rows: DataFrame, edits: int, probe: bool, *more: str) -> DataFrame:
    """``rows`` (g, lid, s, n) with ``keys``: a key per entry, null where the entry isn't within the string.

    Plain generated code, small enough to be compiled: the string is in UTF-32 (``u``), so that no entry is
    searched for by counting characters, and sizes of segments in bytes (``z0`` and so on for the lengths
    n - edits, ..., n + edits over the number of segments) and hashes of group and length are columns.
    """
    entries = _entries(edits, probe)
    sizes = [F.expr(f"int(4 * ((n + {m}) div {edits + 1}))").alias(f"z{m + edits}") for m in range(-edits if probe else 0, edits + 1)]
    lengths = [F.expr(f"xxhash64(g, n - {delta})").alias(f"h{delta}") for delta in sorted({e[0] for e in entries})]
    base = rows.select("lid", *more, "n", F.encode("s", "UTF-32").alias("u"), F.expr("4 * n").alias("bytes"), *sizes, *lengths)
    out = []
    for delta, i, shift in entries:
        size = lambda j: f"z{j - delta + edits}"  # noqa: B023, E731
        start = " + ".join([*map(size, range(i)), str(4 * shift + 1)])
        key = f"xxhash64(h{delta}, {i}, substring(u, {start}, {size(i)}))"
        inside = [f"n > {delta}"] * (delta > 0) + [f"{start} > 0"] * (shift < 0) + [f"{start} + {size(i)} <= bytes + 1"] * (shift > delta)
        out.append(f"if({' and '.join(inside)}, {key}, null)" if inside else key)
    return base.select("lid", *more, "n", F.expr(f"array({', '.join(out)})").alias("keys"))


def _exploded(keyed: DataFrame) -> DataFrame:
    """lid, key.  The outer form keeps Spark from testing the array's size, which would make all keys twice."""
    return keyed.select("lid", F.explode_outer("keys").alias("key")).where("key is not null")


def _without(edits: int, probe: bool) -> Column:
    """``s`` without the part that entry number ``e`` names."""
    out = "null"
    for k, (delta, i, shift) in enumerate(_entries(edits, probe)):
        start, size = _place(edits, delta, i, shift)
        out = f"if(e = {k}, concat(substring(s, 1, int({start})), substring(s, int({start} + {size} + 1))), {out})"
    return F.expr(out)


def _parities(s: str) -> Column:
    """Two words of 64 bits: parities of the counts of a string's characters and of its bigrams.

    An edit changes at most two bits of the first and four of the second, so strings within ``edits`` edits
    differ in no more than that many times ``edits`` bits.
    """
    flip = lambda word, place: word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
    zero = F.lit(0).cast("long")

    def both(chars: Column) -> Column:
        single = F.aggregate(chars, zero, lambda w, c: flip(w, F.ascii(c) % 64))
        pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(64)))
        return F.struct(single.alias("one"), F.aggregate(pairs, zero, flip).alias("two"))

    return let(F.split(s, ""), both)


def near_candidates(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: pairs of line numbers that share a segment as lines within ``edits`` edits do.

    ``lines`` has lid and line, no two equal.  A segment that few lines share is joined as it is.  Where
    more share one, what meets must also agree in the parities of its characters and bigrams, a necessary
    condition, before it is a pair.  A segment that more than ``HOT`` lines share is not joined: its lines
    go on without it and are cut again.
    """
    # the null test, which the joins imply for one side alone, keeps both uses of the probes one exchange
    cut = lines.where("lid is not null").select(F.lit(0).cast("long").alias("g"), "lid", F.col("line").alias("s"), F.length("line").alias("n"))
    rows = {False: cut, True: cut}
    pairs = []
    for depth in range(DEPTH + 1):
        keyed = {probe: _exploded(_keyed(rows[probe], edits, probe)) for probe in rows}
        index = Table(keyed[False], "line-index")
        busy = Table(index.df().groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BUSY), "line-busy")
        # the probes are dealt by key once, for both joins: the second asks for no broadcast, so that it shares
        a = index.df().join(busy.small(), "key", "left_anti").select("key", F.col("lid").alias("a"))
        probe = keyed[True]
        few = a.join(probe.hint("merge"), "key").where("a <> lid").select("a", F.col("lid").alias("b"), F.lit(None).cast("long").alias("key"))
        hits = probe.join(busy.df().select("key").hint("merge"), "key", "left_semi").select(F.lit(None).cast("long").alias("a"), F.col("lid").alias("b"), "key") if busy.rows() else None
        met = Table(few.unionByName(hits) if hits is not None else few, "line-met")
        pairs.append(met.df().where("key is null").select("a", "b"))
        if hits is None:
            break
        most = HOT if depth < DEPTH else 1 << 62
        held = index.df().join(busy.small(), "key").select("key", "m", F.col("lid").alias("a"))
        asked = met.df().where("key is not null").join(busy.small(), "key").select("key", "m", "b")
        some = {False: held.withColumnRenamed("a", "lid"), True: asked.withColumnRenamed("b", "lid")}
        known = {}
        for probe_side, df in some.items():
            wanted = Table(df.where(F.col("m") <= most).select("lid").distinct(), "line-some")
            known[probe_side] = Table(lines.join(wanted.small(), "lid", "left_semi").select("lid", _parities("line").alias("w")), "line-parities")
        x = some[False].where(F.col("m") <= most).join(known[False].df(), "lid").select("key", F.col("lid").alias("a"), F.col("w.one").alias("a1"), F.col("w.two").alias("a2"))
        y = some[True].where(F.col("m") <= most).join(known[True].df(), "lid").select("key", F.col("lid").alias("b"), F.col("w.one").alias("b1"), F.col("w.two").alias("b2"))
        near = (F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= 2 * edits) & (F.bit_count(F.col("a2").bitwiseXOR(F.col("b2"))) <= 4 * edits)
        pairs.append(x.join(y, "key").where((F.col("a") != F.col("b")) & near).select("a", "b"))
        hot = Table(busy.df().where(F.col("m") > most).select("key"), "line-hot")
        if not hot.rows():
            break
        for side, df in some.items():
            # a line has a row per group that it is in; its key tells which of them an entry came from
            mine = rows[side].join(Table(df.where(F.col("m") > most).select("lid").distinct(), "line-mine").small(), "lid", "left_semi")
            again = _keyed(mine, edits, side, "s").select("lid", "s", "n", F.posexplode_outer("keys").alias("e", "key")).join(hot.small(), "key", "left_semi")
            rest = again.select(F.col("key").alias("g"), "lid", _without(edits, side).alias("s")).distinct()
            rows[side] = Table(rest.withColumn("n", F.length("s")), "line-rest").df()
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(x: Column, y: Column, side: Callable[[Column, Column], Column]) -> Column:
    """Code points that the two strings share at one side, by halving steps of whole comparisons."""

    def step(n: Column, more: Column) -> Column:
        to = n + more
        return F.when((to <= F.length(x)) & (to <= F.length(y)) & (side(x, to) == side(y, to)), to).otherwise(n)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(24, -1, -1))), F.lit(0), step)


def within(x: Column, y: Column, edits: int = EDITS) -> Column:
    """Whether two strings, the first the longer by at most ``edits``, are within ``edits`` edits.

    What the strings share at both ends is taken off first.  Of the rest, a column of the distance table
    is a word that holds the cells of its band: bit k of column j is row j - edits + k.  ``vp`` and ``vn``
    say where a cell is one above or one below the cell over it.  The distance is followed down the
    band's lowest diagonal to the last row and then along that row; columns beyond help are not worked on.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    lit = lambda v: F.lit(v).cast("int")
    inv = lambda v: v.bitwiseXOR(lit(ones))
    half = lambda v: F.shiftright(v, 1)
    pair = lambda a, b: F.struct(a.alias("x"), b.alias("y"))

    def without_head(z: Column) -> Column:
        return let(_common(z["x"], z["y"], F.left), lambda n: pair(F.substring(z["x"], n + 1, F.length(z["x"])), F.substring(z["y"], n + 1, F.length(z["y"]))))

    def without_tail(z: Column) -> Column:
        return let(_common(z["x"], z["y"], F.right), lambda n: pair(F.left(z["x"], F.length(z["x"]) - n), F.left(z["y"], F.length(z["y"]) - n)))

    def banded(z: Column) -> Column:
        """z: p (characters of the longer), t (of the shorter), m and n (their numbers)."""
        p, m, n = z["p"], z["m"], z["n"]

        def mask(c: Column, j: Column) -> Column:
            """Which of the band's rows hold the character."""
            bit = lambda k: F.when((j + (k - edits) >= 0) & (F.get(p, j + (k - edits)) == c), lit(1 << k)).otherwise(lit(0))
            return sum((bit(k) for k in range(width)), lit(0))

        def step(acc: Column, c: Column) -> Column:
            vp, vn, d, j = (acc[k] for k in ("vp", "vn", "d", "j"))

            def diagonal(v: Column) -> Column:
                carried = (v.bitwiseAND(vp) + vp).bitwiseAND(lit(ones))
                return carried.bitwiseXOR(vp).bitwiseOR(v).bitwiseOR(vn)

            def after(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                last = m - edits  # from this column on, the last row is within the band
                at = lambda v: F.call_function("shiftright", v, width - 2 - (j - last)).bitwiseAND(lit(1))
                down = d + (lit(1) - F.shiftright(d0, width - 1))
                return F.struct(
                    hn.bitwiseOR(inv(half(d0).bitwiseOR(hp))).alias("vp"),
                    half(d0).bitwiseAND(hp).alias("vn"),
                    F.when(j < last, down).otherwise(d + at(hp) - at(hn)).cast("int").alias("d"),
                    (j + 1).cast("int").alias("j"),
                )

            return F.when(d > 2 * edits + n - m, acc).otherwise(let(let(mask(c, j), diagonal), after))

        start = F.struct(lit(ones ^ ((1 << edits) - 1)).alias("vp"), lit(0).alias("vn"), lit(edits).alias("d"), lit(0).alias("j"))
        return F.when(m <= edits, F.lit(True)).otherwise(F.aggregate(z["t"], start, step)["d"] <= edits)

    def split(z: Column) -> Column:
        none = F.array().cast("array<string>")
        chars = lambda v: F.when(F.length(v) > 0, F.split(v, "")).otherwise(none)
        return F.struct(chars(z["x"]).alias("p"), chars(z["y"]).alias("t"), F.length(z["x"]).alias("m"), F.length(z["y"]).alias("n"))

    return let(let(let(let(pair(x, y), without_head), without_tail), split), banded)


def near(x: Column, y: Column, edits: int = EDITS, per_edit: int = PER_EDIT) -> Column:
    """Whether two lines are within the edits that the shorter one's length allows."""
    swap = F.length(x) < F.length(y)
    longer, shorter = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    apart, least = F.abs(F.length(x) - F.length(y)), F.least(F.length(x), F.length(y))
    out = F.when((least >= edits * per_edit) & (apart <= edits), within(longer, shorter, edits))
    for e in range(edits - 1, 0, -1):
        out = out.when((least >= e * per_edit) & (least < (e + 1) * per_edit) & (apart <= e), within(longer, shorter, e))
    return out.otherwise(F.lit(False))


def near_links(lines: Table, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """a, b: line numbers of distinct lines within the edits allowed; verified one pair at a time."""
    long_enough = lines.df().where(F.length("line") >= max(per_edit, edits + 1))
    with scratch() as keep:
        pairs = keep(Table(near_candidates(long_enough, edits), "line-pairs"))
    wanted = Table(pairs.df().select(F.explode(F.array("a", "b")).alias("lid")).distinct(), "line-wanted")
    texts = Table(lines.df().select("lid", "line").join(wanted.small(), "lid", "left_semi"), "line-texts").df()
    both = pairs.df().join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    return both.where(near(F.col("x"), F.col("y"), edits, per_edit)).select("a", "b")


def removals(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """id, h, exact, near: per document that loses lines, their places (from 0).

    Shuffles: the lines once, combined by content first; three to twelve pairs of longs a distinct line for
    the segments; then only keys of lines that repeat.
    """
    placed = occurrences(df, text_col, id_col)
    once = placed.groupBy(*line_key()).agg(F.min(F.struct("id", "h", "place")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    with scratch() as keep:
        lines = Table(once.withColumn("lid", F.monotonically_increasing_id()), "lines")  # writing settles the numbers
        links = Table(near_links(lines, edits, per_edit), "line-links")
        # a line goes if a linked one first occurs before it
        place = lines.df().select("lid", "first")
        a, b = (place.select(F.col("lid").alias(x), F.col("first").alias(f"f{x}")) for x in ("a", "b"))
        ends = links.df().join(a, "a").join(b, "b")
        later = ends.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("lid")).distinct()
        gone = keep(Table(lines.df().select("lid", "k0", "k1", "first", "n").join(later.withColumn("near", F.lit(True)), "lid", "left").where("n > 1 or near").select("k0", "k1", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-gone"))
    every = placed.select("id", "h", "place", *line_key())
    hit = every.join(gone.small(), ["k0", "k1"]).where(F.col("near") | (F.struct("id", "h", "place") != F.col("first")))
    places = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("place"))))
    return hit.select("id", "h", "place", "near").distinct().groupBy("id", "h").agg(places(~F.col("near")).alias("exact"), places(F.col("near")).alias("near"))


def remove_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """The input with its repeated lines removed; documents that lose their last words go.

    Only the documents that lose lines are joined if their number is within the broadcast bound.
    """
    gone = Table(removals(df, text_col, id_col, edits, per_edit).select("id", "h", F.concat("exact", "near").alias("gone")), "line-removals")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *document_key(id_col, F.col(text_col).cast("string")))
    text = F.col("row")[text_col].cast("string")
    # places as a map, so that the filter is linear in the lines
    flags = F.map_from_arrays(F.array_distinct(F.col("gone")), F.transform(F.array_distinct(F.col("gone")), lambda _: F.lit(True)))
    left = let(flags, lambda g: F.filter(F.split(text, "\n"), lambda x, i: F.try_element_at(g, i).isNull()))
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    out = rows.join(gone.small(), ["id", "h"], "left").withColumn("clean", clean).where(F.col("gone").isNull() | F.col("clean").rlike(WORD))
    return out.select(*((F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines that take part, lines removed as exact and as near repeats, their places."""
    docs = table(spark, sf_dir, "documents")
    gone = Table(removals(docs), "line-removals")
    text = F.col("text").cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = docs.select(*document_key("doc_id", text), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(gone.small(), ["id", "h"], "left")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    none = F.array().cast("array<int>")
    removed = F.array_sort(F.concat(F.coalesce("exact", none), F.coalesce("near", none)))
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_lines", size("exact").alias("n_exact"), size("near").alias("n_near"), F.array_join(removed, ",").alias("removed"))
