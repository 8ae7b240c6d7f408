"""Line dedup across documents: exact lines, and lines within a few edits by a segment-partition join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh
from fieldloom.session import materialize, new_folder, table_name

# Shortest line (code points) that is compared at all, and by the shorter
# line's length the edits allowed: one from 32 code points, two from 64.
MIN_CHARS = 16
EDITS_FROM = {1: 32, 2: 64}
#: Lines whose lengths share a class have segments of the same sizes; divides the lengths above.
CLASS = 16


def _edits(length: str) -> str:
    """SQL for the edits that a line of this length allows."""
    return f"(if({length} >= {EDITS_FROM[1]}, 1, 0) + if({length} >= {EDITS_FROM[2]}, 1, 0))"


def _key(number: str, edits: int, i: int, shift: int = 0) -> str:
    """SQL for the hash of segment ``i`` of ``edits + 1`` of lines of a length class.

    All segments but the last are counted from the line's start, moved by ``shift``, and the
    last from its end; together they are as long as the shortest line of the class, so what
    a longer line has more lies before its last segment.
    """
    base = f"({number} * {CLASS})"
    size = f"({base} div {edits + 1})"
    if i < edits:
        part = f"substring(line, {i} * {size} + {1 + shift}, {size})"
    else:
        part = f"right(line, {base} - {edits} * {size})"
    return f"xxhash64({part}, {number}, {i})"


def _segments() -> str:
    """SQL array of what a line is found by and looks up, its ``edits + 1`` own segments first.

    It looks for lines as long or up to ``edits`` shorter. Of a line and one within its edits,
    some segment i (from 0) stays whole with at most i edits before it and ``edits - i``
    after it. So the first is found in place, the last at the end, and the one between at
    shifts of at most one that leave one edit for the rest. Lengths of one class share
    look-ups, and those in place are the line's own segments; most lines need the next class
    not at all. Plain arrays stay in generated code, which a filter with a lambda would leave.
    """

    def looked_up(number: str, e: int, least_gap: int) -> list[str]:
        keys = []
        for i in range(e + 1):
            shifts = {0}
            if 0 < i < e:
                shifts = {s for g in range(least_gap, e + 1) for s in range(-i, i + 1) if abs(g - s) <= e - i}
            keys += [_key(number, e, i, s) for s in sorted(shifts)]
        return keys

    # Differences in length that stay in the line's class, then those that leave it.
    inside, below = [], []
    for e, least in EDITS_FROM.items():
        own = [_key("class", e, i) for i in range(e + 1)]
        shifted = [key for key in looked_up("class", e, 0) if key not in own]
        inside.append(f"when edits = {e} then array({', '.join(own + shifted)})")
        number = "(class - 1)"
        high = f" and {number} * {CLASS} < {EDITS_FROM[e + 1]}" if e + 1 in EDITS_FROM else ""
        below += [
            f"when {number} * {CLASS} >= {least}{high} and length % {CLASS} = {d - 1} then array({', '.join(looked_up(number, e, d))})"
            for d in range(1, e + 1)
        ]
    none = "else cast(array() as array<bigint>) end"
    return f"concat(case {' '.join(inside)} {none}, case {' '.join(below)} {none})"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and gives it a name in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _common_prefix(a: str, b: str) -> str:
    """SQL for the length of the common prefix, by halving steps."""
    shorter = f"least(length({a}), length({b}))"
    return (
        f"aggregate(sequence(cast(floor(log2(greatest(1, {shorter}))) as int), 0, -1), 0, (p, k) -> if(shiftleft(1, k) <= {shorter} - p"
        f" and left({a}, p + shiftleft(1, k)) = left({b}, p + shiftleft(1, k)), p + shiftleft(1, k), p))"
    )


def banded_edits(x: str, y: str, edits: int) -> str:
    """SQL for the edits between two arrays, ``y`` no shorter, if at most ``edits``.

    One bit-parallel step per element of ``y`` on the 2 * edits + 1 rows around the
    diagonal: the vertical differences are two bit sets that move down one row a step.
    Above ``edits`` the value is only some larger number. Both arrays end with ``edits``
    equal marks, so the band never runs past a short array.
    """
    width, top = 2 * edits + 1, 1 << (2 * edits)
    full = (1 << width) - 1
    same = " | ".join(f"if(coalesce(get({x}, t.j + {k - edits}) = c, false), {1 << k}, 0)" for k in range(width))
    # Column t.j + 1 is worked on; the last row of x is bit size(x) - (t.j + 1) + edits.
    last = f"shiftleft(1, cast(size({x}) - t.j - 1 + {edits} as int))"
    distance = f"if(t.j + 1 + {edits} <= size({x}), t.d + if(d0 & {top} = 0, 1, 0), t.d + if(h.p & {last} = 0, 0, 1) - if(h.n & {last} = 0, 0, 1))"
    step = (
        f"named_struct('j', t.j + 1, 'd', {distance},"
        f" 'p', (h.n | (~(shiftright(d0, 1) | h.p))) & {full}, 'n', shiftright(d0, 1) & h.p)"
    )
    step = _let(f"named_struct('p', (t.n | (~(d0 | t.p))) & {full}, 'n', d0 & t.p)", "h", step)
    step = _let(f"((((s & t.p) + t.p) ^ t.p) | s | t.n) & {full}", "d0", step)
    step = _let(same, "s", step)
    first = f"named_struct('j', 0, 'd', {edits}, 'p', {full & ~((1 << edits) - 1)}, 'n', 0)"
    return f"aggregate({y}, {first}, (t, c) -> if(t.d > {2 * edits} + size({y}) - size({x}), t, {step}), t -> t.d)"


def within_edits(shorter: str, longer: str, edits: str) -> str:
    """SQL: whether two texts are within ``edits`` (1 or 2) of each other.

    Common ends are taken off first. It is one expression with every step named inside,
    since projections before a filter would be written out again wherever they are used.
    """

    def distance(e: int) -> str:
        chars = lambda v: f"concat(if(q = length(v.{v}), array(), split(substring(v.{v}, q + 1), '')), array_repeat('\\n', {e}))"
        inner = _let(f"named_struct('x', {chars('a')}, 'y', {chars('b')})", "w", banded_edits("w.x", "w.y", e))
        inner = _let(_common_prefix("v.a", "v.b"), "q", inner)
        rest = f"named_struct('a', reverse(substring({shorter}, o + 1)), 'b', reverse(substring({longer}, o + 1)))"
        return _let(_common_prefix(shorter, longer), "o", _let(rest, "v", inner))

    cases = " ".join(f"when {edits} = {e} then {distance(e)} <= {e}" for e in EDITS_FROM)
    return f"case {cases} else false end"


def _lines(rows: DataFrame) -> DataFrame:
    """Every line of (row, doc_id, text) with its place, length and hash."""
    return rows.selectExpr("row", "doc_id", "posexplode(split(text, '\\n', -1)) as (pos, raw)").selectExpr(
        "row", "doc_id", "pos", "btrim(raw, ' \\t\\r') as line"
    ).selectExpr("row", "doc_id", "pos", "line", "length(line) as chars", "xxhash64(line) as key")


def _place():
    """Where a line stands: in the order of doc_id (null last), row and position."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(key, first, times, line, length, class, edits) per different line, bucketed by key.

    It is kept as a bucketed table in the shared folder: the joins by key that follow read
    it bucket by bucket and do not move the texts again.
    """
    spark = lines.sparkSession
    texts = (
        lines.where(f"chars >= {MIN_CHARS}")
        .groupBy("key")
        .agg(F.min(_place()).alias("first"), F.count("*").alias("times"), F.first("line").alias("line"))
        .withColumn("length", F.length("line"))
        .withColumn("class", F.expr(f"length div {CLASS}"))
        .withColumn("edits", F.expr(_edits("length")))
    )
    path = new_folder(spark, "distinct-lines")
    name = table_name(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = texts.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "key").sortBy("key")
    writer.saveAsTable(name)
    return spark.table(name)


def removed_lines(light: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, pos, chars, near) of the lines to remove, from (row, doc_id, pos, chars, key).

    A line goes if the same line stands earlier, or (``near``) if it is the first of its
    kind and a line within the edits stands earlier.
    """
    near = near_lines(texts.where("edits > 0"))
    flags = texts.select("key", "first", "times").join(near, "key", "left").where("times > 1 or near")
    flags = materialize(flags.select("key", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-flags")
    found = light.where(f"chars >= {MIN_CHARS}").join(flags, "key").withColumn("is_first", F.col("first") == _place())
    return found.where("near or not is_first").select("row", "pos", "chars", F.col("is_first").alias("near"))


# Letters that are counted to rule pairs out; an edit moves two counts by one at most.
LETTERS = "etnaohirs"


def _met(texts: DataFrame) -> DataFrame:
    """(key, segment, short, long) of the segments by which a line meets another one.

    ``short``: it is the line's own and another line looks it up; ``long``: the line looks it
    up and it is another's own. A line looks up all its own segments, so both follow from the
    least and the largest key that a segment has among its own and among all. The segments
    are made and moved once, and both the keys and the lines are read from that.
    """
    rows = texts.selectExpr("key", "edits", f"posexplode({_segments()}) as (place, segment)")
    rows = rows.selectExpr("key", "segment", "place <= edits as own").repartition("segment")
    ends = rows.groupBy("segment").agg(
        F.expr("min(key) filter (where own)").alias("own_low"), F.expr("max(key) filter (where own)").alias("own_high"),
        F.min("key").alias("low"), F.max("key").alias("high"),
    )
    # One row per segment, so a hot segment's rows run past it and are never held. Only under a
    # merge join are both reads of the bucketed lines planned alike, so that one shuffle serves both.
    ends = ends.where("own_low is not null and low < high").hint("merge")
    found = rows.join(ends, "segment").selectExpr(
        "key", "segment", "own and (low <> key or high <> key) as short", "own_low <> key or own_high <> key as long"
    )
    return found.where("short or long")


def near_lines(texts: DataFrame) -> DataFrame:
    """(key, near = true) of the distinct lines within the edits of an earlier one.

    Lines that share a segment with no other are ruled out before any text is moved. The
    rest is compared segment by segment in semi joins: a line needs one earlier partner,
    so no pairs are made, however many lines share a segment.
    """
    met = materialize(_met(texts), "line-segments")
    short, long = (met.where(side).select("key", "segment") for side in ("short", "long"))
    some = met.select("key").distinct()
    facts = materialize(texts.join(some.hint("merge"), "key").select("key", "first", "line", "length", "edits"), "line-texts")
    counts = ", ".join(f"length - length(replace(line, '{c}', ''))" for c in LETTERS)
    facts = facts.selectExpr("*", f"array({counts}) as counts")
    # By the size of a packed file Spark would broadcast far more rows than it takes them for.
    short, long = (side.join(facts.hint("merge"), "key") for side in (short, long))
    apart = "aggregate(zip_with(s.counts, l.counts, (x, y) -> abs(x - y)), 0, (t, v) -> t + v) <= 2 * s.edits"
    linked = f"{apart} and {within_edits('s.line', 'l.line', 's.edits')}"

    def later(rows, a, others, b, least):
        when = f"s.segment = l.segment and {b}.first < {a}.first and l.length - s.length between {least} and s.edits and {linked}"
        return rows.alias(a).join(others.alias(b), F.expr(when), "left_semi").select("key")

    found = later(long, "l", short, "s", 0).union(later(short, "s", long, "l", 1))
    return found.distinct().withColumn("near", F.lit(True))


def _rows(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    return docs.selectExpr(f"`{row}` as row", f"cast(`{id_col}` as bigint) as doc_id", f"coalesce(cast(`{text_col}` as string), '') as text")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its lines, those removed as exact and as near repeats, and what stays.

    A line (white space at its ends aside) of at least ``MIN_CHARS`` code points is removed
    if the same line or, as far as its length allows edits, one within so many edits comes
    earlier, in the order of doc_id and position. Shorter lines always stay. Lines are the
    same if their 64-bit hashes are. A null text has one empty line; null ids come last;
    repeated rows come one after another, so all but the first lose their lines; other
    columns are ignored; an empty table gives an empty one.
    """
    marked = docs.withColumn(fresh(docs, "row"), F.monotonically_increasing_id())
    lines = _lines(_rows(marked, id_col, text_col, marked.columns[-1]))
    light = materialize(lines.drop("line"), "lines")
    gone = removed_lines(light, distinct_lines(lines)).groupBy("row").agg(
        F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"), F.sum("chars").alias("gone_chars"), F.sum("pos").alias("gone_places")
    )
    whole = light.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.sum("chars").alias("chars"), F.sum("pos").alias("places"))
    return whole.join(gone, "row", "left").na.fill(0, ["n_exact", "n_near", "gone_chars", "gone_places"]).selectExpr(
        "doc_id", "n_lines", "n_exact", "n_near", "chars - gone_chars as kept_chars", "places - gone_places as kept_places"
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all columns, without the lines that ``line_report`` counts as removed."""
    row = fresh(docs, "row")
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    lines = _lines(_rows(marked, id_col, text_col, row))
    gone = removed_lines(materialize(lines.drop("line"), "lines"), distinct_lines(lines))
    mark = fresh(marked, "gone")
    # Places as keys of a sorted run: a line is out if its place is in the list.
    lists = gone.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("pos")).alias(mark))
    joined = marked.join(lists, row, "left")
    split = f"split(`{text_col}`, '\\n', -1)"
    stay = f"array_except(sequence(0, size({split}) - 1), `{mark}`)"
    text = f"array_join(transform(array(named_struct('parts', {split}, 'stay', {stay})), w -> array_join(transform(w.stay, i -> w.parts[i]), '\\n')), '')"
    return joined.withColumn(text_col, F.expr(f"if(`{mark}` is null, `{text_col}`, {text})")).select(*docs.columns)


ORACLE = r"""
with lines as (
  select doc_id, pos, trim(raw, ' ' || chr(9) || chr(13)) as line from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw,
      unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)),
texts as (
  select line, min((doc_id, pos)) as first, length(line) as size from lines where length(line) >= 16 group by line),
near as (
  select distinct b.line from texts a join texts b on a.size between b.size - 2 and b.size + 2 and a.first < b.first
    and least(a.size, b.size) >= 32 and levenshtein(a.line, b.line) <= if(least(a.size, b.size) >= 64, 2, 1)),
marked as (
  select l.doc_id, l.pos, length(l.line) as chars, coalesce((l.doc_id, l.pos) > t.first, false) as is_exact,
    coalesce((l.doc_id, l.pos) = t.first and l.line in (select line from near), false) as is_near
  from lines l left join texts t on l.line = t.line)
select doc_id, count(*) as n_lines, count(*) filter (is_exact) as n_exact, count(*) filter (is_near) as n_near,
  cast(coalesce(sum(chars) filter (not is_exact and not is_near), 0) as bigint) as kept_chars,
  cast(coalesce(sum(pos) filter (not is_exact and not is_near), 0) as bigint) as kept_places
from marked group by doc_id
"""
