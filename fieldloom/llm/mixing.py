"""Mixing sources to target weights: hash-random keys, prefix sums per source, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh
from fieldloom.operators.ordering import Running, with_running
from fieldloom.session import materialize

# Weights of the sources by code point, the words of the mix and the most
# of a source, as halves of all words and of the source's.
WEIGHTS = (5, 2, 1)
MIX_HALVES = 3
MOST_TIMES = 2
SEED = "mix"
#: Rows of a source that one range of keys holds about.
RANGE_ROWS = 4_000
#: Sources up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000

_SIZE = r"coalesce(regexp_count({}, '[^\\x20\\x09-\\x0D]+'), 0)"


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """Light rows: id, source, size and a 60-bit random key from seed, id, text (and row)."""
    text = f"coalesce(cast(`{text_col}` as string), '')"
    row = f"cast(`{row_col}` as bigint)" if row_col else "cast(0 as bigint)"
    seed = f"concat('{SEED}:', coalesce(cast(`{id_col}` as string), ''), ':', cast({row} as string), ':', {text})"
    return docs.selectExpr(
        f"cast(`{id_col}` as bigint) as doc_id",
        f"cast(`{source_col}` as string) as source",
        f"cast({_SIZE.format(text)} as bigint) as size",
        f"cast(conv(substr(md5({seed}), 1, 15), 16, 10) as bigint) as key",
        f"{row} as row",
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source its words, rows, weight and target.

    Targets share the mix by weight; a source stops at its most, and what it leaves is
    shared anew. Sources by words per weight reach their most one after another, so one
    running sum over the table of sources (one row each) finds the last that does. Numbers
    and sums run over chunks, since there may be a source per document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    weights = ", ".join(map(str, WEIGHTS))
    named = per.selectExpr("*", "source is null as none")
    numbered = with_running(named, [], ["none", "source"], {"number": Running("number")})
    placed = numbered.selectExpr("source", "words", "rows", "number - 1 as place").selectExpr(
        "*", f"element_at(array({weights}), cast(place % {len(WEIGHTS)} + 1 as int)) as weight"
    ).selectExpr("*", "words / weight as share")
    sums = with_running(placed, [], ["share", "place"], {"words_to": Running("sum", "words"), "weight_to": Running("sum", "weight")})
    totals = placed.agg(F.sum("words").alias("all_words"), F.sum("weight").alias("all_weight"))
    running = sums.crossJoin(F.broadcast(totals)).selectExpr(
        "*", "all_weight - weight_to + weight as weight_after", f"{MIX_HALVES} * all_words - {2 * MOST_TIMES} * (words_to - words) as halves_left"
    ).selectExpr("*", f"{2 * MOST_TIMES} * words * weight_after <= weight * halves_left as full")
    rest = running.crossJoin(F.broadcast(running.where("not full").agg(F.max("halves_left").alias("halves"), F.max("weight_after").alias("weights"))))
    return rest.selectExpr(
        "source", "place", "words", "rows",
        f"if(full, cast({MOST_TIMES} * words as double), cast(weight * halves as double) / (2 * weights)) as target",
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Per document its size, its source's words and target, and the words the mix takes.

    Keys are uniform, so equal ranges of the key space, more of them for a larger source,
    are the range partitions of its random order; a hot source is as many groups as its
    rows need. Words before each range come from a running sum over the ranges, words
    before a document from one inside its range. A source is repeated whole as often as its
    target holds it, and the rest is cut at the word in random order.

    A null text has size 0 and takes nothing; a null source is a source, after all
    others; null ids stay; repeated rows are one group while sums are built, then rows again,
    each with its own cut; other columns are ignored; an empty table gives an empty one.
    ``row_col`` may name a column that tells rows apart, which is then returned as ``row``.
    """
    sized = materialize(_sized(docs, id_col, source_col, text_col, row_col), "sized")
    sources = materialize(source_targets(sized), "sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    same = sized.groupBy("source", "key", "doc_id", "row", "size").agg(F.count("*").alias("copies"))
    placed = same.join(sources, same.source.eqNullSafe(sources.source)).drop(sources.source).withColumn(
        "range", F.expr(f"least(ceil(rows / {RANGE_ROWS}) - 1, cast(floor(key / power(2D, 60) * ceil(rows / {RANGE_ROWS})) as bigint))")
    )
    ranges = placed.groupBy("place", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_words"))
    starts = ranges.selectExpr("place", "range", "sum(range_words) over (partition by place order by range) - range_words as range_start")
    inside = Window.partitionBy("place", "range").orderBy("key", "doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.join(starts, ["place", "range"]).withColumn(
        "start", F.col("range_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    )
    single = ordered.selectExpr("*", "explode(sequence(cast(0 as bigint), copies - 1)) as copy").selectExpr(
        "*", "start + copy * size as at", "if(words = 0, 0, cast(floor(target) as bigint) div words) as epochs"
    )
    return single.selectExpr(
        "doc_id", "size", "words as source_size", "target",
        "epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * words - at)) as taken",
        "source", *(["row"] if row_col else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix as whole documents with all columns, each as often as it is taken.

    The document on a source's cut stays if at least half of it is inside; documents
    without words stay out.
    """
    row = fresh(docs, "row")
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    taken = mix(marked, id_col, source_col, text_col, row)
    times = taken.where("size > 0 and 2 * taken >= size").selectExpr(f"row as `{row}`", "(2 * taken + size) div (2 * size) as times_taken")
    n = fresh(marked, "times_taken")
    joined = marked.join(times.withColumnRenamed("times_taken", n), row)
    return joined.withColumn(n, F.explode(F.expr(f"sequence(cast(1 as bigint), `{n}`)"))).select(*docs.columns)


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':0:' || coalesce(text, '')), 1, 15) as bigint) as key
  from documents),
per as (
  select source, cast(sum(size) as bigint) as words, row_number() over (order by source nulls last) - 1 as place
  from sized group by source),
weighed as (select *, [5, 2, 1][cast(place % 3 + 1 as int)] as weight from per),
running as (
  select *, sum(words) over () as all_words,
    coalesce(sum(words) over (order by words / weight, place rows between unbounded preceding and 1 preceding), 0) as words_before,
    sum(weight) over (order by words / weight, place rows between current row and unbounded following) as weight_after
  from weighed),
marked as (select *, 4 * words * weight_after <= weight * (3 * all_words - 4 * words_before) as is_full from running),
targets as (
  select source, words, case when is_full then cast(2 * words as double) else cast(weight *
      max(case when not is_full then 3 * all_words - 4 * words_before end) over () as double) /
      cast(2 * max(case when not is_full then weight_after end) over () as double) end as target
  from marked),
placed as (
  select s.doc_id, s.source, s.size, t.words, t.target,
    coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and 1 preceding), 0) as begins
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, words as source_size, target,
  cast(case when words = 0 then 0 else (cast(floor(target) as bigint) // words) * size + greatest(0, least(size,
    cast(floor(target) as bigint) - (cast(floor(target) as bigint) // words) * words - begins)) end as bigint) as taken, source
from placed
"""
