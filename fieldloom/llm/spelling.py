"""Spelling variants: words one edit apart through an index of variable-length grams.

Words stand between two marks. From every place of a word its gram runs on while it is a frequent
one of the vocabulary, up to a longest length; a gram inside an earlier one is left out. Common
parts of words so give long grams and rare parts short ones, and lists stay short.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare
from fieldloom.llm.line_dedup import _common_prefix as common_prefix
from fieldloom.llm.line_dedup import _let as let
from fieldloom.session import materialize

# What a word is, the fewest code points and occurrences, and how runs are damaged.
RUN = "[^a-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_TIMES, DAMAGE = 5, 3, 97
#: Marks around a word; no word holds them.
OPEN, CLOSE = "\x02", "\x03"
#: Shortest gram.
SHORT = 2
#: A gram is frequent above so many occurrences, or more so that at most ``GRAMS`` of a length are.
TIMES, GRAMS = 500, 1 << 18
#: Longest word that is repeated with each of its grams.
LONG_WORD = 64
#: Longest gram for up to ``WORDS`` words; one more for every eightfold number.
LONG, WORDS = 4, 1_000_000


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all documents, after damaging every 97th run of letters.

    A null text has no run; a null id counts as an empty one.
    """
    text = f"translate(cast(`{text_col}` as string), '{CAPITALS}', '{SMALL}')"
    runs = docs.selectExpr(f"coalesce(cast(`{id_col}` as string), '') as doc", f"explode(split({text}, '{RUN}')) as run")
    hashed = runs.where("run <> ''").selectExpr("run", "crc32(concat(doc, ':', run)) as h")
    place = "cast(h % length(run) as int)"
    words = hashed.selectExpr(f"if(h % {DAMAGE} = 0, concat(left(run, {place}), substring(run, {place} + 2)), run) as word")
    counts = words.where(f"length(word) >= {LEAST_CHARS}").groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(f"n >= {LEAST_TIMES}")


def decompose(marked: str, frequent: set[str], longest: int) -> tuple[list[int], list[int]]:
    """Starts and ends of a marked word's variable grams."""
    starts, ends, last, size = [], [], 0, len(marked)
    for p in range(size - SHORT + 1):
        e = p + SHORT
        while e < size and e - p < longest and marked[p:e] in frequent:
            e += 1
        if e > last:
            starts.append(p)
            ends.append(last := e)
    return starts, ends


def endings(frequent: set[str]) -> set[str]:
    """All proper endings of the frequent grams, the empty one included."""
    return {""}.union(g[k:] for g in frequent for k in range(1, len(g)))


def kept_grams(marked: str, starts: list[int], ends: list[int], frequent: set[str], tails: set[str], longest: int) -> int:
    """The least number of the word's grams that any word one edit away has too.

    Left of an edit, grams stay up to the first place whose text before the edit is a frequent
    gram: from there a longer gram might run across the edit. Right of an edit, a gram from
    before it might take in those that end where an ending of a frequent gram, and one letter more, reaches.
    """
    size, total = len(marked), len(starts)
    reach = [0] * (size + 1)
    for j in range(1, size + 1):
        reach[j] = next((x for x in range(min(size + 1, j + longest - 1), j, -1) if marked[j : x - 1] in tails), j)
    least = total
    for i in range(1, size):
        before = next((p for p in range(max(0, i - longest + 1), i - SHORT + 1) if marked[p:i] in frequent), size)
        left = min(bisect_right(ends, i), bisect_left(starts, before))
        # A letter put in before i; then, marks aside, the letter at i replaced or deleted.
        for j in (i, i + 1) if i < size - 1 else (i,):
            right = total - max(bisect_left(starts, j), bisect_right(ends, reach[j]))
            least = min(least, left + right)
    return least


def letters(word: str) -> int:
    """One bit per letter (some share one); an edit changes two bits at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) * 37 % 64)
    return bits - (1 << 64) if bits >> 63 else bits


def frequent_grams(words: DataFrame, longest: int) -> set[str]:
    """Grams of ``SHORT`` to ``longest - 1`` characters that occur often, as do their beginnings.

    At most ``GRAMS`` of each length come to the driver: the number of occurrences that a
    gram needs follows from that of all grams.
    """
    if longest <= SHORT:
        return set()
    marked = words.selectExpr(f"concat('{OPEN}', word, '{CLOSE}') as w")
    total = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    least = max(TIMES, total // GRAMS)
    grams = [f"transform(sequence(1, length(w) - {q - 1}), i -> substring(w, i, {q}))" for q in range(SHORT, longest)]
    counts = marked.selectExpr(f"explode(concat({', '.join(grams)})) as gram").groupBy("gram").count().where(F.col("count") > least)
    found = {row.gram for row in counts.collect()}
    return {g for g in found if all(g[:k] in found for k in range(SHORT, len(g)))}


GRAM = "id bigint, word string, letters bigint, chars int, gram string, place int, grams int, kept int"


def gram_index(words: DataFrame, longest: int) -> DataFrame:
    """One row per word and variable gram, with the word's number of grams and how many an edit leaves.

    The rows of a word of more than ``LONG_WORD`` characters do not repeat the word.
    """
    frequent = frequent_grams(words, longest)
    held = words.sparkSession.sparkContext.broadcast((frequent, endings(frequent)))

    def run(batches):
        frequent, tails = held.value
        for batch in batches:
            columns = ([], [], [], [], [], [], [], [])
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                marked = f"{OPEN}{word}{CLOSE}"
                starts, ends = decompose(marked, frequent, longest)
                before = i, word if len(word) <= LONG_WORD else None, letters(word), len(word)
                after = len(starts), kept_grams(marked, starts, ends, frequent, tails, longest)
                for a, b in zip(starts, ends):
                    for column, value in zip(columns, (*before, marked[a:b], a, *after)):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in GRAM.split(", ")])

    # As many tasks as the session shuffles into: the words are small, the work on them is not.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(words.select("id", "word").repartition(parts, "id").mapInArrow(run, GRAM), "variable-grams")


def _list(chars: str, place: str, kind: int) -> str:
    """SQL for the list of a gram in words of some length at some place."""
    return f"xxhash64(gram, {chars}, {place}, {kind})"


def _one_edit(a: str, b: str) -> str:
    """SQL: whether two different words are one edit apart, in steps that grow with their length alone."""
    short, long = f"if(length({a}) <= length({b}), {a}, {b})", f"if(length({a}) <= length({b}), {b}, {a})"
    rest = "substring(w.s, p + 1 + if(length(w.s) = length(w.l), 1, 0)) = substring(w.l, p + 2)"
    return let(f"named_struct('s', {short}, 'l', {long})", "w", let(common_prefix("w.s", "w.l"), "p", rest))


def gram_pairs(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(id, other) for every pair one edit apart of which one word at least keeps a gram, some from both sides.

    A word looks its grams up among words as long as itself or one letter longer, at the same place
    from the start or the end; among shorter words only in those that no edit leaves a gram, as the
    others find it themselves. Of its lists all but the ``kept - 1`` longest are merged: a word one
    edit away is in one of these. Every word found is verified.
    """
    entries = grams.selectExpr(
        "id as other", "word as text", "letters as marks", "chars as size", "kept <= 0 as weak",
        f"explode(if(kept <= 0, array({_list('chars', 'place', 0)}, {_list('chars', 'place', 1)}), array({_list('chars', 'place', 0)}))) as list",
    )
    own = grams.where("kept > 0").withColumn("own", F.expr(_list("chars", "place", 0)))
    sizes = grams.groupBy(F.expr(_list("chars", "place", 0)).alias("own")).agg(F.count("*").alias("times"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("times", "place"))
    short = own.join(sizes, "own").withColumn("nth", nth).where("nth <= grams - kept + 1")
    lists = [_list("chars", "place", 0), _list("chars + 1", "place", 0), _list("chars + 1", "place + 1", 0)]
    lists += [_list("chars - 1", "place", 1), _list("chars - 1", "place - 1", 1)]
    probes = short.selectExpr("id", "word", "letters", "chars", f"explode(array({', '.join(lists)})) as list")
    linked = """id <> other and (weak or size > chars or id < other) and bit_count(letters ^ marks) <= 2
        and abs(size - chars) <= 1 and (word is null or text is null or levenshtein(word, text, 1) = 1)"""
    found = probes.join(entries, "list").where(linked).selectExpr("id", "other", "word is null or text is null as long").distinct()
    found = materialize(found, "near-words")
    texts = words.selectExpr("id as other", "word as text")
    long = found.where("long").join(words.select("id", "word"), "id").join(texts, "other").where(_one_edit("word", "text"))
    return found.where("not long").select("id", "other").unionByName(long.select("id", "other"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, other) for every ordered pair of words one edit apart, from (id, word).

    Words that an edit may leave without any gram are indexed again, among themselves, with a
    smaller longest length; with grams of one length an edit leaves a word at least one.
    """
    words, pairs = vocabulary.select("id", "word"), None
    count = vocabulary.count()
    longest = LONG + max(0, math.ceil(math.log(max(1, count) / WORDS, 8)))
    while True:
        grams = gram_index(words, longest)
        found = gram_pairs(grams, words)
        pairs = found if pairs is None else pairs.unionByName(found)
        weak = grams.where("kept <= 0").select("id").distinct()
        if longest == SHORT or weak.isEmpty():
            break
        words, longest = materialize(words.join(weak, "id", "left_semi"), "weak-words"), max(SHORT, longest - 1)
    return pairs.unionByName(pairs.selectExpr("other as id", "id as other")).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form, root) of (word, form): the last word that following forms leads to.

    Each round replaces what a word points to by what that points to, so a chain of forms takes
    as many rounds as its length has binary digits; forms at least double in number, which bounds it.
    """
    start = forms.where("form is not null").select("word", "form")
    links = materialize(start.select("word", F.col("form").alias("root")), "form-links")
    while True:
        onward = links.selectExpr("word as root", "root as further")
        step = materialize(links.join(onward, "root", "left").select("word", "root", "further"), "form-links")
        links = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further is not null").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n.

    A word's form is the near word (one inserted, deleted or replaced code point) that occurs
    most often, the smallest of several, if at least twice as often as the word; the root is where
    following forms ends. Repeated rows count as often as they stand; runs of any length are
    whole; other columns are ignored; a table without words gives an empty one.
    """
    prepare(docs.sparkSession)
    vocabulary = materialize(corpus_words(docs, id_col, text_col).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    others = vocabulary.selectExpr("id as other", "word as form", "-n as less")
    best = near_words(vocabulary).join(others, "other").groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct("less", "form")).alias("best")
    )
    facts = vocabulary.join(best, "id", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) as n_near", "if(-best.less >= 2 * n, best.form, null) as form", "if(-best.less >= 2 * n, -best.less, null) as form_n"
    )
    facts = materialize(facts, "word-forms")
    return with_roots(facts).select("word", "form", "root", "n", "n_near", "form_n")
