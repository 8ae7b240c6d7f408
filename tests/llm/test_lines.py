import random

from pyspark.sql import functions as F

from fieldloom.llm import line_dedup
from fieldloom.llm.line_dedup import MIN_CHARS, line_report, near_lines, within_edits, without_repeated_lines


def edit(rng, text):
    chars, kind, at = list(text), rng.randint(0, 2), rng.randrange(len(text) + 1)
    if kind == 1 or not chars:
        chars.insert(at, rng.choice("abé"))
    elif kind == 0:
        chars.pop(min(at, len(chars) - 1))
    else:
        chars[min(at, len(chars) - 1)] = rng.choice("abé")
    return "".join(chars)


def edits(n):
    return 2 if n >= 64 else 1 if n >= 32 else 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_edits_equal_levenshtein(spark):
    rng, rows = random.Random(2), []
    for i in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = a
        for _ in range(rng.randint(0, 4)):
            b = edit(rng, b)
        rows.append((i, *sorted((a, b), key=len), rng.randint(1, 2)))
    df = spark.createDataFrame(rows, "id int, a string, b string, e int")
    got = {r.id for r in df.where(within_edits("a", "b", "e")).collect()}
    assert got == {r.id for r in df.where("levenshtein(a, b) <= e").collect()} and 200 < len(got) < 1400


def brute(rows):
    """Removed lines of (doc_id, text) as sets of exact and near (row, place)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, exact, near = {}, set(), set()
    for i in order:
        for pos, raw in enumerate((rows[i][1] or "").split("\n")):
            line = raw.strip(" \t\r")
            if len(line) < MIN_CHARS:
                continue
            if line in first:
                exact.add((i, pos))
                continue
            if any(
                abs(len(line) - len(o)) <= 2 and (e := edits(min(len(line), len(o)))) and distance(line, o) <= e for o in first
            ):
                near.add((i, pos))
            first[line] = (i, pos)
    return exact, near


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact, near = brute(rows)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        parts = (text or "").split("\n")
        gone = [p for p in range(len(parts)) if (i, p) in exact or (i, p) in near]
        stays = [p for p in range(len(parts)) if p not in gone]
        want.append((doc_id, len(parts), sum(j == i for j, _ in exact), sum(j == i for j, _ in near), sum(len(parts[p].strip(" \t\r")) for p in stays), sum(stays)))
    assert sorted(map(tuple, line_report(docs).collect()), key=str) == sorted(want, key=str)
    texts = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in exact | near) if t is not None else None) for i, (d, t) in enumerate(rows)]
    kept = without_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(texts, key=str)
    return exact, near


def test_against_brute_force(documents):
    exact, near = check(documents.coalesce(1))
    assert len(exact) > 40 and len(near) > 20


def test_every_pair_within_the_edits_is_found(spark):
    rng, lines = random.Random(3), []
    for size in (32, 33, 47, 48, 49, 62, 63, 64, 65, 66, 79, 80, 81, 82, 90, 130):
        for _ in range(6):
            line = "".join(rng.choice("ab é") for _ in range(size - 2)).join("xx")
            lines.append(line)
            for _ in range(3):
                other = line
                for _ in range(rng.randint(1, 3)):
                    other = edit(rng, other)
                lines.append(other)
    lines = list(dict.fromkeys(lines))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "place bigint, line string").selectExpr(
        "xxhash64(line) as key", "place as first", "line", "length(line) as length", "length(line) div 16 as class",
        "if(length(line) >= 64, 2, if(length(line) >= 32, 1, 0)) as edits",
    )
    found = {r.line for r in near_lines(texts.where("edits > 0")).join(texts, "key").collect()}
    want = {
        b for j, b in enumerate(lines) for a in lines[:j]
        if abs(len(a) - len(b)) <= 2 and (e := edits(min(len(a), len(b)))) and distance(a, b) <= e
    }
    assert found == want and len(want) > 60


def test_odd_and_empty_tables(odd, empty):
    exact, near = check(odd.coalesce(1))
    assert len(exact) == 2 and not near
    assert line_report(empty).collect() == [] and without_repeated_lines(empty).collect() == []


def test_hot_line(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line in all of them\nnumber "), F.col("id")).alias("text"))
    got = line_report(docs).agg(F.sum("n_exact"), F.sum("n_near")).first()
    assert tuple(got) == (299, 0)


def test_segments_are_made_once(spark, monkeypatch):
    made, materialize = [], line_dedup.materialize

    def watched(df, label="stage"):
        df.collect()
        made.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Generate "))
        return materialize(df, label)

    monkeypatch.setattr(line_dedup, "materialize", watched)
    lines = [f"{'a line that is much like the next one, '[i % 2:] * (1 + i % 3)}{i // 7}" for i in range(200)]
    docs = spark.createDataFrame([(0, 0, "\n".join(lines))], "row int, doc_id bigint, text string")
    texts = line_dedup.distinct_lines(line_dedup._lines(docs))
    assert near_lines(texts.where("edits > 0")).count() > 50
    assert sum(made) == 1


def test_segment_shared_by_all_lines(spark):
    rng = random.Random(4)
    ends = ["".join(rng.choice("abcdef") for _ in range(40)) for _ in range(40)]
    lines = ["x" * 40 + e for e in ends + [e[:20] + "é" + e[21:] for e in ends[:12]]]
    exact, near = check(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").coalesce(1))
    assert not exact and near == {(i, 0) for i in range(40, 52)}


def test_lines_are_not_broadcast_by_their_files_size(spark):
    texts = line_dedup.distinct_lines(line_dedup._lines(spark.createDataFrame([(0, 0, "a" * 40 + "\n" + "a" * 39 + "b")], "row bigint, doc_id bigint, text string")))
    plan = near_lines(texts)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "SortMergeJoin [key#" in x]) >= 4
