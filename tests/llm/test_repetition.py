import collections
import re

from fieldloom.llm.repetition import LINE_COUNT_SHARE, LINE_SHARE, NGRAM_SHARES, drop_repetitive, repetition_report

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)

    def covered(n, first):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, inside = collections.Counter(grams), set(), set()
        for i, gram in enumerate(grams):
            if counts[gram] > 1 and (first or gram in seen):
                inside.update(range(i, i + n))
            seen.add(gram)
        return inside

    seen, n_lines, dup, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, words))
    repeat = len(covered(3, True))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    grams = [sum(len(words[i]) for i in covered(n, False)) for n in NGRAM_SHARES]
    bad = dup > LINE_COUNT_SHARE * n_lines or dup_chars > LINE_SHARE * chars
    bad |= any(g > s * chars for g, s in zip(grams, NGRAM_SHARES.values()))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), chars, symbols, dup, repeat, failed, not failed and not bad, dup_chars, *grams)


def test_against_brute_force(spark, documents):
    extra = [(1000, "x y z " * 40, "en", "s", 1), (1001, "a* #b $c\nline one here\nline one here\n" + " ".join(map(str, range(90))), "en", "s", 1)]
    rows = documents.union(spark.createDataFrame(extra, documents.schema))
    got = {r.doc_id: tuple(r)[1:] for r in repetition_report(rows).collect()}
    assert got == {r.doc_id: brute(r.text) for r in rows.collect()}
    assert {v[6] for v in got.values()} == {True, False}


def test_odd_and_empty_tables(odd, empty):
    got = repetition_report(odd).collect()
    want = [(r.doc_id, *brute(r.text)) for r in odd.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert repetition_report(empty).collect() == [] and drop_repetitive(empty).collect() == []
    kept = drop_repetitive(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [6]
