import re
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import mixing
from fieldloom.llm.mixing import mix, mixed_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    """Targets by sharing the excess again until no source is above its most."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        free -= full
    return out


def check(docs):
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, got = targets(sizes), mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) < 1
    assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    return got


def test_sources_come_to_their_targets(spark, documents, monkeypatch):
    check(documents)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    check(documents)


def test_hot_source_and_capped_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 11)
    rows = [(i, "w " * (i % 9), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(600)]
    got = check(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    per = defaultdict(set)
    for r in got:
        per[r.source].add((r.target, 2.0 * r.source_size))
    assert any(t == most for v in per.values() for t, most in v)


def test_odd_and_empty_tables(odd, empty):
    got = check(odd)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 5))
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []


def test_mixed_documents_are_whole(spark, documents, odd):
    taken = mix(documents).collect()
    want = Counter({r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in taken if r.size})
    got = mixed_documents(documents)
    # The row number takes part in the random order, so only sums by source are alike.
    words = Counter()
    for r in got.collect():
        words[r.source] += len(WORD.findall(r.text))
    for s, t in {(r.source, r.target) for r in taken}:
        assert abs(words[s] - t) <= max(r.size for r in taken if r.source == s)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(texts[r.doc_id] == r.text for r in got.collect()) and sum(want.values()) > 0
    assert mixed_documents(odd).columns == odd.columns
    assert {r.doc_id for r in mixed_documents(odd).collect()} <= {4, 6, 7, 8, None}


def test_a_source_per_document_is_summed_in_chunks(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i:03}" if i else None, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    check(docs)
    sized = docs.selectExpr("source", "cast(n_chars + doc_id % 9 as bigint) as size")
    plan = mixing.source_targets(sized)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert all("_chunk" in w or "_t_" in w for w in windows)
