import random
import re

import numpy as np
import xxhash

from fieldloom.llm import simhash_anchors
from fieldloom.llm.components import components
from fieldloom.llm.simhash_anchors import anchors, classes, near_duplicates, one_of_each


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest member reachable at 3 or fewer bits."""
    todo, out = set(prints), {}
    while todo:
        group, queue = set(), [todo.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= 3}
            todo -= near
            queue += near
        out.update(dict.fromkeys(group, min(group, key=lambda v: v - (1 << 64) if v >> 63 else v)))
    return out


def clouds(rng, n):
    """Fingerprints around a few centres, so that many are 1 to 6 bits apart."""
    centres, out = [rng.getrandbits(64) for _ in range(6)], set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out | {0, 1, (1 << 64) - 1, 7})


def test_anchors_cover_and_meet():
    rng = random.Random(4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for _ in range(rng.randint(0, 3)):
            y ^= 1 << rng.randrange(64)
        _, code, home = anchors(np.array([x], np.uint64))
        assert home.sum() == 2 and len(set(code.tolist())) == len(code)
        _, other, _ = anchors(np.array([y], np.uint64))
        assert set(code[home].tolist()) & set(other.tolist())


def test_classes_against_brute_force(spark, monkeypatch):
    prints = clouds(random.Random(8), 700)
    want = brute_classes(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "doc_id bigint, fingerprint bigint")
    for block in (4096, 16):  # one block, and hot anchors split over many
        monkeypatch.setattr(simhash_anchors, "BLOCK", block)
        got = {r.fingerprint: (r.component, r.component_id) for r in classes(rows).collect()}
        low = {}
        for i, p in enumerate(prints):
            low.setdefault(want[p], i)
        assert got == {signed(p): (signed(want[p]), low[want[p]]) for p in prints}


def test_links_are_no_more_than_a_forest_per_cell(spark):
    centre = 0x0123456789ABCDEF
    prints = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    n = simhash_anchors.links(rows).count()
    pairs = sum((x ^ y).bit_count() <= 3 for i, x in enumerate(prints) for y in prints[:i])
    assert n < 20 * len(prints) < pairs


def test_copies_are_not_broadcast_by_their_estimated_size(spark):
    """A fingerprint goes to some 30 anchors, so copies are many more rows than Spark takes them for."""
    prints = clouds(random.Random(8), 100)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id bigint, fingerprint bigint")
    plan = simhash_anchors.links(rows.select("fingerprint"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_against_brute_force(documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    group = brute_classes(prints.values())
    low = {}
    for i in sorted(prints):
        low.setdefault(group[prints[i]], i)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(documents).collect()}
    assert got == {i: (p, low[group[p]]) for i, p in prints.items()}
    stay = one_of_each(documents)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(low.values())) and stay.columns == documents.columns


def test_odd_and_empty_tables(odd, empty):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(odd).collect()), key=str)
    zero = "0" * 16
    assert [r for r in got if r[1] == zero] == [(1, zero, 1), (2, zero, 1), (5, zero, 1), (None, zero, 1)]
    assert sum(r[2] == 4 for r in got) == 3 and len(got) == 10
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 6, 7, None]
    assert near_duplicates(empty).collect() == [] and one_of_each(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {201: 200}
