import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import spelling
from fieldloom.llm.spelling import SHORT, decompose, endings, kept_grams, letters, spelling_variants

LOWER = str.maketrans(spelling.CAPITALS, spelling.SMALL)


def brute(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    groups = defaultdict(set)
    for w in words:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1 :]].add(w)
    for group in groups.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def run(spark, rows, schema="doc_id bigint, text string, word string, n int, list int"):
    return sorted(map(tuple, spelling_variants(spark.createDataFrame(rows, schema).repartition(3)).collect()))


def texts(rng, n, letters_="abcdeéÿß"):
    parts = ["".join(rng.choice(letters_) for _ in range(rng.randint(2, 4))) for _ in range(14)]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(60)]
    out = []
    for _ in range(n):
        line = []
        for _ in range(rng.randint(5, 60)):
            w = rng.choice(words[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice(letters_) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters_) + w[i + 1 :]])
            line.append(rng.choice([w, w, w.capitalize()]))
        out.append(rng.choice([" ", "-", ", "]).join(line))
    return out


@pytest.mark.parametrize("times", [3, 60])
def test_against_brute_force(spark, monkeypatch, times):
    """With a low count nearly all grams are long, and many words go on to shorter ones."""
    monkeypatch.setattr(spelling, "TIMES", times)
    rows = [(i, t, "w", 1, 2) for i, t in enumerate(texts(random.Random(11), 300))]
    expected = brute(rows)
    assert any(f for _, f, *_ in expected) and any(f and r != f for _, f, r, *_ in expected)
    assert run(spark, rows) == expected


def test_odd_and_empty_tables(spark):
    long = "ab" * 20_000
    rows = [(1, "", "", 0, 0), (2, None, None, None, None), (None, "Straße Straße straße STRAßE strasse Æther æther Æther", "", 0, 0)]
    rows += [(4, f"{long} {long}x {long}x {long} {long}", "", 0, 0), (4, f"{long}x", "", 0, 0)]
    rows += [(5, "repeat repeat  repeet", "a", 1, 1)] * 3 + [(6, " \n\t 123 ... ", "", 0, 0)]
    assert run(spark, rows) == brute(rows) != []
    assert run(spark, []) == run(spark, [(1, "few words here", "", 0, 0)]) == []


@pytest.mark.parametrize("longest", [2, 3, 4, 6])
def test_an_edit_leaves_the_grams_that_the_bound_says(longest):
    rng = random.Random(longest)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(150)]
    marked = [f"{spelling.OPEN}{w}{spelling.CLOSE}" for w in words]
    counts = Counter(m[i : i + q] for m in marked for q in range(SHORT, longest) for i in range(len(m) - q + 1))
    for least in (0, 5, 20, 60):
        found = {g for g, n in counts.items() if n > least}
        frequent = {g for g in found if all(g[:k] in found for k in range(SHORT, len(g)))}
        tails = endings(frequent)
        for w, m in zip(words, marked):
            starts, ends = decompose(m, frequent, longest)
            kept = kept_grams(m, starts, ends, frequent, tails, longest)
            assert longest > SHORT or kept > 0
            own = {(m[a:b], a) for a, b in zip(starts, ends)}
            for i in range(len(w) + 1):
                edits = [w[:i] + c + w[i:] for c in "abc"] + ([w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in "abc"] if i < len(w) else [])
                for other in edits:
                    o = f"{spelling.OPEN}{other}{spelling.CLOSE}"
                    theirs = {(o[a:b], a) for a, b in zip(*decompose(o, frequent, longest))}
                    gap = len(other) - len(w)
                    shared = sum((g, a) in theirs or (g, a + gap) in theirs for g, a in own)
                    assert shared >= kept, (w, other)
                    assert bin((letters(w) ^ letters(other)) & (2**64 - 1)).count("1") <= 2
