import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest

from fieldloom.llm import turn_repair
from fieldloom.llm.turn_repair import damaged, repair_report, repaired_rows, tables

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk string, place string, present string, symbol string"
SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(faults):
    """Least (cost, edits, roles) by trying every edit, from (fault, role initial) rows."""

    @lru_cache(None)
    def go(i, last, inserts):
        ends = [(0, "", ())] if i == len(faults) and last in ("", "a") else []
        if inserts < 3:
            for role in AFTER[last].replace("s", ""):
                cost, edits, roles = go(i, role, inserts + 1)
                ends.append((cost + 3, "I" + edits, (role, *roles)))
        if i < len(faults):
            fault, initial = faults[i]
            cost, edits, roles = go(i + 1, last, 0)
            ends.append((cost + 4, "D" + edits, (None, *roles)))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for role in AFTER[last]:
                    if role == initial:
                        cost, edits, roles = go(i + 1, role, 0)
                        ends.append((cost + more, "K" + edits, (role, *roles)))
                    if role != "s":
                        cost, edits, roles = go(i + 1, role, 0)
                        ends.append((cost + more + 3, "R" + edits, (role, *roles)))
        return min(ends, default=(10**6, "", ()))

    return go(0, "", 0)


def brute(rows):
    left = damage(rows)
    out, mended = [], []
    for conv in {r[0] for r in rows}:
        own = [r for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((kind, role[:1]))
        cost, edits, roles = cheapest(tuple(faults))
        lines, i = [], 0
        for edit, role in zip(edits, roles):
            if edit == "K":
                lines.append((own[i][2], own[i][3]))
            elif edit == "R":
                lines.append(({"u": "user", "a": "assistant"}[role], own[i][3]))
            elif edit == "I":
                lines.append(({"u": "user", "a": "assistant"}[role], ""))
            i += edit != "I"
        turns = {t for _, t, *_ in own if t is not None}
        kinds = [k for k, _ in faults]
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, sha))
        mended += [(conv, *line) for line in lines]
    key = lambda r: (r[0] is not None, r[0] or 0)
    return sorted(out, key=key), sorted(mended, key=key)


def table(spark, rows):
    return damaged(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3))


def run(spark, rows):
    return sorted(map(tuple, repair_report(table(spark, rows)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def talks(rng, n, most=12):
    rows = []
    for conv in range(n):
        turn = rng.randint(-1, 3)
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(["Hi.", "So?", "no end", "  ", "", "x! \n", "a\x0b.", "y" * 200 + rng.choice("ab.")])))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("hot, chunk", [(65_536, 16_384), (0, 5)])
def test_against_every_edit(spark, monkeypatch, hot, chunk):
    """The second setting cuts every conversation into chunks of about five rows."""
    monkeypatch.setattr(turn_repair, "HOT_ROWS", hot)
    monkeypatch.setattr(turn_repair, "CHUNK_ROWS", chunk)
    # Texts are told apart within 64 characters but for the tie of a turn, which sorts by hash.
    rows = [r for r in talks(random.Random(2), 120) if len(r[3]) < 64]
    rows += [(None, 0, "user", "Hi."), (None, 1, None, "So."), (None, None, "assistant", None), (None, 2, "assistant", "Yes.")]
    expected, mended = brute(rows)
    assert run(spark, rows) == expected
    got = repaired_rows(table(spark, rows)).where("role is not null").orderBy(F_null("conv_id"), "conv_id", "chunk", "place")
    assert [tuple(r) for r in got.select("conv_id", "role", "text").collect()] == mended


def F_null(name):
    from pyspark.sql import functions as F

    return F.col(name).isNotNull()


def test_one_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "HOT_ROWS", 200)
    monkeypatch.setattr(turn_repair, "CHUNK_ROWS", 64)
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b?", f"c{i}", f"d{i}!"])) for i in range(450)]
    rows += [(8 + i // 6, i % 6, rng.choice(["user", "assistant", "system"]), f"t{i}.") for i in range(900)]
    assert run(spark, rows) == brute(rows)[0]


def test_odd_and_empty_tables(spark):
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    twice = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 3)
    rows = [(dropped, 0, "user", "Gone."), (twice, 0, "user", "Again."), (200, None, None, None), (200, None, "user", "Same?"), (200, None, "user", "Same?")]
    rows += [(201, 5, "user", "long " * 100_000 + "end."), (201, 9, "assistant", "ok."), (202, -(2**62), "system", "S."), (202, 2**61, "user", "U.")]
    assert run(spark, rows) == brute(rows)[0]
    report = {r[0]: r for r in run(spark, rows)}
    assert report[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, []) == [] and repaired_rows(table(spark, [])).count() == 0


def test_few_vectors():
    t = tables()
    assert len(t.vectors) < 200 and (t.vectors.min(axis=1) == 0).all()
