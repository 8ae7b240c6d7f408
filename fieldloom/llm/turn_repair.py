"""Repair of conversation structure at least cost, by lookups of whole blocks of rows.

A state is what the roles so far allow: nothing yet, after s, after u, after a. The least costs
to finish from each state, less the smallest of them, take few values, so every block of ``BLOCK``
rows is a precomputed step from one such vector to another. Rows are looked up from the last block
to the first; each block is then expanded backward from the vector at its right edge, and the
first edit in ASCII order that keeps the least cost is taken from the first row on.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare
from fieldloom.session import materialize

# Costs of the edits, and of leaving a truncated row in.
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
#: Rows of a block; a symbol is twice the role's class (s, u, a, other), plus 1 if truncated.
BLOCK = 4
GONE, NONE = 8, 9
#: State after the role that may come next; state after keeping a role of each class, -1 if it may not.
NEXT = (2, 2, 3, 2)
KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ROLE = {2: "user", 3: "assistant"}
#: A conversation of more rows or characters is cut into chunks of rows.
HOT_ROWS, HOT_CHARS = 65_536, 64_000_000
CHUNK_ROWS = 16_384
#: Rows of ordinary conversations that are mended at a time.
LOT_ROWS = 4_096
#: White space, as SQL writes it.
SPACE = " \\t\\n\\u000B\\u000C\\r"

INSIDE = "conv_id bigint, turn bigint, role string, text string, present boolean"
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id bigint, chunk int, place bigint, edit string, role string, text string"


class Tables(NamedTuple):
    vectors: np.ndarray
    #: Per block of symbols, as a number of base 10, and vector to its right: vector to its left, cost.
    left: np.ndarray
    cost: np.ndarray
    #: The same for single symbols.
    step: np.ndarray
    #: Per symbol, vector to its right and state before it: edits, state after it.
    word: np.ndarray
    after: np.ndarray
    words: list[str]


def _settle(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _edits(symbol: int, q: int, right) -> list[tuple[str, int, int]]:
    """(letter, cost to finish, state after) of the edits of one row, from a state."""
    out = [("D", DELETE + right[q], q)]
    if symbol != GONE:
        role, short = divmod(symbol, 2)
        if (kept := KEEP[q][role]) >= 0:
            out.append(("K", CUT_SHORT * short + right[kept], kept))
        out.append(("R", REROLE + CUT_SHORT * short + right[NEXT[q]], NEXT[q]))
    return out


@lru_cache(maxsize=1)
def tables() -> Tables:
    ends = _settle([0, 99, 99, 0])
    vectors, number, steps = [ends], {ends: 0}, []
    for vector in vectors:
        for symbol in range(GONE + 1):
            costs = _settle([min(c for _, c, _ in _edits(symbol, q, vector)) for q in range(4)])
            least = min(costs)
            key = tuple(c - least for c in costs)
            if key not in number:
                number[key] = len(vectors)
                vectors.append(key)
            steps.append((number[key], least))
    count = len(vectors)
    left = np.array([s for s, _ in steps]).reshape(count, -1).T
    cost = np.array([c for _, c in steps]).reshape(count, -1).T
    step = np.vstack([left, np.arange(count)]).astype(np.int16)
    add = np.vstack([cost, np.zeros(count)]).astype(np.int16)
    block_left = np.tile(np.arange(count, dtype=np.int16), (10**BLOCK, 1))
    block_cost = np.zeros((10**BLOCK, count), np.int16)
    codes = np.arange(10**BLOCK)
    for place in range(BLOCK):
        symbols = (codes // 10**place % 10)[:, None]
        block_cost += add[symbols, block_left]
        block_left = step[symbols, block_left]
    words, names = [], {}
    word, after = np.zeros((GONE + 1, count, 4), np.int16), np.zeros((GONE + 1, count, 4), np.int8)
    for symbol, right, state in product(range(GONE + 1), range(count), range(4)):
        here = np.array(vectors[step[symbol, right]]) + add[symbol, right]
        letters, q = "", state
        while True:
            best = [(c, q2) for c, total, q2 in _edits(symbol, q, vectors[right]) if total == here[q]]
            inserts = [("I", NEXT[q])] if here[q] == INSERT + here[NEXT[q]] else []
            letter, q = min(best + inserts)
            letters += letter
            if letter != "I":
                break
        word[symbol, right, state] = names.setdefault(letters, len(names))
        after[symbol, right, state] = q
    words = list(names)
    return Tables(np.array(vectors), block_left, block_cost, step, word, after, words)


def finish(state: int) -> str:
    """The edits after the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def look_up(symbols: np.ndarray, bounds: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the vector after it; per run of rows the vector before it and the cost added.

    ``bounds`` cuts the rows into runs; ``right`` gives the vector after each, of any shape.
    """
    t = tables()
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    run = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(symbols)) - bounds[:-1][run] + (first[1:][run] * BLOCK - sizes[run])
    padded = np.full(int(first[-1]) * BLOCK, NONE, np.int64)
    padded[place] = symbols
    padded = padded.reshape(-1, BLOCK)
    codes = padded @ (10 ** np.arange(BLOCK)[::-1])
    now, cost = right.copy(), np.zeros(right.shape, np.int64)
    edge = np.zeros((len(codes), *right.shape[1:]), np.int64)
    order = np.argsort(-blocks, kind="stable")
    lasting = np.sort(blocks)
    for back in range(int(blocks.max(initial=0))):
        active = order[: len(blocks) - np.searchsorted(lasting, back, side="right")]
        at = first[1:][active] - 1 - back
        edge[at] = now[active]
        code = codes[at].reshape(-1, *[1] * (right.ndim - 1))
        cost[active] += t.cost[code, now[active]]
        now[active] = t.left[code, now[active]]
    inner = np.zeros((*padded.shape, *right.shape[1:]), np.int64)
    for k in range(BLOCK - 1, -1, -1):
        inner[:, k] = edge
        edge = t.step[padded[:, k].reshape(-1, *[1] * (right.ndim - 1)), edge]
    return inner.reshape(-1, *right.shape[1:])[place], now, cost


def walk(symbols: np.ndarray, bounds: np.ndarray, after: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of its edits, and the state after each run, from the state before each."""
    t = tables()
    sizes, now = np.diff(bounds), states.copy()
    words = np.zeros(len(symbols), np.int64)
    order, lasting = np.argsort(-sizes, kind="stable"), np.sort(sizes)
    for step in range(int(sizes.max(initial=0))):
        active = order[: len(sizes) - np.searchsorted(lasting, step, side="right")]
        at = bounds[:-1][active] + step
        place = symbols[at], after[at], now[active]
        words[at] = t.word[place]
        now[active] = t.after[place]
    return words, now


def mended(words: list[str], rows: list[tuple[str, str]], state: int, last: bool) -> list[tuple[str, str | None, str | None]]:
    """(edit, role, text) of every edit, in order; a deleted row has neither role nor text."""
    out = []

    def insert():
        nonlocal state
        state = NEXT[state]
        out.append(("I", ROLE[state], ""))

    for letters, (role, text) in zip(words, rows):
        for letter in letters:
            if letter == "I":
                insert()
            elif letter == "D":
                out.append(("D", None, None))
            elif letter == "K":
                state = KEEP[state]["sua".find(role[:1])]
                out.append(("K", role, text))
            else:
                state = NEXT[state]
                out.append(("R", ROLE[state], text))
    for _ in finish(state) if last else "":
        insert()
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the contract's faults: conv_id, turn, role, text, present.

    A null is one space, in role and text as in the key; a dropped row stays as one that is not
    present, so that its conversation is known. Other columns are left behind.
    """
    rows = conversations.selectExpr(
        "cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "coalesce(cast(role as string), ' ') as role", "coalesce(cast(text as string), ' ') as text",
        "crc32(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))) % 20 as fault",
    )
    text = "case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end"
    return rows.selectExpr(
        "conv_id", "turn", "if(fault = 4, 'user', role) as role", f"{text} as text", "fault <> 0 as present",
        "explode(array_repeat(0, if(fault = 3, 2, 1))) as copy",
    ).drop("copy")


#: The order of rows: by turn, nulls first; rows of one turn by role and text (a long text's rest by its hash).
ORDER = ["turn", "role", "start", "hash"]


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the symbol they have unless the same stands earlier, and what they are ordered by."""
    bare = f"trim(trailing '{SPACE}' from text)"
    marked = rows.selectExpr("*", f"{bare} as bare", "left(text, 64) as start", "md5(text) as hash")
    role = "case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end"
    symbol = f"if(bare = '', {GONE}, 2 * {role} + if(right(bare, 1) in ('.', '!', '?'), 0, 1))"
    return marked.selectExpr("conv_id", "turn", "role", "text", "present", "start", "hash", f"cast({symbol} as int) as symbol")


class Conversation:
    """Rows of one conversation, in order, with the counts of its faults."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows, self.symbols, self.turns, self.seen = [], bytearray(), set(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, symbol: int) -> None:
        if turn is not None:
            self.turns.add(turn)
        if self.rows:
            self.illegal += not legal(self.rows[-1][0], role)
        if symbol == GONE:
            self.blank += 1
        elif (role, text) in self.seen:
            self.duplicate += 1
            symbol = GONE
        elif symbol % 2:
            self.truncated += 1
        self.seen.add((role, text))
        self.rows.append((role, text))
        self.symbols.append(symbol)

    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0


def legal(role: str, following: str) -> bool:
    return role[:1] + following[:1] in ("su", "ua", "au")


def mend(some: list[Conversation]):
    """(conversation, cost, words) of each."""
    sizes = [len(c.rows) for c in some]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    symbols = np.frombuffer(b"".join(bytes(c.symbols) for c in some), np.uint8).astype(np.int64)
    after, left, cost = look_up(symbols, bounds, np.zeros(len(some), np.int64))
    words, _ = walk(symbols, bounds, after, np.zeros(len(some), np.int64))
    t = tables()
    cost = cost + t.vectors[left, 0]
    for c, total, a, b in zip(some, cost.tolist(), bounds, bounds[1:]):
        yield c, total, [t.words[w] for w in words[a:b].tolist()]


def _conversations(batches):
    """Lists of whole conversations from sorted rows, of about ``LOT_ROWS`` rows each."""
    done, held, now = [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "symbol")]
        for conv_id, turn, role, text, present, symbol in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now)
                    held += len(now.rows)
                    if held >= LOT_ROWS:
                        yield done
                        done, held = [], 0
                now = Conversation(conv_id)
            if present:
                now.add(turn, role, text, symbol)
    if now is not None:
        yield [*done, now]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Marked rows of ordinary conversations, sorted and whole per task, and those of very long ones."""
    prepare(rows.sparkSession)
    marked = _marked(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    hot = materialize(sizes.where(f"n > {HOT_ROWS} or chars > {HOT_CHARS}").select(F.col("conv_id").alias("hot")), "long-conversations")
    longs = None
    if not hot.isEmpty():
        same = F.expr("conv_id <=> hot")
        marked, longs = marked.join(hot, same, "left_anti"), marked.join(hot, same, "left_semi")
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER), longs


def repaired_rows(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation: conv_id, chunk, place, edit, role, text, from rows like ``INSIDE``.

    Within a conversation, (chunk, place) is the order. A deleted row has neither role nor text. A conversation
    of more than ``HOT_ROWS`` rows is cut into chunks that are mended apart; the others are chunk 0.
    """
    ordinary, longs = _parts(rows)

    def run(batches):
        for some in _conversations(batches):
            for c, _, words in mend(some):
                edits = mended(words, c.rows, 0, True)
                if edits:
                    yield _table([(c.conv_id, 0, i, *e) for i, e in enumerate(edits)], REPAIRED)

    out = ordinary.mapInArrow(run, REPAIRED)
    return out if longs is None else out.unionByName(_Long(longs).repaired())


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cheapest edits and the SHA-256 of what they leave.

    ``rows`` are like ``INSIDE``; rows that are not present only name their conversation, and one without
    rows has zeros, no edits and the hash of the empty string. Conversations with a null id are one. Rows of one
    turn are taken by role, then text; rows that repeat one are duplicates; roles are told apart by
    their first character. An empty table gives an empty one.
    """
    ordinary, longs = _parts(rows)

    def run(batches):
        for some in _conversations(batches):
            out = []
            for c, cost, words in mend(some):
                edits = mended(words, c.rows, 0, True)
                text = "\n".join(f"{role}:{text}" for _, role, text in edits if role is not None)
                audit = "".join(e for e, _, _ in edits)
                out.append((c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            yield _table(out, REPORT)

    out = ordinary.mapInArrow(run, REPORT)
    return out if longs is None else out.unionByName(_Long(longs).report())


PIECE = "conv_id bigint, chunk int, symbols binary, lefts binary, costs binary, opens string, closes string, illegal bigint, last boolean"


class _Long:
    """Very long conversations: chunks of rows are mended apart, and what passes between them is small.

    A chunk's rows are a function from the vector after them to the one before, given for all
    vectors; along a conversation these are applied from the last chunk to the first, and then, with four
    walks of each chunk at hand, the states from the first to the last. One small row per chunk passes here.
    """

    def __init__(self, marked: DataFrame):
        parts = max(1, -(-marked.count() // CHUNK_ROWS))
        row = F.monotonically_increasing_id()
        keys = ["conv_id", *ORDER, "row"]
        ranged = marked.withColumn("row", row).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        place = row.bitwiseAND(F.lit((1 << 33) - 1))
        self.marked = materialize(ranged.withColumns({"chunk": F.spark_partition_id(), "place": place}).drop("row", "start"), "long-rows")
        self.rows = self.marked.where("present")
        first = self.rows.groupBy("conv_id", "role", "hash").agg(F.min(F.struct("chunk", "place")).alias("at"))
        first = first.selectExpr("at.chunk", "at.place", "true as is_first")
        self.light = materialize(
            self.rows.select("conv_id", "chunk", "place", "turn", F.expr("left(role, 1)").alias("initial"), "symbol")
            .join(first, ["chunk", "place"], "left")
            .withColumn("duplicate", F.expr(f"is_first is null and symbol <> {GONE}")).drop("is_first"),
            "long-marks",
        )
        self.pieces = self._edges(self._functions())

    def _functions(self) -> DataFrame:
        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            symbols = np.where(table.column("duplicate").to_numpy(), GONE, table.column("symbol").to_numpy()).astype(np.int64)
            every = np.arange(len(tables().vectors))[None, :]
            _, lefts, costs = look_up(symbols, np.array([0, len(symbols)]), every)
            marks = table.column("initial").to_pylist()
            illegal = sum(not legal(a, b) for a, b in zip(marks, marks[1:]))
            row = table.column("conv_id")[0].as_py(), table.column("chunk")[0].as_py(), symbols.astype(np.uint8).tobytes()
            row += lefts[0].astype("<i2").tobytes(), costs[0].astype("<i8").tobytes(), marks[0], marks[-1], illegal, False
            return pa.Table.from_batches([_table([row], PIECE)])

        return materialize(self.light.groupBy("conv_id", "chunk").applyInArrow(work, PIECE), "long-pieces")

    def _edges(self, pieces: DataFrame) -> DataFrame:
        """The pieces' chosen edits: conv_id, chunk, right, state, last, words (their numbers), cost, illegal."""
        scan = "conv_id bigint, chunk int, right int, cost bigint, illegal bigint, last boolean"

        def back(table: pa.Table) -> pa.Table:
            now, out, following = 0, [], None
            for row in sorted(table.to_pylist(), key=lambda r: -r["chunk"]):
                lefts, costs = np.frombuffer(row["lefts"], "<i2"), np.frombuffer(row["costs"], "<i8")
                cost, border = int(costs[now]), 0 if following is None else int(not legal(row["closes"], following))
                out.append([row["conv_id"], row["chunk"], now, cost, row["illegal"] + border, following is None])
                now, following = int(lefts[now]), row["opens"]
            out[-1][3] += int(tables().vectors[now, 0])
            return pa.Table.from_batches([_table(out, scan)])

        small = pieces.select("conv_id", "chunk", "lefts", "costs", "opens", "closes", "illegal")
        rights = materialize(small.groupBy("conv_id").applyInArrow(back, scan), "long-rights")
        walks = "conv_id bigint, chunk int, exits binary, words binary"

        def four(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    symbols, bounds = np.frombuffer(row["symbols"], np.uint8).astype(np.int64), np.array([0, len(row["symbols"])])
                    after, _, _ = look_up(symbols, bounds, np.array([row["right"]]))
                    tries = [walk(symbols, bounds, after, np.array([q])) for q in range(4)]
                    exits, words = bytes(int(end[0]) for _, end in tries), np.concatenate([w for w, _ in tries]).astype("<i2")
                    out.append((row["conv_id"], row["chunk"], exits, words.tobytes()))
                yield _table(out, walks)

        both = pieces.select("conv_id", "chunk", "symbols").withColumnsRenamed({"conv_id": "c", "chunk": "k"}).join(rights, F.expr("c <=> conv_id and k = chunk"))
        walked = materialize(both.select("conv_id", "chunk", "symbols", "right").mapInArrow(four, walks), "long-walks")
        entry = "c bigint, k int, state int"

        def forward(table: pa.Table) -> pa.Table:
            state, out = 0, []
            for row in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
                out.append((row["conv_id"], row["chunk"], state))
                state = row["exits"][state]
            return pa.Table.from_batches([_table(out, entry)])

        states = walked.select("conv_id", "chunk", "exits").groupBy("conv_id").applyInArrow(forward, entry)
        chosen = walked.join(states, F.expr("c <=> conv_id and k = chunk")).selectExpr(
            "conv_id", "chunk", "state", "substring(words, state * (length(words) div 4) + 1, length(words) div 4) as words"
        )
        facts = rights.selectExpr("conv_id as c", "chunk as k", "cost", "illegal", "last")
        return materialize(chosen.join(facts, F.expr("c <=> conv_id and k = chunk")).drop("c", "k"), "long-chosen")

    def repaired(self) -> DataFrame:
        def work(rows: pa.Table, plan: pa.Table) -> pa.Table:
            rows, chosen, names = rows.sort_by("place"), plan.to_pylist()[0], tables().words
            words = [names[w] for w in np.frombuffer(chosen["words"], "<i2").tolist()]
            texts = list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist()))
            edits = mended(words, texts, chosen["state"], chosen["last"])
            out = [(chosen["conv_id"], chosen["chunk"], i, *e) for i, e in enumerate(edits)]
            return pa.Table.from_batches([_table(out, REPAIRED)])

        rows = self.rows.select("conv_id", "chunk", "place", "role", "text").groupBy("conv_id", "chunk")
        plan = self.pieces.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "conv_id", "chunk", "state", "last", "words")
        return materialize(rows.cogroup(plan.groupBy("c", "k")).applyInArrow(work, REPAIRED), "long-repaired")

    def report(self) -> DataFrame:
        """A row per conversation. Its hash is taken by one task, which reads the sorted rows as a stream."""
        edits = self.repaired()
        facts = self.light.groupBy("conv_id").agg(
            F.expr("coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)").alias("gaps"), F.count_if(F.expr(f"symbol = {GONE}")).alias("blank"),
            F.count_if("duplicate").alias("duplicate"), F.count_if(F.expr(f"not duplicate and symbol <> {GONE} and symbol % 2 = 1")).alias("truncated"),
        )
        sums = self.pieces.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
        letters = edits.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "edit"))).alias("list"))
        letters = letters.selectExpr("conv_id", "chunk", "array_join(list.edit, '') as part")
        audits = letters.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("list"))
        audits = audits.selectExpr("conv_id", "array_join(list.part, '') as audit")
        schema = "conv_id bigint, repaired_sha256 string"

        def stream(batches):
            now, whole, empty, begun = None, hashlib.sha256(), True, False
            for batch in batches:
                done = []
                for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if not begun or conv_id != now:
                        if begun:
                            done.append((now, whole.hexdigest()))
                        now, whole, empty, begun = conv_id, hashlib.sha256(), True, True
                    if role is not None:
                        whole.update((("" if empty else "\n") + f"{role}:{text}").encode())
                        empty = False
                yield _table(done, schema)
            if begun:
                yield _table([(now, whole.hexdigest())], schema)

        ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
        out = self.marked.select("conv_id").distinct()
        for side in (facts, sums, audits, ordered.select("conv_id", "role", "text").mapInArrow(stream, schema)):
            out = out.join(side.withColumnRenamed("conv_id", "c"), F.expr("c <=> conv_id"), "left").drop("c")
        out = out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"])
        out = out.na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
        return out.select([c.split()[0] for c in REPORT.split(", ")])
