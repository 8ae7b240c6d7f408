"""SimHash near-duplicates by way of anchors from a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh, prepare, slices, text_bytes, with_column
from fieldloom.llm.components import components
from fieldloom.session import materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of one anchor that a task compares with as many others at a time.
BLOCK = 4096


def _fingerprint(text: bytes, digest) -> int:
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return digest(whole, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE_WORDS].tolist()]
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for first in range(0, n, 1 << 16):
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[first : first + (1 << 16)], stops[first : first + (1 << 16)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a 64-bit SimHash as a (signed) bigint column ``out``.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles three words joined
    by a space, repeats included; a text of fewer words is one shingle, one without words
    has fingerprint zero; so has a null text. All columns and rows pass through.
    """
    prepare(docs.sparkSession)
    schema = with_column(docs.schema, out, "bigint")

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
            prints = []
            for part in slices(pa.RecordBatch.from_arrays([text], names=["text"])):
                data, bounds = text_bytes(part.column("text"))
                raw = data.tobytes()
                prints += [_fingerprint(raw[a:b], xxh64_intdigest) for a, b in zip(bounds[:-1], bounds[1:])]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


_MASKS = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
_LOW = np.uint64((1 << 31) - 1)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that fingerprints go to: (index, anchor, whether it is the home anchor).

    Three differing bits leave at most one in one of the two 32-bit halves. Anchors of a
    half are the words whose low 31 bits lie in the Hamming code [31, 26], which covers
    every half within one bit: the nearest is its home. A fingerprint also goes to all
    anchors within radius plus threshold, 1 + 1 bits, so two halves that differ in one
    bit at most meet at the home of either.
    """
    index, anchor, home = [], [], []
    every = np.arange(len(prints))
    for half in range(2):
        word = prints >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        low, top = word & _LOW, word & ~_LOW
        syndrome = sum((np.bitwise_count(low & m) & 1).astype(np.uint64) << np.uint64(k) for k, m in enumerate(_MASKS))
        off = syndrome > 0
        nearest = low ^ np.where(off, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
        mark = np.uint64(half << 32)
        found = [(every, nearest | top, True), (every, nearest | (top ^ np.uint64(1 << 31)), False)]
        for p in range(1, 32):
            q = np.uint64(p) ^ syndrome
            two = off & (q > p)
            found.append((every[two], low[two] ^ np.uint64(1 << (p - 1)) ^ (np.uint64(1) << (q[two] - np.uint64(1))) | top[two], False))
        for at, code, is_home in found:
            index.append(at)
            anchor.append(code | mark)
            home.append(np.full(len(at), is_home))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _forest(prints: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links between homes and all members join."""
    label, edges, parts = np.arange(len(prints)), [], len(prints)
    for i in np.flatnonzero(homes):
        near = np.unique(label[np.bitwise_count(prints ^ prints[i]) <= MAX_BITS])
        if len(near) > 1:
            edges += [(int(prints[near[0]]), int(prints[k])) for k in near[1:]]
            label[np.isin(label, near[1:])] = near[0]
            parts -= len(near) - 1
            if parts == 1:
                break
    return edges


def _cell_edges(batches):
    """Edges of each run of rows with one (anchor, cell); rows come ordered by it."""
    names = ("anchor", "cell", "fingerprint", "is_home")
    rest = None

    def edges(rows, last):
        anchor, cell, prints, homes = rows
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(cell) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        found = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            found += _forest(prints[a:b], homes[a:b])
        done = ends[-1] if len(ends) else 0
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
        return out, [x[done:] for x in rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        rows[2] = rows[2].view(np.uint64)
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        out, rest = edges(rows, False)
        yield out
    if rest is not None and len(rest[0]):
        yield edges(rest, True)[0]


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that join all fingerprints within ``MAX_BITS`` bits, per anchor.

    ``prints`` holds each fingerprint once. Members of an anchor are split over blocks of
    homes and blocks of members, so no task gets more than two blocks of a hot anchor; a
    block pair gives a spanning forest of its links, never all pairs.
    """
    prepare(prints.sparkSession)

    def replicate(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 15):
                some = batch.column("fingerprint").slice(first, 1 << 15).to_numpy().view(np.uint64)
                index, anchor, home = anchors(some)
                columns = [pa.array(anchor.view(np.int64)), pa.array(some[index].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fingerprint", "is_home"])

    copies = prints.select("fingerprint").mapInArrow(replicate, "anchor bigint, fingerprint bigint, is_home boolean")
    counts = copies.groupBy("anchor").agg(F.count("*").alias("members"), F.count_if("is_home").alias("homes"))
    shared = counts.where("members > 1 and homes > 0").selectExpr(
        "anchor", f"ceil(members / {BLOCK}) as member_blocks", f"ceil(homes / {BLOCK}) as home_blocks"
    )
    # Spark takes copies for as few as the fingerprints and would broadcast them.
    placed = copies.join(shared.hint("merge"), "anchor").withColumn("draw", F.xxhash64("fingerprint", F.lit(1)))
    # A row is in its own column of cells as a member; a home is in its own row of cells too.
    cells = placed.selectExpr(
        "anchor", "fingerprint", "is_home", "member_blocks", "pmod(draw, member_blocks) as column",
        "if(is_home, pmod(draw, home_blocks), -1) as line",
        "explode(array_distinct(concat(transform(sequence(0, home_blocks - 1), h -> h * member_blocks + pmod(draw, member_blocks)),"
        " if(is_home, transform(sequence(0, member_blocks - 1), m -> pmod(draw, home_blocks) * member_blocks + m), array())))) as cell",
    ).selectExpr("anchor", "cell", "fingerprint", "line = cell div member_blocks as is_home")
    ordered = cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "fingerprint")
    return ordered.mapInArrow(_cell_edges, "u bigint, v bigint").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """Per distinct fingerprint of (doc_id, fingerprint) its class and smallest doc_id.

    ``component`` is the class's smallest fingerprint. Equal fingerprints are one before
    anything is compared; ids that are null do not count for the smallest.
    """
    distinct = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprints")
    stars = components(links(distinct)).select(F.col("u").alias("fingerprint"), F.col("v").alias("component"))
    labelled = distinct.join(stars.hint("merge"), "fingerprint", "left").selectExpr(
        "fingerprint", "first", "coalesce(component, fingerprint) as component"
    )
    lowest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return labelled.join(lowest, "component").select("fingerprint", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint (hex) and the smallest doc_id reachable by links.

    Documents link at ``MAX_BITS`` or fewer differing bits. Empty and null texts have
    fingerprint zero and link like any other; a class of null ids alone has a null
    component_id; repeated rows stay; other columns are ignored; an empty table gives an
    empty one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(fingerprints(rows).drop("text"), "documents")
    # A left join, for which the rows, packed small in their file, are not broadcast.
    return rows.join(classes(rows), "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one of the smallest id, with all its columns.

    A null id comes after all others; of rows with one id the first as stored stays.
    """
    row, mark = fresh(docs, "row"), fresh(docs, "fingerprint")
    marked = materialize(fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), text_col, mark), "marked")
    rows = marked.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(mark).alias("fingerprint"), F.col(row).alias("row"))
    of_class = rows.join(classes(rows), "fingerprint", "left").groupBy("component")
    stay = of_class.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select(F.col("best.row").alias(row))
    return marked.join(stay, row, "left_semi").select(*docs.columns)
