"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import mapper, per_row, prepare, Rolling, rolling_bytes, slices, text_bytes, word_spans

# Highest share of word characters inside n-grams that repeat an earlier
# one, by n, and inside repeated lines.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20
LINE_COUNT_SHARE = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"[#*$%&|<>]"[1:-1]

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_chars bigint, "
    + ", ".join(f"dup_{n}gram_chars bigint" for n in NGRAM_SHARES)
)


def _covered(hashes: Rolling, n: int, rows: np.ndarray, first: bool) -> np.ndarray:
    """Marks the words inside n-word windows that their row holds twice or more.

    Without ``first``, the first occurrence of each window marks nothing.
    """
    marks = np.zeros(len(rows), bool)
    if len(rows) < n:
        return marks
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    keys = hashes(at, at + n) ^ (rows[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return marks
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = twice[place] == keys
    hits = at[hit]
    if not first:
        hits = np.delete(hits, np.unique(keys[hit], return_index=True)[1])
    edges = np.zeros(len(rows) + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + n, -1)
    return np.cumsum(edges[:-1]) > 0


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the latter's word characters."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return int(bool(text.split())), 0, 0
    seen, n, dup, chars = set(), 0, 0, 0
    for line in lines:
        words = line.split()
        if not words:
            continue
        n += 1
        if line in seen:
            dup += 1
            chars += len(b"".join(words).decode("utf-8", "replace"))
        else:
            seen.add(line)
    return n, dup, chars


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts and verdicts of a slice of documents (columns doc_id, text without nulls)."""
    n = batch.num_rows
    data, bounds = text_bytes(batch.column("text"))
    starts, ends, rows = word_spans(data, bounds)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    n_symbols = symbols[bounds[1:]] - symbols[bounds[:-1]]
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    word_chars = per_row(chars, rows, n)
    hashes = Rolling(rolling_bytes(data)(starts, ends))
    repeat = per_row(_covered(hashes, 3, rows, True).astype(np.int64), rows, n)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)

    raw = data.tobytes()
    lines = np.array([_lines(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int64).reshape(n, 3)
    bad = (lines[:, 1] > LINE_COUNT_SHARE * lines[:, 0]) | (lines[:, 2] > LINE_SHARE * word_chars)
    grams = []
    for size, share in NGRAM_SHARES.items():
        inside = per_row(np.where(_covered(hashes, size, rows, False), chars, 0), rows, n)
        bad |= inside > share * word_chars
        grams.append(pa.array(inside))
    columns = [
        batch.column("doc_id"),
        *map(pa.array, (n_words, word_chars, n_symbols.astype(np.int64), lines[:, 1], repeat, failed, ~failed & ~bad)),
        pa.array(lines[:, 2]),
        *grams,
    ]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, covered characters and ``kept``.

    Characters (code points of words) inside n-grams of 5 to 10 words that repeat an
    earlier n-gram of the text are found with rolling 64-bit hashes; a text is rejected if they exceed the share for any n, if repeated
    lines hold too many of its lines or characters, or if the base rule fails.
    A null text is empty, an empty text has no words and fails the base rule; a null id
    stays null; repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(mapper(measure), SCHEMA)


def drop_repetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is reached row by row, so rows need no key; extra columns pass through.
    """
    prepare(docs.sparkSession)
    schema = docs.schema

    def keep(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
            ids = pa.array(np.arange(batch.num_rows))
            bare = pa.RecordBatch.from_arrays([ids, text], names=["doc_id", "text"])
            kept = [part.column("kept") for part in map(measure, slices(bare))]
            yield batch.filter(pa.concat_arrays(kept)) if kept else batch

    return docs.mapInArrow(keep, schema)
