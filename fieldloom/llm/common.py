"""Helpers inside tasks: bounded slices of Arrow batches, words and rolling hashes in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from fieldloom.session import ship_package

#: Text bytes that one step inside a task works on; a longer text is a step of its own.
SLICE_BYTES = 4_000_000

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


#: Rows per Arrow batch: whole texts are long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and bound the batches that go to Python."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_column(schema: StructType, name: str, kind: str) -> StructType:
    """A copy of ``schema`` with one column more."""
    return StructType([*schema.fields, StructField(name, _parse_datatype_string(kind))])


def _separators(chars: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(chars)] = False
    return table


#: True for the bytes of a word ``[^\x20\x09-\x0D]+``.
WORD_BYTES = _separators(b" \t\n\x0b\x0c\r")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the rows' bounds in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    _, bounds, data = column.buffers()
    if n == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(bounds, kind, n + 1, at * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])), bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, ...]:
    """Start, end and row of every run of ``inside`` bytes; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    is_word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], is_word[:-1]]) & ~edge[:-1]
    after = np.concatenate([is_word[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any runs of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(1, len(values)))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + length * _BASE)


def rolling_bytes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE[data])


def per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Whole-number sums of ``values`` by row."""
    sums = np.zeros(n_rows, np.int64)
    np.add.at(sums, rows, values) if len(rows) < 64 else sums.__iadd__(np.bincount(rows, values, n_rows).astype(np.int64))
    return sums


def mapper(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """A ``mapInArrow`` function that applies ``work`` to bounded slices."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield work(part)

    return run
