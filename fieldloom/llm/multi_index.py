"""Approximate nearest neighbours by inner product: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare
from fieldloom.session import materialize

#: About so many vectors of each length, those of the smallest hash, fit the centroids.
FIT_ROWS = 16_384
#: Centroids of a half: a third of the root of the number of vectors, at most this many.
MAX_CENTROIDS = 256
#: Vectors of an index block, and queries that visit it at a time.
BLOCK_ROWS = 16_384
LOT_ROWS = 16_384
#: Entries per wanted neighbour that give the first threshold of a query.
FIRST = 20
#: Pairs of centroids are visited while their inner product with the query is above the threshold
#: less this many standard deviations of what the residuals add.
MARGIN = 3.0
#: Queries of a visit that are scored at a time, and the fewest of a lot that only keeps cores busy.
SLICE = 256


class Book(NamedTuple):
    """Centroids of both halves of one vector length, and what is needed to assign and to stop."""

    cut: int
    centroids: tuple[np.ndarray, np.ndarray]
    bounds: tuple[float, float]
    variances: tuple[float, float]


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim), each once; without rows that have no id and vectors that are null,
    zero, empty or hold a null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = """vec_id is not null and vector is not null and exists(vector, x -> x <> 0)
        and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"""
    return rows.where(good).distinct().withColumn("dim", F.size("vector"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _halves(vectors: np.ndarray, cut: int, bounds) -> list[np.ndarray]:
    """Both halves with one component more, which gives all vectors of a half the same length:
    then the nearest centroid is the one of the largest inner product."""
    out = []
    for half, bound in zip((vectors[:, :cut], vectors[:, cut:]), bounds):
        more = np.sqrt(np.maximum(bound - (half * half).sum(axis=1), 0))
        out.append(np.column_stack([half, more]))
    return out


def _nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1) - 2 * rows @ centroids.T).argmin(axis=1)


def _means(rows: np.ndarray, count: int, rounds: int = 8) -> tuple[np.ndarray, float]:
    """Centroids by Lloyd's rounds from evenly spread rows, and the residuals' variance per component."""
    order = np.lexsort(rows.T[::-1])
    centroids = rows[order[np.linspace(0, len(rows) - 1, count).astype(int)]].copy()
    for _ in range(rounds):
        own = _nearest_centroid(rows, centroids)
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    left = rows - centroids[_nearest_centroid(rows, centroids)]
    return centroids, float((left * left).sum(axis=1).mean() / max(1, rows.shape[1] - 1))


def fit_books(entries: DataFrame) -> dict[int, Book]:
    """The centroids of every vector length, fitted in one task a length on about ``FIT_ROWS`` vectors.

    The lengths' bounds are taken over all vectors. One row per length comes to the driver.
    """
    square = "aggregate(slice(vector, {}), 0D, (s, x) -> s + x * x)"
    low, high = square.format("1, dim div 2"), square.format("dim div 2 + 1, dim")
    facts = entries.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr(low)).alias("low"), F.max(F.expr(high)).alias("high"))
    facts = materialize(facts, "multi-index-facts")
    parts = 1 << 30
    sample = entries.join(facts, "dim").where(f"pmod(xxhash64(vector), {parts}) < {parts} * ({FIT_ROWS} / n)")

    def fit(table: pa.Table) -> pa.Table:
        dim, n = table.column("dim")[0].as_py(), table.column("n")[0].as_py()
        bounds = (table.column("low")[0].as_py(), table.column("high")[0].as_py())
        count = max(1, min(MAX_CENTROIDS, int(n**0.5 / 3), table.num_rows))
        halves = _halves(_matrix(table.column("vector"), dim), dim // 2, bounds)
        (first, v1), (second, v2) = (_means(rows, count) for rows in halves)
        row = {"dim": pa.array([dim], pa.int32()), "books": [[first.tobytes(), second.tobytes()]], "low": [bounds[0]], "high": [bounds[1]], "v1": [v1], "v2": [v2]}
        return pa.table(row)

    fitted = sample.groupBy("dim").applyInArrow(fit, "dim int, books array<binary>, low double, high double, v1 double, v2 double")
    books = {}
    for row in fitted.collect():
        cut = row.dim // 2
        tables = [np.frombuffer(b, np.float64).reshape(-1, d + 1) for b, d in zip(row.books, (cut, row.dim - cut))]
        books[row.dim] = Book(cut, tuple(tables), (row.low, row.high), (row.v1, row.v2))
    return books


class Index(NamedTuple):
    """Vectors with their block, the centroids, and per length the places of each cell's blocks."""

    rows: DataFrame
    books: dict[int, Book]
    counts: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    parts: dict[int, np.ndarray]


def build_index(vectors: DataFrame, ids: int) -> Index:
    """Every distinct vector with its ``ids`` smallest ids, in the cell of its two nearest centroids.

    Cells, in order, fill blocks of ``BLOCK_ROWS`` vectors; a larger cell is dealt over several
    blocks of its own. The driver holds centroids and cell counts, at most ``MAX_CENTROIDS`` squared a length.
    """
    spark = vectors.sparkSession
    prepare(spark)
    nth = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("vec_id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= ids)
    entries = few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries, "multi-index-entries")
    books = fit_books(entries)

    def assign(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                places = np.flatnonzero(dims == dim)
                book = books[dim]
                halves = _halves(_matrix(batch.column("vector").take(pa.array(places)), dim), book.cut, book.bounds)
                near = [_nearest_centroid(rows, c) for rows, c in zip(halves, book.centroids)]
                cells[places] = near[0] * len(book.centroids[1]) + near[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    rows = materialize(entries.mapInArrow(assign, "dim int, vector array<double>, ids array<bigint>, cell int"), "multi-index-cells")
    sizes: dict[int, np.ndarray] = {d: np.zeros(len(b.centroids[0]) * len(b.centroids[1]), np.int64) for d, b in books.items()}
    for row in rows.groupBy("dim", "cell").count().toLocalIterator():
        sizes[row.dim][row.cell] = row["count"]
    first, parts, table = {}, {}, []
    for dim, counts in sizes.items():
        first[dim], parts[dim] = _blocks(counts)
        table += [(dim, c, int(first[dim][c]), int(parts[dim][c])) for c in np.flatnonzero(counts).tolist()]
    places = spark.createDataFrame(table, "dim int, cell int, first int, parts int")
    block = F.expr("first + cast(pmod(xxhash64(vector), parts) as int)")
    placed = rows.join(F.broadcast(places), ["dim", "cell"]).withColumn("block", block).drop("first", "parts")
    return Index(placed, books, sizes, first, parts)


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell."""
    first, parts = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    block, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-n // BLOCK_ROWS))
        held += n
        if parts[cell] > 1:
            block, held = block + parts[cell], 0
    return first, parts


def pairs_by_distance(first: np.ndarray, second: np.ndarray):
    """(sum, i, j) of every pair of a value of ``first`` and one of ``second``, by rising sum, from a heap."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    one, two = one.tolist(), two.tolist()
    heap = [(a[0] + b[0], 0, 0)] if a and b else []
    while heap:
        total, i, j = heapq.heappop(heap)
        yield total, one[i], two[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def cells_to_visit(query: np.ndarray, book: Book, counts: np.ndarray, first: int, threshold: float | None, margin: float = MARGIN) -> list[int]:
    """Without a threshold the nearest cells that hold ``first`` vectors; with one the cells after
    these, down to the threshold less ``margin`` standard deviations of the residuals' share."""
    halves = (query[: book.cut], query[book.cut :])
    near = [c[:, :-1] @ h for h, c in zip(halves, book.centroids)]
    lengths = [(c * c).sum(axis=1) for c in book.centroids]
    spread = sum(float(h @ h) * v for h, v in zip(halves, book.variances)) ** 0.5
    limit = -np.inf if threshold is None else threshold - margin * spread
    longest = float(lengths[0].max() + lengths[1].max())
    cells, held, width = [], 0, len(book.centroids[1])
    for total, i, j in pairs_by_distance(lengths[0] - 2 * near[0], lengths[1] - 2 * near[1]):
        cell, before = i * width + j, held < first
        # All later pairs have an inner product with the query of at most (longest - total) / 2.
        if not before and (threshold is None or (longest - total) / 2 < limit):
            break
        n = int(counts[cell])
        if n and before == (threshold is None) and near[0][i] + near[1][j] >= limit:
            cells.append(cell)
        held += n
    return cells


def _visits(asked: DataFrame, index: Index, first: int, margin: float) -> DataFrame:
    """One row per query and index block, with the cells to score there."""
    held = asked.sparkSession.sparkContext.broadcast((index.books, index.counts, index.first, index.parts))

    def visit(batches):
        books, counts, firsts, parts = held.value
        for batch in batches:
            out = {"q": [], "dim": [], "block": [], "query": [], "cells": []}
            rows = zip(*(batch.column(c).to_pylist() for c in ("q", "dim", "vector", "threshold")))
            for q, dim, vector, threshold in rows:
                query = np.array(vector)
                blocks: dict[int, list[int]] = {}
                for cell in cells_to_visit(query, books[dim], counts[dim], first, threshold, margin):
                    at = int(firsts[dim][cell])
                    for block in range(at, at + int(parts[dim][cell])):
                        blocks.setdefault(block, []).append(cell)
                for block, cells in blocks.items():
                    for column, value in zip(out.values(), (q, dim, block, query.tobytes(), np.array(cells, "<i4").tobytes())):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    # As many tasks as the session shuffles into: queries are small, the work on them is not.
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.select("q", "dim", "vector", "threshold").repartition(parts, "q")
    return materialize(rows.mapInArrow(visit, "q bigint, dim int, block int, query binary, cells binary"), "multi-index-visits")


def _score(index: Index, visits: DataFrame, keep: int) -> DataFrame:
    """(q, vec_id, score): for each visit the ``keep`` best ids in the block's cells."""
    cores = visits.sparkSession.sparkContext.defaultParallelism
    blocks = sum(int((f[c > 0] + p[c > 0]).max(initial=0)) for c, f, p in zip(index.counts.values(), index.first.values(), index.parts.values()))
    spare = -(-2 * cores // max(1, blocks))
    lots = visits.groupBy("dim", "block").agg(F.expr(f"cast(greatest(ceil(count(*) / {LOT_ROWS}), least({spare}, ceil(count(*) / {SLICE}))) as int)").alias("lots"))
    left = index.rows.join(lots, ["dim", "block"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    right = visits.join(lots, ["dim", "block"]).selectExpr(
        "dim as d", "block as b", "cast(pmod(xxhash64(q), lots) as int) as l", "q", "query", "cells"
    )

    def work(rows: pa.Table, guests: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows and guests.num_rows:
            rows = rows.sort_by("cell")
            vectors = _matrix(rows.column("vector"), rows.column("dim")[0].as_py())
            cells, ids = rows.column("cell").to_numpy(), rows.column("ids").to_pylist()
            for at in range(0, guests.num_rows, SLICE):
                _best(vectors, cells, ids, guests.slice(at, SLICE), keep, out)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "vec_id", "score"])

    cells = left.groupBy("dim", "block", "lot").cogroup(right.groupBy("d", "b", "l"))
    return cells.applyInArrow(work, "q bigint, vec_id bigint, score double")


def _best(vectors: np.ndarray, cells: np.ndarray, ids: list, guests: pa.Table, keep: int, out: tuple) -> None:
    queries = np.array([np.frombuffer(b) for b in guests.column("query").to_pylist()])
    wanted = [np.frombuffer(b, "<i4") for b in guests.column("cells").to_pylist()]
    guest = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    flat = np.concatenate(wanted)
    order = np.argsort(flat, kind="stable")
    flat, guest = flat[order], guest[order]
    names, at = np.unique(flat, return_index=True)
    scores = np.full((len(queries), len(vectors)), -np.inf)
    for name, a, b in zip(names, at, [*at[1:], len(flat)]):
        low, high = np.searchsorted(cells, (name, name + 1))
        if high > low:
            scores[guest[a:b], low:high] = queries[guest[a:b]] @ vectors[low:high].T
    lengths = np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1).max())
    for q, query, row, length in zip(guests.column("q").to_pylist(), queries, scores, lengths):
        low = np.partition(row, len(row) - keep)[len(row) - keep] if len(row) > keep else -np.inf
        found = np.flatnonzero((row >= low - 1e-12 * length) & (row > -np.inf))
        # The products of a matrix are rounded by the place of a row; these are not.
        exact = (vectors[found] * query).sum(axis=1)
        best = heapq.nsmallest(keep, ((-s, i) for s, place in zip(exact.tolist(), found.tolist()) for i in ids[place]))
        out[0].extend([q] * len(best))
        out[1].extend(i for _, i in best)
        out[2].extend(-s for s, _ in best)


def _ranked(found: DataFrame, key: str, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, vec_id, score: per query about its k vectors of largest inner product, without its own id.

    ``vectors`` and ``queries`` are tables as ``clean_vectors`` gives them; only vectors of the
    query's length are compared. Every vector is in the index. A query first scores the nearest
    cells that hold ``FIRST * k`` vectors; the last of its k + 1 best scores then is the threshold
    less ``margin`` deviations, down to which further pairs of centroids are visited, by summed distance
    from a heap; a larger margin finds more and scores more. So
    vectors in tight groups cost few cells and spread ones many.

    Equal vectors are one entry with their k + 1 smallest ids and equal queries are asked once,
    which loses nothing, as ties go to smaller ids. A repeated row counts once; an id with two
    vectors is both. With fewer than k other vectors, all found; empty tables give an empty result.
    Scores are sums of products in double precision, infinite or not a number where that overflows.
    """
    index = build_index(vectors, k + 1)
    asked = queries.groupBy("dim", "vector").count().drop("count")
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "multi-index-queries")
    asked = asked.join(F.broadcast(index.rows.select("dim").distinct()), "dim", "left_semi")
    near = _visits(asked.withColumn("threshold", F.lit(None).cast("double")), index, FIRST * k, margin)
    near = materialize(_ranked(_score(index, near, k + 1), "q", k + 1), "multi-index-first")
    low = near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("threshold"))
    far = _visits(asked.join(low, "q"), index, FIRST * k, margin)
    both = near.drop("rank").unionByName(_score(index, far, k + 1))
    found = _ranked(both, "q", k + 1).drop("rank")
    askers = queries.join(asked, ["dim", "vector"]).select(F.col("vec_id").alias("query_id"), "q")
    named = askers.join(found, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
