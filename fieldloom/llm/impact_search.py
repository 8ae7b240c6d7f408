"""Exact top-k inner products with impact-ordered postings, processed score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare
from fieldloom.session import materialize

#: Vectors of an index block, most queries that visit it at a time, posting segments per dimension.
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
SEGMENTS = 8
#: Fewest queries of a lot where lots are made to keep all cores busy.
FEW_ROWS = 256
#: Fixed-point factor of the components.
SCALE = 256

INDEX = "dim int, block bigint, ids binary, values binary, postings binary, highs binary, lows binary"


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim): components as floor(256 x), those beyond a long as its ends; rows
    without id, null vectors and vectors with a null or non-finite component are left out."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = "vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(good).selectExpr(
        "vec_id", f"transform(vector, x -> cast(floor({SCALE} * x) as bigint)) as vector", "size(vector) as dim"
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), dim)


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per block of vectors of one dimension count, with the block's postings.

    For every dimension a block lists its rows by falling value, cut into segments with
    their highest and lowest value. Rows are dealt evenly, whatever their ids or values.
    """
    prepare(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        values = _matrix(table.column("vector"), dim)
        order = np.argsort(-values, axis=0, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(values, order, axis=0)
        edges = _edges(len(values))
        row = [
            dim,
            table.column("block")[0].as_py(),
            table.column("vec_id").to_numpy().astype("<i8").tobytes(),
            values.astype("<i8").tobytes(),
            np.ascontiguousarray(order.T).astype("<i4").tobytes(),
            np.ascontiguousarray(ordered[edges[:-1]].T).astype("<i8").tobytes(),
            np.ascontiguousarray(ordered[edges[1:] - 1].T).astype("<i8").tobytes(),
        ]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    dealt = vectors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    return materialize(dealt.groupBy("dim", "block").applyInArrow(build, INDEX), "impact-index")


def _edges(n: int) -> np.ndarray:
    """Bounds of up to ``SEGMENTS`` runs of ``n`` places, none empty."""
    return np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(np.int64))


class Block:
    """Postings of one block of vectors, read from an index row."""

    def __init__(self, row: dict):
        dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        self.edges = _edges(n)
        self.values = np.frombuffer(row["values"], "<i8").reshape(n, dim)
        self.most = max(abs(int(self.values.max(initial=0))), abs(int(self.values.min(initial=0))))
        # NumPy adds at places of its own index type without converting them at every step.
        self.postings = np.frombuffer(row["postings"], "<i4").reshape(dim, n).astype(np.intp)
        self.highs = np.frombuffer(row["highs"], "<i8").reshape(dim, len(self.edges) - 1)
        self.lows = np.frombuffer(row["lows"], "<i8").reshape(dim, len(self.edges) - 1)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to smaller ids.

        A segment's impact is the most it can add to a score beyond its dimension's
        worst segment. Segments are taken by falling impact and added to their rows; what a row
        may still gain is at most the sum over dimensions of the best segment not taken.
        Rows whose bound stays below k exact scores are out. The loop ends when few rows
        are left or all segments are taken; the rows left are scored exactly.
        """
        allowed = self.ids != own
        if len(query) and len(query) * self.most * max(abs(int(query.max())), abs(int(query.min()))) >= 1 << 62:
            return self._wide(np.flatnonzero(allowed), query, k)
        n, parts = len(self.ids), len(self.edges) - 1
        if not len(query):
            return self._best(np.flatnonzero(allowed), query, k)
        best = np.where(query[:, None] >= 0, query[:, None] * self.highs, query[:, None] * self.lows)
        floor = best.min(axis=1)
        gains = best - floor[:, None]
        order = np.argsort(-gains, axis=None, kind="stable")
        # What each dimension may still add, before each step.
        rest = int(gains.max(axis=1).sum())
        bound, base = np.zeros(n, np.int64), int(floor.sum())
        check, threshold, left = len(order) // 4, None, None
        heads = [list(-np.sort(-g)) + [0] for g in gains]
        taken = [0] * len(query)
        for step, place in enumerate(order.tolist()):
            d, s = divmod(place, parts)
            gain = int(gains[d, s])
            if gain == 0:
                break
            bound[self.postings[d, self.edges[s] : self.edges[s + 1]]] += gain
            rest -= int(heads[d][taken[d]] - heads[d][taken[d] + 1])
            taken[d] += 1
            if step == check:
                check = step + max(1, len(order) // 8)
                if threshold is None:
                    threshold = self._threshold(bound, allowed, query, k)
                if threshold is not None:
                    left = np.flatnonzero((base + bound + rest >= threshold) & allowed)
                    if len(left) <= 8 * k:
                        return self._best(left, query, k)
        if threshold is None:
            threshold = self._threshold(bound, allowed, query, k)
        left = np.flatnonzero(allowed if threshold is None else (base + bound + rest >= threshold) & allowed)
        return self._best(left, query, k)

    def _threshold(self, bound: np.ndarray, allowed: np.ndarray, query: np.ndarray, k: int) -> int | None:
        """The k-th best exact score among the rows that look best; none if there are fewer."""
        rows = np.flatnonzero(allowed)
        if len(rows) <= k:
            return None
        rows = rows[np.argpartition(-bound[rows], min(4 * k, len(rows) - 1))[: 4 * k]]
        return int(np.sort(self.values[rows] @ query)[-k]) if len(rows) >= k else None

    def _wide(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``_best`` for sums that may not fit a long: exact, and its ends beyond it."""
        exact = (self.values[rows].astype(object) @ query.astype(object)).tolist()
        scores = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact]
        best = sorted(zip((-s for s in scores), self.ids[rows].tolist()))[:k]
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per query row its k vectors of highest integer inner product, without its own id.

    ``vectors`` and ``queries`` are tables as ``clean_vectors`` gives them; only vectors of
    the query's length are compared. Queries visit every block of the index, in lots of
    ``QUERY_ROWS`` (fewer while there are less blocks than cores), and a block is copied for every
    lot; each visit gives k rows per query, which are merged by rank. Ties go to the smaller
    vec_id; fewer than k vectors give them all; a repeated query row gives its rows
    again; empty tables give an empty result. Scores are exact; beyond a long they stop at its ends.
    """
    index = build_index(vectors)
    asked = materialize(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = index.groupBy("dim").agg(F.count("*").alias("blocks"))
    # One row per length: how many lots its queries make, by their number.
    lots = asked.groupBy("dim").agg(F.count("*").alias("n")).join(blocks, "dim").selectExpr(
        "dim", f"cast(greatest(ceil(n / {QUERY_ROWS}), least(ceil({2 * cores} / blocks), ceil(n / {FEW_ROWS}))) as int) as lots"
    )
    visits = index.join(lots, "dim").withColumn("lot", F.explode(F.expr("sequence(0, lots - 1)")))
    guests = asked.join(lots, "dim").withColumn("lot", F.expr("cast(pmod(xxhash64(query), lots) as int)")).join(index.select("dim", "block"), "dim")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            block = Block(left.to_pylist()[0])
            asked = _matrix(right.column("vector"), right.column("dim")[0].as_py())
            for query, own, vector in zip(right.column("query").to_pylist(), right.column("vec_id").to_pylist(), asked):
                ids, scores = block.search(vector, own, k)
                out[0].extend([query] * len(ids))
                out[1].extend([own] * len(ids))
                out[2].extend(ids.tolist())
                out[3].extend(scores.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query", "query_id", "vec_id", "score"])

    guests = guests.selectExpr("dim as d", "block as b", "lot as l", "dim", "query", "vec_id", "vector")
    cells = visits.groupBy("dim", "block", "lot").cogroup(guests.groupBy("d", "b", "l"))
    found = cells.applyInArrow(visit, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
