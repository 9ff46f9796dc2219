"""Exact top-k by inner product with a three-phase uniform threshold.

The components are cut in SLICES parts; each part's scores are a list of their own and a total is the sum of a vector's entries in all lists.

1. Each task gives, for each query and list, its K best entries; their totals are worked out, and the K-th best total per query is a
   floor that the true K-th best cannot fall below.
2. That cutoff is broadcast. A total of at least the cutoff has an entry of at least cutoff / SLICES in some list, so the tasks collect the entries
   that reach it in any list, and no others can be in the result.
3. The rest of the scores of the collected entries is worked out exactly; those below the cutoff go, and each query keeps its K best, ties to the smaller id.

Queries come in blocks of at most QUERY_ROWS rows and QUERY_BYTES (a bounded broadcast) that pass over all candidates; a task keeps at most K entries
per query and list, so equal vectors in any number don't grow its result.

Scores are sums of whole numbers in double precision, which is exact while components are small. Pairs with a component so large that it might not be are scored in
whole numbers of any size by themselves; such scores beyond 64 bits are given as the greatest or least long.

Nulls and edges: vectors that are null or have a null, NaN or infinite component take no part, nor do null ids. Vectors of different length
are compared as if the shorter went on with zeros. Rows that repeat an id are rows of their own, as candidates and as queries (the K best of such a query are those of all its rows
together), but no row with the query's id is its candidate. Queries with no candidate have no rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import column, written

SLICES = 4
QUERY_ROWS, QUERY_BYTES = 50_000, 64 << 20
#: Queries and candidates scored at once in a task.
QUERY_STEP, ROW_STEP = 256, 4096


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, v): floor(scale x) of each component x as double."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok).select("vec_id", v.alias("v"))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    col = column(batch, "v")
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    return _matrix(np.split(flat, np.cumsum(ends)[:-1]) if len(ends) else [], width)


def _slices(width: int) -> list[slice]:
    cuts = np.linspace(0, width, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of its k greatest scores, ties to the smaller id; ids are sorted."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    edge = np.partition(score, -k, axis=1)[:, -k][:, None]
    # columns above the edge, then those on the edge in order of ids
    order = np.argsort(-np.where(score > edge, 2, np.where(score == edge, 1, 0)), axis=1, kind="stable")
    return order[:, :k]


class _Block:
    """Queries of one block with what the tasks know of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cutoff: np.ndarray | None = None):
        self.ids, self.vectors, self.cutoff = ids, vectors, cutoff


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (ids, vectors) in runs of about ROW_STEP rows, sorted by id."""
    ids, rows, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_STEP):
            part = batch.slice(at, ROW_STEP)
            ids.append(column(part, "vec_id").to_numpy())
            rows.append(_vectors(part, width))
            n += part.num_rows
            if n >= ROW_STEP:
                order = np.argsort(i := np.concatenate(ids), kind="stable")
                yield i[order], np.concatenate(rows)[order]
                ids, rows, n = [], [], 0
    if n:
        order = np.argsort(i := np.concatenate(ids), kind="stable")
        yield i[order], np.concatenate(rows)[order]


def _task(batches: Iterator[pa.RecordBatch], block: _Block, k: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows (query, vec_id, score): in the first phase the totals of each list's best, later of all that the cutoff lets through."""
    width = block.vectors.shape[1]
    parts = _slices(width)
    kept: dict[int, list[tuple[float, int]]] = {}
    for ids, rows in _steps(batches, width):
        for at in range(0, len(block.ids), QUERY_STEP):
            own = block.vectors[at : at + QUERY_STEP]
            lists = [own[:, s] @ rows[:, s].T for s in parts]
            mine = block.ids[at : at + QUERY_STEP][:, None] == ids[None, :]
            if first:
                # a row may be its own query's entry in a list, so one more place each
                cols = np.concatenate([_best(np.where(mine, -np.inf, x), ids, k) for x in lists], axis=1)
                q = np.broadcast_to(np.arange(len(own))[:, None], cols.shape).ravel()
                pairs = np.unique(q * len(ids) + cols.ravel())
                q, c = pairs // len(ids), pairs % len(ids)
            else:
                floor = block.cutoff[at : at + QUERY_STEP][:, None]
                collected = np.zeros(mine.shape, dtype=bool)
                for x in lists:
                    collected |= x >= floor / len(parts)
                q, c = np.nonzero(collected)
            total = sum((x[q, c] for x in lists), np.zeros(len(q)))
            ok = ~mine[q, c]
            if not first:
                ok &= total >= block.cutoff[at : at + QUERY_STEP][q]
            q, c, total = q[ok], c[ok], total[ok]
            order = np.lexsort((ids[c], -total, q))
            q, c, total = q[order], c[order], total[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            for i, v, s in zip((at + q[rank < k]).tolist(), ids[c[rank < k]].tolist(), total[rank < k].tolist()):
                kept.setdefault(i, []).append((-s, v))
        for i, found in kept.items():
            if len(found) > 4 * k:
                kept[i] = sorted(found)[:k]
    flat = [(int(block.ids[i]), v, int(-s)) for i, found in kept.items() for s, v in sorted(found)[:k]]
    if flat:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat)], names=["query_id", "vec_id", "score"])


def _exact(batches: Iterator[pa.RecordBatch], block: _Block, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query, vec_id, score) of the k best of each query, in whole numbers of any size."""
    width = block.vectors.shape[1]
    own = [[int(x) for x in v] for v in block.vectors]
    kept: list[list[tuple[int, int]]] = [[] for _ in own]
    for ids, rows in _steps(batches, width):
        for i, v in zip(ids.tolist(), rows):
            other = [int(x) for x in v]
            for q, (query, mine) in enumerate(zip(own, block.ids.tolist())):
                if mine != i:
                    kept[q].append((-sum(map(int.__mul__, query, other)), i))
                    if len(kept[q]) > 8 * k:
                        kept[q] = sorted(kept[q])[:k]
    most = (1 << 63) - 1
    flat = [(int(block.ids[q]), i, max(-most - 1, min(most, -s))) for q, found in enumerate(kept) for s, i in sorted(found)[:k]]
    if flat:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat)], names=["query_id", "vec_id", "score"])


def _blocks(asked: DataFrame, width: int) -> Iterator[_Block]:
    """The queries in blocks of bounded size."""
    most = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, width))))
    n = asked.count()
    blocks = max(1, -(-2 * n // most)) if n > most else 1  # dealt by a hash, so half full on average
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)) == b).toArrow().combine_chunks()
        for batch in part.to_batches(max_chunksize=most):
            if batch.num_rows:
                yield _Block(column(batch, "vec_id").to_numpy(), _vectors(batch, width).copy())


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for rows (vec_id, embedding) of both: the k greatest inner products of floor(scale x)."""
    spark = candidates.sparkSession
    rows, asked = written(usable(candidates, scale), "vectors"), written(usable(queries, scale), "queries")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    limit = float(int((2**53 / max(1, width)) ** 0.5))
    large = F.exists("v", lambda x: F.abs(x) >= limit)
    found = []

    def phase(block: _Block, some: DataFrame, task) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)
        return some.mapInArrow(lambda batches: task(batches, sent.value), "query_id long, vec_id long, score long")

    if width and not rows.where(large).isEmpty():
        for block in _blocks(asked.where(large), width):
            found.append(phase(block, rows, lambda x, b: _exact(x, b, k)))
        for block in _blocks(asked.where(~large), width):
            found.append(phase(block, rows.where(large), lambda x, b: _exact(x, b, k)))
        rows, asked = rows.where(~large), asked.where(~large)
    for block in _blocks(asked, width) if width else ():
        floors = _ranked(phase(block, rows, lambda x, b: _task(x, b, k, True)), k).where(F.col("rank") == k).select("query_id", "score").collect()
        known = {r.query_id: r.score for r in floors}
        block.cutoff = np.array([known.get(i, -np.inf) for i in block.ids.tolist()], dtype=float)
        found.append(phase(block, rows, lambda x, b: _task(x, b, k, False)))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return _ranked(every, k).select("query_id", "rank", "vec_id", "score")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
