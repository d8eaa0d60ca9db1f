"""Exact top-k inner-product search by columnar branch-and-bound (BOND).

Vectors stand in vertical layout, dimension by dimension. For one query the
scores of a block of candidates are accumulated dimension block by dimension
block; what the remaining dimensions can still add or take away is at most
the product of the remaining masses (norms) of query and candidate
(Cauchy-Schwarz). Candidates whose upper bound lies below the k-th best lower
bound are dropped and the survivors compacted before the next block.

Queries and candidates are dealt into blocks of bounded size; every pair of a
query block and a candidate block is one group, so no task holds more than one
block of either. Each group returns k rows per query; the best k per query
follow by a rank that Spark limits before it shuffles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pick

QUERY_BLOCK = 8192  # the larger it is, the fewer times each candidate is sent
BLOCK = 16384
DIMS = 16  # dimensions accumulated between two rounds of pruning


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v array<long>)``, components ``floor(scale * x)``, x as
    double. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, are left out; rows that repeat an id are rows of
    their own."""
    src = pick(vectors, vec_id="vec_id", v="embedding").select(
        F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return (src.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
            .select("vec_id", ints.alias("v")))


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """A list column as an array of shape (d, n): vertical layout, shorter
    vectors padded with zeros."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    n = np.diff(flat.offsets.to_numpy())
    values = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py():]
    out = np.zeros((d, len(n)), np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n), rows] = values[:len(rows)]
    return out


def width(column: pa.ChunkedArray) -> int:
    return max((len(x) for x in column.to_pylist()), default=0) if len(column) < 64 else int(
        max(np.diff(c.offsets.to_numpy()).max(initial=0) for c in column.chunks))


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int, dims: int = DIMS,
                 qrow: np.ndarray | None = None, crow: np.ndarray | None = None):
    """``(query row, candidate row, score)`` of the k best candidates of each
    query (all but the query's own row), ties to the smaller id. ``q`` and
    ``x``: (dimensions, rows), integers; ``qrow``, ``crow``: what tells rows
    apart (default: their ids)."""
    qrow, crow = qid if qrow is None else qrow, cid if crow is None else crow
    d = len(x)
    safe = d * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**52
    order = np.argsort(cid, kind="stable")
    cid, crow, x = cid[order], crow[order], x[:, order]
    kind = np.float64 if safe else object  # doubles add and multiply such integers exactly
    q, x = q.astype(kind), x.astype(kind)
    edges = list(range(0, d, dims)) + [d]
    mass = lambda a, lo: np.sqrt(np.square(a[lo:].astype(np.float64)).sum(0))
    rest_x = [mass(x, lo) for lo in edges[1:]]
    rest_q = [mass(q, lo) for lo in edges[1:]]
    place = {int(r): j for j, r in enumerate(crow.tolist())}
    for i in range(len(qid)):
        alive = np.arange(len(cid))
        own = place.get(int(qrow[i]))
        if own is not None:
            alive = np.delete(alive, own)
        score = np.zeros(len(alive), kind)
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = x[lo:hi] if len(alive) == len(cid) else x[lo:hi, alive]
            score = score + q[lo:hi, i] @ part
            if hi < d and len(alive) > k:
                can = rest_q[b][i] * rest_x[b][alive] * (1 + 1e-9) + 1e-6
                s = score.astype(np.float64)
                bar = np.partition(s - can, len(s) - k)[len(s) - k]
                keep = s + can >= bar
                if keep.mean() < 0.7:  # compact the survivors
                    alive, score = alive[keep], score[keep]
        if len(alive) > k:
            s = score.astype(np.float64)
            bar = np.partition(s, len(s) - k)[len(s) - k]
            near = s >= bar - abs(bar) * 1e-12
            alive, score = alive[near], score[near]
        best = sorted(range(len(alive)), key=lambda r: (-score[r], cid[alive[r]]))[:k]  # k and what ties with it
        for r in best:
            yield i, int(order[alive[r]]), max(min(int(score[r]), 2**63 - 1), -2**63)


def search(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK,
           block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of ``vectors`` (see
    :func:`integer_vectors`) with ``is_query`` (over ``vec_id``) the ``k``
    highest inner products with the other rows, all if there are fewer; ties
    to the smaller vec_id. Rows that repeat an id are queries and candidates
    of their own. Vectors of different length meet as if padded with zeros. An
    empty table gives no rows."""
    base = cut(cut(vectors).withColumn("row", F.monotonically_increasing_id()))
    total, queries = base.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    nb, nq = max(1, math.ceil(total / block)), max(1, math.ceil(queries / query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = base.select(F.col("vec_id").alias("id"), "row", "v", deal(nb, 1).alias("cb"), to_all(nq).alias("qb"))
    ask = base.where(is_query).select(F.col("vec_id").alias("id"), "row", "v", deal(nq, 2).alias("qb"), to_all(nb).alias("cb"))
    keys = ["qb", "cb"]
    n = min(nb * nq, 20_000)  # one group a partition, up to a bounded number

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        d = max(width(left["v"]), width(right["v"]), 1)
        qid, cid = left["id"].to_numpy(), right["id"].to_numpy()
        rows = left["row"].to_numpy()
        got = list(search_block(qid, matrix(left["v"], d), cid, matrix(right["v"], d), k, DIMS, rows, right["row"].to_numpy()))
        i, r, s = (list(c) for c in zip(*got)) if got else ([], [], [])
        return pa.table({"query": pa.array(rows[i], pa.int64()), "query_id": pa.array(qid[i], pa.int64()), "vec_id": pa.array(cid[r], pa.int64()),
                         "score": pa.array(s, pa.int64())})

    pairs = (ask.repartition(n, *keys).groupBy(*keys)
             .cogroup(cand.repartition(n, *keys).groupBy(*keys))
             .applyInArrow(meet, "query long, query_id long, vec_id long, score long"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
