"""Exact top-k inner-product search by distributed histogram selection.

Vectors are turned into integers floor(scale * x). Queries are taken in blocks
of a fixed size; a block (a few MB) goes to every task. All candidates are
scored against a block several times: first the range of scores is known from
the vector norms, then each pass counts scores in ``BUCKETS`` equal buckets of
the range still open per query, and the bucket that holds the k-th best score
becomes the next range, until it is one integer wide. The last pass keeps the
scores above that value and, of those equal to it, the smallest ids still
needed (each task needs to send no more of them than that).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import bound_batches, store

QUERY_BLOCK = 4096
BUCKETS = 1024
_EXACT = 2.0 ** 53


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>) of vectors without null or non-finite components; null ids drop out."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return (vectors.where(F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a list column by dimension: {dimension: (row numbers, matrix)}."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = rows, flat[begin[rows][:, None] + np.arange(d)[None, :]]
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where those are exact, else in 64-bit integers."""
    if queries.size and rows.size:
        bound = queries.shape[1] * float(np.abs(queries).max()) * float(np.abs(rows).max())
        if bound < _EXACT:
            return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _each(batches, block: dict):
    """(query rows of the block, their ids, candidate ids, scores) for all batches; own rows excluded by mask."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        for d, (rows, matrix) in _matrix(batch.column("v")).items():
            if d in block:
                which, qid, q = block[d]
                for at in range(0, len(rows), 2048):
                    part = rows[at:at + 2048]
                    yield which, qid, ids[part], _scores(q, matrix[at:at + 2048]), qid[:, None] != ids[part][None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id.

    ``queries`` has the columns of ``vectors``; a candidate is every vector
    whose id differs from the query's and whose dimension is equal. Defined
    cases: vectors that are null or hold null or non-finite components and
    null ids take no part; repeated candidate rows count one by one; a query
    id that occurs twice is asked once, with its smallest vector; fewer than k
    candidates give fewer rows; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = store(integer_vectors(vectors, id_col, vector_col, scale))
    asked = store(integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    longest = rows.agg(F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0] or 0.0
    parts = [_block_top_k(rows, spread.where(F.col("block") == b), k, longest) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _block_top_k(rows: DataFrame, block: DataFrame, k: int, longest: float) -> DataFrame:
    spark = rows.sparkSession
    got = block.select("vec_id", "v").orderBy("vec_id").collect()  # one bounded block of the query set
    by_dim: dict[int, tuple] = {}
    for d in sorted({len(r.v) for r in got}):
        which = np.array([i for i, r in enumerate(got) if len(r.v) == d])
        q = np.array([got[i].v for i in which], dtype=np.int64).reshape(len(which), d)
        by_dim[d] = which, np.array([got[i].vec_id for i in which], dtype=np.int64), q
    held = spark.sparkContext.broadcast(by_dim)
    m = len(got)
    reach = np.zeros(m, dtype=np.int64)
    for which, _, q in by_dim.values():
        reach[which] = [int(np.ceil(np.sqrt(float((x.astype(float) ** 2).sum())) * longest)) + 1 for x in q]
    low, width = -reach, 2 * reach + 1          # the k-th best score lies in [low, low + width)
    above = np.zeros(m, dtype=np.int64)         # scores at or beyond low + width
    few = np.zeros(m, dtype=bool)               # fewer than k candidates: all are wanted
    while m and (width[~few] > 1).any():
        step = np.maximum(1, -(-width // BUCKETS))
        lo, st, wd = low.copy(), step.copy(), width.copy()

        def count(batches, lo=lo, st=st, wd=wd):
            total = np.zeros((m, BUCKETS), dtype=np.int64)
            for which, _, _, score, other in _each(batches, held.value):
                off = score - lo[which][:, None]
                ok = other & (off >= 0) & (off < wd[which][:, None])
                cell = off // st[which][:, None] + np.arange(len(which))[:, None] * BUCKETS
                total[which] += np.bincount(cell[ok], minlength=len(which) * BUCKETS).reshape(-1, BUCKETS)
            q, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], ["q", "b", "n"])

        # The whole histogram has at most QUERY_BLOCK x BUCKETS cells; per query only one bucket comes back.
        order = Window.partitionBy("q").orderBy(F.desc("b"))
        base = spark.createDataFrame([(i, int(above[i])) for i in range(m)], "q int, above long")
        cells = (rows.mapInArrow(count, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
                 .withColumn("upto", F.sum("n").over(order)).join(base, "q")
                 .withColumn("hit", F.col("upto") + F.col("above") >= k))
        best = {r.q: r for r in cells.groupBy("q").agg(
            F.max(F.when(F.col("hit"), F.struct("b", "upto", "n"))).alias("x")).collect()}
        for i in range(m):
            if few[i] or width[i] == 1:
                continue
            x = best[i].x if i in best else None
            if x is None:
                few[i] = True
                continue
            above[i] += x.upto - x.n
            low[i] += x.b * step[i]
            width[i] = min(step[i], width[i] - x.b * step[i])
    need = np.where(few, 0, k - above)          # of the scores equal to low, so many
    floor = np.where(few, np.iinfo(np.int64).min, low)

    def keep(batches):
        ties: dict[int, np.ndarray] = {}
        for which, qid, ids, score, other in _each(batches, held.value):
            at = floor[which][:, None]
            q, c = np.nonzero(other & (score > at))
            yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(ids[c]), pa.array(score[q, c])],
                                             ["query_id", "vec_id", "score"])
            for j, c in enumerate((other & (score == at))):
                if c.any():
                    w = int(which[j])
                    ties[w] = np.sort(np.concatenate([ties.get(w, ids[:0]), ids[c]]))[:max(0, int(need[w]))]
        names = {int(w): int(x) for which, qid, _ in held.value.values() for w, x in zip(which, qid)}
        for w, ids in ties.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), names[w])), pa.array(ids), pa.array(np.full(len(ids), floor[w]))],
                ["query_id", "vec_id", "score"])

    return rows.mapInArrow(keep, "query_id long, vec_id long, score long")
