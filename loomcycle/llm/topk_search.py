"""Exact top-k by inner product: columnar branch and bound.

Candidates lie dimension by dimension (vertical layout). Scores of a block of queries are accumulated
over blocks of dimensions; before each further block a candidate survives only if its partial score plus
the largest possible rest - the product of both remaining norms (Cauchy-Schwarz) - can still reach the
k-th best exact score known for the query, and the survivors are compacted. Dimensions come in the order
of their mass, so that the remaining norms fall fast.

Both sides are dealt by hash into blocks; a task gets one block of queries and one of candidates, whose
sizes bound its memory. Every candidate block meets every query block, which is the work that a stated
query set against all rows means; what leaves a task is k rows for each query, and Spark's top-k window
drops all but k a query before it shuffles them.

Defined cases: null vectors and those with null or non-finite components take no part, nor do rows with a
null id. Vectors of different lengths are never compared. Repeated rows with one id are each a candidate
for others but never for their own id; identical queries give one result. Ties go to the smaller id, among
equal ids to neither in particular. An empty table gives an empty result. Scores beyond 53 bits raise an error.
Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
STEPS = (16, 16, 16)
_BATCH = 64
_OUT = "query_id long, query_no long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, or null if the vector can't take part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))


def block_topk(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best in one block, its own id left out."""
    dims = c.shape[1]
    order = np.argsort(-(np.square(c).sum(0) * (np.square(q).sum(0) + 1)), kind="stable")
    q, columns = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = [0]
    for step in STEPS:
        if cuts[-1] + step < dims:
            cuts.append(cuts[-1] + step)
    cuts.append(dims)
    # norms of what remains after each cut
    q_rest = [np.sqrt(np.square(q[:, a:]).sum(1)) for a in cuts]
    c_rest = [np.sqrt(np.square(columns[a:]).sum(0)) for a in cuts]
    by_id = np.argsort(c_ids, kind="stable")
    sorted_ids = c_ids[by_id]
    out_q, out_c, out_s = [], [], []
    for first in range(0, len(q), _BATCH):
        mine = slice(first, first + _BATCH)
        partial = q[mine, : cuts[1]] @ columns[: cuts[1]]
        bound = partial + q_rest[1][mine, None] * c_rest[1][None, :]
        for j in range(partial.shape[0]):
            i = first + j
            own = by_id[np.searchsorted(sorted_ids, q_ids[i], "left") : np.searchsorted(sorted_ids, q_ids[i], "right")]
            score, ceiling = partial[j], bound[j]
            score[own], ceiling[own] = -np.inf, -np.inf
            live = np.flatnonzero(ceiling > -np.inf)
            if len(live) > 4 * k:
                # exact scores of the most promising give the first threshold
                probe = np.argpartition(-ceiling, 4 * k)[: 4 * k]
                exact = score[probe] + q[i, cuts[1] :] @ columns[cuts[1] :, probe]
                floor_ = np.partition(exact, len(exact) - k)[len(exact) - k]
                live = np.flatnonzero(ceiling >= floor_ - 1e-6 * (1 + abs(floor_)))
            score = score[live]
            for a, b, rest in zip(cuts[1:-1], cuts[2:], range(2, len(cuts))):
                score = score + q[i, a:b] @ columns[a:b, live]
                if b < dims and len(live) > 4 * k:
                    low = score - q_rest[rest][i] * c_rest[rest][live]
                    floor_ = max(floor_, np.partition(low, len(low) - k)[len(low) - k])
                    keep = score + q_rest[rest][i] * c_rest[rest][live] >= floor_ - 1e-6 * (1 + abs(floor_))
                    live, score = live[keep], score[keep]
            best = np.lexsort((c_ids[live], -score))[:k]
            out_q.append(np.full(len(best), i))
            out_c.append(live[best])
            out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def topk_search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    named = vectors.withColumn("__query", is_query).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce("__query", F.lit(False)).alias("query"))
    rows = named.where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("dims", F.size("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    c_blocks, q_blocks = max(1, -(-sizes["n"] // candidate_block)), max(1, -(-sizes["q"] // query_block))
    dealt = F.xxhash64("id", "v")
    # query_no tells apart different queries that share an id
    queries = rows.where("query").dropDuplicates(["id", "v"]).select("dims", "id", "v", dealt.alias("query_no"), F.pmod(dealt, F.lit(q_blocks)).alias("qb"))
    queries = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<long>")))
    # dealt by row, not by id: a repeated id spreads over all blocks
    spread = F.pmod(F.xxhash64("id", "v", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(c_blocks))
    candidates = rows.select("dims", "id", "v", spread.alias("cb"))
    candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>")))

    def block(key: tuple, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_no", "vec_id", "score")})
        q, c = (np.stack(x["v"].to_numpy()).reshape(len(x), -1) for x in (qs, cs))
        q_ids, c_ids = qs["id"].to_numpy(np.int64), cs["id"].to_numpy(np.int64)
        if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2.0**53:
            raise ValueError("inner products beyond 53 bits aren't exact")
        i, j, s = block_topk(q, c, q_ids, c_ids, k) if q.shape[1] else _all_zero(len(q), q_ids, c_ids, k)
        return pd.DataFrame({"query_id": q_ids[i], "query_no": qs["query_no"].to_numpy(np.int64)[i], "vec_id": c_ids[j], "score": s.astype(np.int64)})

    key = ["dims", "cb", "qb"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(block, _OUT)
    best = W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_zero(n: int, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors without components: all scores are 0."""
    order = np.argsort(c_ids, kind="stable")
    pairs = [(i, j) for i in range(n) for j in [j for j in order[: k + np.count_nonzero(c_ids == q_ids[i])] if c_ids[j] != q_ids[i]][:k]]
    i, j = (np.array([p[a] for p in pairs], np.int64) for a in (0, 1))
    return i, j, np.zeros(len(pairs))
