"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows (dimension, non-zero integer weight). Queries and candidates are dealt into
blocks of a fixed size and every pair of blocks is one group of a cogrouped task. In it, candidates
become postings lists, one per dimension; the queries' rows scatter `weight * posting` into a dense
array of scores, term by term; a partition selection keeps k candidates of the block for each query,
and the blocks' selections are merged by rank.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
#: Candidates whose scores are held at a time; times QUERY_BLOCK integers of 8 bytes.
TILE = 1024
#: Sums below this magnitude are formed in 64-bit integers, larger ones in Python's own.
_FITS = 1 << 62
_LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vector(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as a double, which holds it exactly; null for a null vector or one with a null or non-finite component.

    A product beyond the range of doubles is held at the end of the range.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    top = F.lit(sys.float_info.max)
    scaled = F.transform(vector, lambda x: F.greatest(F.least(x.cast("double") * scale, top), -top))
    return F.when(vector.isNotNull() & fine, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


def _dense(table: pa.Table, column: str, width: int) -> np.ndarray:
    """Rows of a list column as an array [rows, width]; what a shorter row lacks is zero."""
    lists = table[column].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _kind(q: np.ndarray, c: np.ndarray):
    """The smallest integers that hold every sum of the block and twice it; object: Python's."""
    limit = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.int32 if limit < 1 << 30 else np.int64 if limit < _FITS else object


def _integers(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(kind) if kind is not object else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def sort_key(score: int) -> bytes:
    """Bytes that ascend as integers of any size do."""
    body = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    size = len(body).to_bytes(2, "big")
    return b"\1" + size + body if score >= 0 else b"\0" + bytes(255 - x for x in size + body)


def _width(table: pa.Table, column: str) -> int:
    return max((int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in table[column].chunks), default=0)


def _accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores [candidates, queries], term at a time."""
    scores = np.zeros((len(candidates), len(queries)), dtype=candidates.dtype)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        weights = queries[:, term]
        posting = np.flatnonzero(candidates[:, term])
        if not len(posting) or not weights.any():
            continue
        if len(posting) == len(candidates):
            scores += candidates[:, term, None] * weights
        else:
            scores[posting] += candidates[posting, term, None] * weights
    return scores


def _block_top(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "exact": pa.array([], pa.binary())})
        width = max(_width(left, "v"), _width(right, "v"), 1)
        right = right.sort_by("id")
        q_ids, c_ids = left["id"].to_numpy(), right["id"].to_numpy()
        q, c = _dense(left, "v", width), _dense(right, "v", width)
        kind = _kind(q, c)
        q, c = _integers(q, kind), _integers(c, kind)
        wide = object if kind is object else np.int64
        lowest = -(1 << 8192) if kind is object else np.iinfo(np.int64).min  # below every score
        kept_ids = np.empty((0, len(q_ids)), np.int64)
        kept_scores = np.empty((0, len(q_ids)), wide)
        for start in range(0, len(c_ids), TILE):
            ids = c_ids[start : start + TILE]
            scores = _accumulate(q, c[start : start + TILE])
            own = np.isin(q_ids, ids)
            tile = scores
            if own.any():
                tile = scores.astype(wide)
                tile[ids[:, None] == q_ids[None, :]] = lowest
            if len(kept_scores) == k and not own.any():
                floor = kept_scores.min(axis=0)
                if kind is np.int32:
                    floor = np.maximum(floor, np.iinfo(np.int32).min).astype(np.int32)
                better = (tile > floor).any(axis=1)  # later ids lose ties
                tile, ids = tile[better], ids[better]
            all_scores = np.concatenate([kept_scores, tile.astype(wide)])
            all_ids = np.concatenate([kept_ids, np.broadcast_to(ids[:, None], (len(ids), len(q_ids)))])
            if len(all_scores) > k:
                all_scores, all_ids = _select(all_scores, all_ids, k)
            kept_scores, kept_ids = all_scores, all_ids
        real = (kept_scores > lowest).astype(bool)
        best = kept_scores[real]
        found = {"query_id": np.broadcast_to(q_ids, kept_ids.shape)[real], "vec_id": kept_ids[real]}
        found["score"] = np.array([min(max(x, _LONG[0]), _LONG[1]) for x in best], dtype=np.int64) if kind is object else best
        ends = [i for i, x in enumerate(found["score"].tolist()) if x in _LONG] if kind is object else []
        exact = np.full(len(best), None, dtype=object)
        exact[ends] = [sort_key(best[i]) for i in ends]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in found.items()} | {"exact": pa.array(exact.tolist(), pa.binary())})

    return run


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of each column, ties to the smaller id; rows of equal score come in ascending id."""
    n = len(scores)
    least = np.partition(scores, n - k, axis=0)[n - k]
    above, level = (scores > least).astype(bool), (scores == least).astype(bool)
    chosen = above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))
    rows = np.nonzero(chosen.T)[1].reshape(-1, k).T
    return np.take_along_axis(scores, rows, 0), np.take_along_axis(ids, rows, 0)


def exact_top_k(
    candidates: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: float = 64.0,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query among all candidates but its own id.

    Scores are sums of products of integer components and exact at any size; one beyond the range of long
    is ranked by its own value and shown as the end of that range. Ties go to the smaller id. Rows with a null id or
    vector, or with a null or non-finite component, take no part. A vector shorter than another counts as
    filled up with zeros; an empty one scores 0. A query id that is repeated counts once, with its
    smallest vector; a candidate row that is repeated counts each time. No query or no candidate: no rows.
    Columns besides the two named ones are not read.
    """
    rows = [
        df.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
        for df in (queries, candidates)
    ]
    wanted = rows[0].groupBy("id").agg(F.min("v").alias("v"))
    n_queries, n_candidates = wanted.count(), rows[1].count()
    q_blocks, c_blocks = -(-n_queries // query_block) or 1, -(-n_candidates // candidate_block) or 1
    deal = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("id", "v", deal(1, q_blocks).alias("qb")).withColumn("cb", every(c_blocks))
    right = rows[1].select("id", "v", deal(2, c_blocks).alias("cb")).withColumn("qb", every(q_blocks))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        _block_top(k), "query_id long, vec_id long, score long, exact binary"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    rows = read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.c, d.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
