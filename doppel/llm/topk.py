"""Exact top-k search by distributed histogram selection.

Every query scores every candidate. Per query a histogram of all scores over a value range is summed across tasks; the bin that
holds the kth value becomes the next, finer range, until the kth value is known exactly. A last pass
emits what lies above it and, of the scores equal to it, the smallest ids. Scores are computed anew in each pass and
never leave a task; a task sends at most k bins and 2k rows a query.

Queries are taken in blocks of bounded size, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.batches import run_folder

BINS = 512
BLOCK_BYTES = 4 << 20
CELLS = 1 << 21  # scores held at once in a task


def _matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(dtype)
    out = np.zeros((len(sizes), dims), dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and their scores by row and query, as int64, in pieces of bounded size; also a mask of own rows."""
    step = max(1, CELLS // max(1, len(ids)))
    for batch in batches:
        cand = batch.column(0).to_numpy(zero_copy_only=False)
        rows = _matrix(batch.column(1), queries.shape[1], queries.dtype)
        for a in range(0, len(cand), step):
            own = cand[a:a + step]
            yield own, (rows[a:a + step] @ queries.T).astype(np.int64), own[:, None] == ids[None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k highest integer inner products of each query over all candidates with another id.

    vectors, queries: vec_id long, vector array<long>, both without nulls. Ties go to the smaller vec_id. Fewer candidates than
    k give fewer rows; no candidates or no queries give none. Repeated candidates count each; a query repeated with the same
    vector is asked once. Vectors of unequal length are compared with zeros in the missing places.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    folder = run_folder(spark, "topk")
    stats = vectors.select(
        F.max(F.size("vector")).alias("dims"),
        F.max(F.expr("sqrt(aggregate(vector, 0D, (a, x) -> a + cast(x as double) * cast(x as double)))")).alias("norm")).first()
    dims, norm = max(1, stats["dims"]) if stats["dims"] is not None else 0, stats["norm"] or 0.0  # empty vectors score 0
    at_once = max(1, min(2048, BLOCK_BYTES // (8 * max(1, dims))))
    asked = queries.dropDuplicates(["vec_id", "vector"]).withColumn("tie", F.xxhash64("vector"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    after, made = None, False
    while dims:
        page = asked if after is None else asked.where((F.col("vec_id") > after[0]) | ((F.col("vec_id") == after[0]) & (F.col("tie") > after[1])))
        block = page.orderBy("vec_id", "tie").limit(at_once).collect()
        if not block:
            break
        after = (block[-1]["vec_id"], block[-1]["tie"])
        _search(vectors, [r["vec_id"] for r in block], [r["vector"] for r in block], dims, norm, k).write.mode("append").parquet(folder)
        made = True
    return spark.read.parquet(folder) if made else empty


def _search(vectors: DataFrame, ids: list[int], rows: list[list[int]], dims: int, norm: float, k: int) -> DataFrame:
    """Top k of one block of queries."""
    spark = vectors.sparkSession
    own = np.array([[*r[:dims], *[0] * (dims - len(r))] for r in rows], np.int64)
    size = np.sqrt((own.astype(float) ** 2).sum(1))
    reach = [int(min(s * norm * (1 + 1e-9) + 1, 2.0 ** 62)) for s in size]
    # Products below 2**53 are exact in doubles, which the matrix product is fast for; others wrap as long does.
    exact = max(reach) < 2 ** 53
    shared = spark.sparkContext.broadcast((np.array(ids, np.int64), own.astype(np.float64 if exact else np.int64)))
    low = np.array([-r if exact else -(2 ** 63) for r in reach], object)
    span = np.array([2 * r + 1 if exact else 2 ** 64 - 1 for r in reach], object)
    wide = np.array([-(-s // BINS) for s in span], object)
    above = np.zeros(len(ids), np.int64)
    found = np.zeros(len(ids), bool)
    while not found.all():
        sums = vectors.select("vec_id", "vector").mapInArrow(
            _histogram(shared, _longs(low), span.astype(np.uint64), wide.astype(np.uint64), k), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in sums.collect():  # at most BINS sums for each query of the block
            counts.setdefault(r["query"], []).append((r["bin"], r["n"]))
        for q in np.flatnonzero(~found).tolist():
            at = 0
            for at, n in sorted(counts.get(q, []), reverse=True):
                if above[q] + n >= k:
                    break
                above[q] += n
            else:  # fewer than k in all: everything is taken
                found[q], low[q], above[q] = True, -(2 ** 63), 0
                continue
            low[q] += at * wide[q]
            found[q] = wide[q] == 1
            span[q], wide[q] = wide[q], max(1, -(-wide[q] // BINS))
    rest = np.array([k - a for a in above], np.int64)
    hits = vectors.select("vec_id", "vector").mapInArrow(_hits(shared, _longs(low), rest), "query_id long, query int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _longs(values: np.ndarray) -> np.ndarray:
    return np.array([min(int(v), 2 ** 63 - 1) for v in values], np.int64)


def _histogram(shared, low: np.ndarray, span: np.ndarray, wide: np.ndarray, k: int) -> Callable:
    """Counts by query and bin from the top down to where the task itself has k; lower bins cannot hold the kth value."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        total = np.zeros(len(ids) * BINS, np.int64)
        base = np.arange(len(ids)) * BINS
        for _, scores, own in _scores(batches, ids, queries):
            # As unsigned numbers, so that a range over all longs does not overflow.
            over = scores.view(np.uint64) - low.view(np.uint64)[None, :]
            keep = (scores >= low[None, :]) & (over < span[None, :]) & ~own
            at = (over // wide[None, :]).astype(np.int64) + base[None, :]
            total += np.bincount(at[keep], minlength=len(total))
        total = total.reshape(len(ids), BINS)
        higher = total[:, ::-1].cumsum(1)[:, ::-1] - total
        query, bin_ = np.nonzero((total > 0) & (higher < k))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(total[query, bin_])], ["query", "bin", "n"])
    return work


def _hits(shared, low: np.ndarray, rest: np.ndarray) -> Callable:
    """Rows above each query's kth value and, of those equal to it, as many of the smallest ids as can be needed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        parts, level = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        whole = low == -(2 ** 63)
        for cand, scores, own in _scores(batches, ids, queries):
            row, query = np.nonzero(((scores > low[None, :]) | whole[None, :]) & ~own)
            parts.append((query, cand[row], scores[row, query]))
            row, query = np.nonzero((scores == low[None, :]) & ~whole[None, :] & ~own)
            if len(row):
                level.append((query, cand[row]))
                if sum(len(x) for x, _ in level) > CELLS:
                    level = [_smallest(level, rest)]
        query, cand = _smallest(level, rest)
        parts.append((query, cand, low[query]))
        query, cand, score = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(query.astype(np.int32)), pa.array(cand), pa.array(score)], ["query_id", "query", "vec_id", "score"])
    return work


def _smallest(level: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    query, cand = (np.concatenate(x) for x in zip(*level))
    order = np.lexsort((cand, query))
    query, cand = query[order], cand[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < rest[query]
    return query[keep], cand[keep]
