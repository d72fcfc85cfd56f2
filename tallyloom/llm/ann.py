"""Approximate nearest neighbours by an inverted multi-index, for largest inner products.

1. *Fit.* On a bounded sample (``SAMPLE`` rows in expectation, drawn by hash) each half of the vectors gets its own
   ``side`` centroids. A pair of centroids is a cell; ``side`` follows the number of rows, so that a cell holds
   about ``CELL_ROWS`` rows, up to ``MAX_SIDE``.
2. *Index.* Every row gets the cell of its nearest centroids and is written once. Cells are dealt to buckets of
   about ``BUCKET_ROWS`` rows; a cell with more rows than that is cut into buckets of its own by row hash.
3. *Traverse.* A query's inner products with the centroids of each half are sorted; a heap yields centroid pairs by
   decreasing sum, until the visited cells hold ``budget`` rows. The query travels once to each bucket in
   which it visits cells. Buckets that many queries visit are repeated for slices of queries, so no group exceeds
   about ``BUCKET_ROWS`` rows and ``QUERY_ROWS`` queries.
4. *Rerank.* The rows of visited cells get their exact inner products, added up component by component in double
   precision, so equal vectors have equal scores wherever they stand. Each group sends a query's best ``k``.

The budget is measured, not guessed: ``CALIBRATION`` queries, drawn by hash, are answered exactly against all rows; the
budget is the number of rows within which a share ``target`` of their true neighbours is met. Data without any
structure hence visit many cells, clustered data few.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; different lengths are an error. A query is a row: other rows under its id are candidates,
rows with a null id are candidates and never queries. Equal scores go to the smaller id (null last). With at most ``k``
candidates all are returned. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scale import bounded_rows, materialise
from tallyloom.llm.vectors import finite, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
EVERY = 20
SAMPLE = 32_768
CELL_ROWS = 64
MAX_SIDE = 1024
BUCKET_ROWS = 4096
QUERY_ROWS = 4096
TILE = 512
CALIBRATION = 128
TARGET = 0.95
STEPS = 8
LAST = (1 << 63) - 1       # sorts a null id last


# ------------------------------------------------------------------ kernels

def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums from the first component to the last, the same for a pair in any company."""
    out = np.zeros((len(queries), len(rows)))
    for j in range(queries.shape[1]):
        out += queries[:, j, None] * rows[None, :, j]
    return out


def nearest(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(axis=1) - 2 * half @ centroids.T).argmin(axis=1)


def fit_centroids(half: np.ndarray, side: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample, which is in hash order."""
    start = half[np.sort(np.unique(half, axis=0, return_index=True)[1])][:side]
    centroids = start.copy()
    for _ in range(STEPS):
        at = nearest(half, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, half)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(cell, its rows) by decreasing first[i] + second[j], empty cells left out; cell = i * len(second) + j."""
    by_first, by_second = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    u, v = first[by_first].tolist(), second[by_second].tolist()
    by_first, by_second = by_first.tolist(), by_second.tolist()
    heap = [(-u[0] - v[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        if j + 1 < len(v):
            heapq.heappush(heap, (-u[i] - v[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-u[i + 1] - v[0], i + 1, 0))
        cell = by_first[i] * len(v) + by_second[j]
        if counts[cell]:
            yield cell, int(counts[cell])


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's ``k`` best finite scores, ties to the smaller id, best first."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        q, r = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
    else:
        q, r = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    start = np.searchsorted(q, q)
    keep = np.arange(len(q)) - start < k
    return q[keep], r[keep]


# ------------------------------------------------------------------ index

class Index:
    """Half centroids, rows per cell, and the buckets of the cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.cells = len(first) * len(second)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return nearest(x[:, :half], self.first) * len(self.second) + nearest(x[:, half:], self.second)

    def count(self, counts: np.ndarray) -> None:
        """Deal cells to buckets: neighbours share one while they fit, a large cell has several for itself."""
        self.counts = counts
        self.bucket, self.slices = np.zeros(self.cells, np.int64), np.ones(self.cells, np.int64)
        now, held = 0, 0
        for c in np.flatnonzero(counts):
            n = int(counts[c])
            if held and held + n > BUCKET_ROWS:
                now, held = now + 1, 0
            self.bucket[c] = now
            if n > BUCKET_ROWS:
                self.slices[c] = -(-n // BUCKET_ROWS)
                now, held = now + int(self.slices[c]), 0
            else:
                held += n

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        half = len(q) // 2
        return traverse(self.first @ q[:half], self.second @ q[half:], self.counts)


def _celler(index: Index, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cell_of(matrix(b.column("vec"), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int64())], [*b.schema.names, "cell"])
    return run


def usable(vectors: DataFrame, vec: str, id_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vec].alias("vec"))
    return rows.where(finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))


def build(rows: DataFrame, n: int, sample: int = SAMPLE) -> tuple[Index, DataFrame, int]:
    """(index, stored rows with their cell and number, length of the vectors) of ``n`` usable rows."""
    draw = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < sample / n).distinct().withColumn("at", F.xxhash64("vec", "vec_id"))   # equal rows share a draw
    got = [r.vec for r in sorted(bounded_rows(drawn, 2 * sample + 1000, "sample of vectors"), key=lambda r: r["at"])]
    got = got or [rows.first().vec]
    dims = len(got[0])
    if any(len(v) != dims for v in got):
        raise ValueError("vectors of different lengths")
    x = np.array(got, float)
    side = int(min(MAX_SIDE, max(2, round((n / CELL_ROWS) ** 0.5))))
    index = Index(fit_centroids(x[:, :dims // 2], side), fit_centroids(x[:, dims // 2:], side))
    kind = rows.schema["vec"].dataType.simpleString()
    celled = rows.mapInArrow(_celler(index, dims), f"vec_id long, vec {kind}, cell long")
    stored = materialise(celled.withColumn("uid", F.monotonically_increasing_id()), "cells")
    counts = np.zeros(index.cells, np.int64)
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():   # MAX_SIDE ** 2 rows at most
        counts[r["cell"]] = r["n"]
    index.count(counts)
    return index, stored, dims


# ------------------------------------------------------------------ exact answers and the budget

def exact_neighbours(stored: DataFrame, uids: list[int], queries: np.ndarray, k: int = K) -> DataFrame:
    """(query, uid, vec_id, cell, score, rank) of a bounded number of queries against all rows."""
    dims = queries.shape[1]
    own = np.array(uids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, uid, cell = matrix(b.column("vec"), dims), np.asarray(b.column("uid")), np.asarray(b.column("cell"))
            ids = np.asarray(b.column("vec_id").fill_null(LAST))
            for a in range(0, len(x), TILE):
                s = inner_products(queries, x[a:a + TILE])
                s[own[:, None] == uid[None, a:a + TILE]] = -np.inf
                q, r = best_rows(s, ids[a:a + TILE], k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(uid[a + r]), pa.array(ids[a + r]),
                                                  pa.array(cell[a + r]), pa.array(s[q, r])],
                                                 ["query", "uid", "vec_id", "cell", "score"])

    near = stored.select("vec", "uid", "cell", "vec_id").mapInArrow(
        run, "query long, uid long, vec_id long, cell long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "uid")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def measured_budget(index: Index, stored: DataFrame, asked: Column, k: int = K, target: float = TARGET,
                    queries: int = CALIBRATION) -> int:
    """Rows to visit so that a share ``target`` of the true neighbours of drawn queries is met."""
    drawn = stored.where(asked).orderBy(F.xxhash64("vec_id", F.lit("calibration")), "uid").limit(queries).collect()
    x = np.array([r.vec for r in drawn], float)
    true = exact_neighbours(stored, [r.uid for r in drawn], x, k).select("query", "cell").collect()
    cells: dict[int, list[int]] = {}
    for r in true:
        cells.setdefault(r["query"], []).append(r["cell"])
    needed = []
    for q, wanted in cells.items():
        seen, upto = 0, {}
        for cell, n in index.order(x[q]):
            seen += n
            upto[cell] = seen
        needed += [upto[c] for c in wanted]
    return int(np.quantile(needed, target, method="higher")) if needed else 0


# ------------------------------------------------------------------ search

def _visitor(index: Index, dims: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec"), dims)
            at, buckets, cells = [], [], []
            for i, q in enumerate(x):
                seen, by = 0, {}
                for cell, n in index.order(q):
                    for s in range(int(index.slices[cell])):
                        by.setdefault(int(index.bucket[cell]) + s, []).append(cell)
                    seen += n
                    if seen >= budget:
                        break
                at += [i] * len(by)
                buckets += by
                cells += by.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(take) for c in ("uid", "vec_id", "vec")], pa.array(buckets, pa.int64()),
                 pa.array(cells, pa.list_(pa.int64()))], ["uid", "vec_id", "vec", "bucket", "cells"])
    return run


def _reranker(dims: int, k: int):
    schema = [("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({c: pa.array([], kind) for c, kind in schema})
        rows = rows.sort_by("cell").combine_chunks()
        x, q = matrix(rows.column("vec"), dims), matrix(asked.column("vec"), dims)
        uid, ids = np.asarray(rows.column("uid")), np.asarray(rows.column("vec_id").fill_null(LAST))
        own, own_id = np.asarray(asked.column("uid")), np.asarray(asked.column("vec_id"))
        cells, at = np.unique(np.asarray(rows.column("cell")), return_index=True)
        edge = np.append(at, len(x))
        visits = asked.column("cells").combine_chunks()
        offsets = np.asarray(visits.offsets) - visits.offsets[0].as_py()
        visit = np.asarray(visits.flatten())
        who = np.repeat(np.arange(len(q)), np.diff(offsets))
        out = []
        for a in range(0, len(q), TILE):
            inside = (who >= a) & (who < a + TILE)
            scores = np.full((min(TILE, len(q) - a), len(x)), -np.inf)
            order = np.argsort(visit[inside], kind="stable")
            v, w = visit[inside][order], who[inside][order] - a
            for c, s, e in zip(cells, edge[:-1], edge[1:]):
                those = w[np.searchsorted(v, c):np.searchsorted(v, c, "right")]
                if len(those):
                    scores[those, s:e] = inner_products(q[a + those], x[s:e])
            scores[own[a:a + TILE, None] == uid[None, :]] = -np.inf
            i, r = best_rows(scores, ids, k)
            out.append((own[a + i], own_id[a + i], ids[r], scores[i, r]))
        return pa.table({c: pa.array(np.concatenate(v), kind) for (c, kind), v in zip(schema, zip(*out))})
    return run


def search(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", every: int = EVERY, k: int = K,
           target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec, id_col)
    asked = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    if not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, stored, dims = build(rows, n)
    budget = max(measured_budget(index, stored, asked, k, target), k + 1)
    visits = materialise(stored.where(asked).select("uid", "vec_id", "vec").mapInArrow(
        _visitor(index, dims, budget), f"uid long, vec_id long, vec {stored.schema['vec'].dataType.simpleString()}, "
                                       f"bucket long, cells array<long>"), "visits")
    # one row per bucket: rows / BUCKET_ROWS, doubled at most by large cells
    asking = visits.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("n_slices"))
    sliced = visits.join(asking, "bucket").withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("n_slices")))
    homes = spark.createDataFrame([(int(c), int(index.bucket[c]), int(index.slices[c])) for c in np.flatnonzero(index.counts)],
                                  "cell long, base long, parts long")
    # at most MAX_SIDE ** 2 cells
    dealt = stored.join(F.broadcast(homes), "cell").withColumn(
        "bucket", F.col("base") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    dealt = (dealt.join(asking, "bucket")
                  .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1)))
                  .select("bucket", "slice", "cell", "uid", "vec_id", "vec"))
    near = (dealt.groupBy("bucket", "slice").cogroup(
        sliced.select("bucket", "slice", "uid", "vec_id", "vec", "cells").groupBy("bucket", "slice"))
        .applyInArrow(_reranker(dims, k), "uid long, query_id long, vec_id long, score double"))
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")
