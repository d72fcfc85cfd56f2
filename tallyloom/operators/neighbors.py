"""Exact nearest neighbours as a partitioned join.

Donors are assigned to the nearest of a bounded number of pivots. A query first searches the few
cells that must hold enough donors, which gives it an upper bound on its k-th distance; it then
visits only those other cells that the triangle inequality cannot rule out. Cells and the queries
sent to them are cut into chunks of bounded size, each pair of chunks keeps only its k best rows,
and no pair of rows ever leaves a task. Missing coordinates are allowed: donors are celled by their
pattern of known coordinates and distances use the coordinates known on both sides.

Where a sample of queries shows that cells rule out little (many coordinates without structure), sending queries to
cells costs more than it saves: then every chunk of queries meets every chunk of donors of its block once, in chunks as
large as a task holds. A cheap lower bound picks the pairs whose distances are computed, with the same formula.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.expr import hash_key
from tallyloom.functions.scale import bounded_rows, materialise, store

# task functions travel whole, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024              # rows of a chunk on either side
MAX_PIVOTS = 16_384
PIVOT_BYTES = 64 << 20    # pivots are shipped to every task
MAX_CELLS = 200_000       # so is the cell table
MIXED = "*"               # the pattern of cells whose donors have different known coordinates
MATRIX_CELLS = 4_000_000  # doubles in one distance matrix
ROUTED_CELLS = 1 << 20    # coordinates of the rows that a routing task gives back at once
SCAN_BYTES = 16 << 20     # vectors of a chunk of the plain scan
SCAN_GROUPS = 256         # pairs of chunks the plain scan aims at, until its chunks are full
SCAN_SHARE = 0.25         # donors that the cells may leave to a query; beyond it the plain scan is used
TILE = (256, 4096)        # queries x donors of one matrix of lower bounds
SHARE_SAMPLE = 64         # queries that tell what share the cells leave
MAX_COPIES = 8            # rows of one key up to which equal vectors ask together although no row meets itself
LARGEST = 1e15            # coordinates up to it are safe in single precision


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.empty((0, width))
    return np.array([np.asarray(v, dtype="float64") for v in vectors])


def _distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distances over the coordinates known on both sides, scaled to the full width; NaN if none."""
    total = np.zeros((len(q), len(d)))
    width = q.shape[1]
    if not (np.isnan(q).any() or np.isnan(d).any()):
        for j in range(width):
            diff = q[:, j][:, None] - d[:, j][None, :]
            total += diff * diff if metric == "euclidean" else np.abs(diff)
        return np.sqrt(total) if metric == "euclidean" else total
    known = np.zeros((len(q), len(d)))
    for j in range(width):
        diff = q[:, j][:, None] - d[:, j][None, :]
        ok = ~np.isnan(diff)
        diff = np.where(ok, diff, 0.0)
        total += diff * diff if metric == "euclidean" else np.abs(diff)
        known += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = total * (width / known)
    out = np.sqrt(scaled) if metric == "euclidean" else scaled
    return np.where(known > 0, out, np.nan)


def _patterns(x: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(~np.isnan(x), axis=1)]


class _Cells:
    """The cell table as arrays: block, known-coordinate pattern, pivot, rows, radius."""

    def __init__(self, rows: list, pivots: np.ndarray, metric: str):
        width = pivots.shape[1]
        self.pivots, self.metric, self.width = pivots, metric, width
        self.block = np.array([r["block"] for r in rows], dtype=object)
        self.mask = np.array([r["mask"] for r in rows], dtype=object)
        self.pivot = np.array([r["pivot"] for r in rows], dtype="int64")
        self.n = np.array([r["n"] for r in rows], dtype="int64")
        self.radius = np.array([r["radius"] for r in rows], dtype="float64")
        self.known = {m: None if m == MIXED else
                      np.unpackbits(np.frombuffer(bytes.fromhex(m), dtype="uint8"))[:width] == 1
                      for m in set(self.mask)}

    def bounds(self, q: np.ndarray, block: np.ndarray, target: np.ndarray):
        """Lower and upper distance bounds query x cell; infinite where a cell is not eligible."""
        lower = np.full((len(q), len(self.n)), np.inf)
        upper = lower.copy()
        for m, known in self.known.items():
            at = np.flatnonzero(self.mask == m)
            if m == MIXED:                      # nothing is known of its rows: always visited
                ok = block[:, None] == self.block[at][None, :]
                lower[:, at] = np.where(ok, 0.0, np.inf)
                upper[:, at] = np.where(ok, np.finfo("float64").max, np.inf)
                continue
            seen = np.where(known, q, np.nan)
            both = (~np.isnan(seen)).sum(axis=1)
            d = _distances(seen, self.pivots, self.metric)[:, self.pivot[at]]
            scale = self.width / np.maximum(both, 1)
            slack = (np.sqrt(scale) if self.metric == "euclidean" else scale)[:, None]
            reach = self.radius[at][None, :] * slack
            ok = (block[:, None] == self.block[at][None, :]) & (both > 0)[:, None]
            ok &= np.where(target >= 0, known[np.maximum(target, 0)], True)[:, None]
            lower[:, at] = np.where(ok, np.maximum(d - reach, 0.0), np.inf)
            upper[:, at] = np.where(ok, d + reach, np.inf)
        return lower, upper

    def home(self, upper: np.ndarray, need: int) -> np.ndarray:
        """The cells, nearest first, that together hold ``need`` donors."""
        order = np.argsort(upper, axis=1, kind="stable")
        rows = np.take_along_axis(np.where(np.isfinite(upper), self.n[None, :], 0), order, axis=1)
        before = np.cumsum(rows, axis=1) - rows
        chosen = np.zeros_like(upper, dtype=bool)
        np.put_along_axis(chosen, order, (before < need) & (rows > 0), axis=1)
        return chosen


    def open_share(self, sample: list, need: int) -> float:
        """Share of the donors of their blocks that sampled queries could not rule out after their nearest cells."""
        if not sample:
            return 0.0
        q = np.array([[np.nan if v is None else v for v in r["vec"]] for r in sample], dtype="float64")
        block = np.array([r["block"] for r in sample], dtype=object)
        lower, upper = self.bounds(q, block, np.array([r["target"] for r in sample]))
        chosen = self.home(upper, need)
        theta = np.where(chosen, upper, -np.inf).max(axis=1)
        rows = np.where(np.isfinite(lower), self.n[None, :], 0)
        left = np.where(lower <= theta[:, None], rows, 0)
        return float(left.sum() / max(rows.sum(), 1))


def chunk_ranker(width: int, k: int, metric: str, exclude_self: bool):
    """The task function (queries, donors of one pair of chunks) -> the k best donors of every query."""
    def local_best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names = ["q_key", "target", "d_key", "distance", "payload"]
        if len(q) == 0 or len(d) == 0:
            return pd.DataFrame({n: [] for n in names})
        d = d.sort_values("key", kind="stable")
        x, y = _matrix(q["vec"], width), _matrix(d["vec"], width)
        q_key, d_key = q["key"].to_numpy(), d["key"].to_numpy()
        target, payload = q["target"].to_numpy(), d["payload"].to_numpy(dtype="float64")
        out = []
        step = max(MATRIX_CELLS // len(y), 1)
        for s in range(0, len(x), step):
            dist = _distances(x[s:s + step], y, metric)
            if exclude_self:
                dist[q_key[s:s + step][:, None] == d_key[None, :]] = np.nan
            wanted = target[s:s + step]
            for t in np.unique(wanted[wanted >= 0]):          # a donor must know what it is asked for
                dist[np.ix_(wanted == t, np.isnan(y[:, t]))] = np.nan
            best = np.argsort(dist, axis=1, kind="stable")[:, :k]   # NaN sorts last
            value = np.take_along_axis(dist, best, axis=1)
            qi, ri = np.nonzero(~np.isnan(value))
            di = best[qi, ri]
            t = target[s:s + step][qi]
            out.append(pd.DataFrame({
                "q_key": q_key[s:s + step][qi], "target": t, "d_key": d_key[di],
                "distance": value[qi, ri],
                "payload": np.where(t >= 0, y[di, np.maximum(t, 0)], payload[di])}))
        return pd.concat(out)
    return local_best


class _Bounds:
    """Lower bounds of the distances of complete vectors: a matrix per tile, and what a row of it may reach.

    ``lower(s, e, a, b)`` gives scores of queries s:e and donors a:b; a pair whose distance is at most ``theta`` has a score
    of at most ``limit(s, e, theta)``. Euclidean scores are squared distances in single precision, the limit adds its
    largest error. Manhattan scores are sums of whole steps: every coordinate is off by one step at most.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str):
        self.metric, self.width = metric, x.shape[1]
        centre = y.mean(axis=0)
        x, y = x - centre, y - centre
        if metric == "euclidean":
            nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
            one = np.ones((len(x), 1)), np.ones((len(y), 1))
            self.x = np.hstack([-2 * x, nx[:, None], one[0]]).astype("float32")
            self.y = np.ascontiguousarray(np.hstack([y, one[1], ny[:, None]]).astype("float32").T)
            self.error = 2 * (self.width + 8) * 2.0 ** -23 * (np.sqrt(nx) + np.sqrt(ny.max())) ** 2 + 1e-30
        else:
            levels = np.iinfo("int16").max // (2 * self.width)
            self.step = max(np.abs(x).max(), np.abs(y).max(), 1e-300) / levels
            self.x = np.rint(x / self.step).astype("int16")
            self.y = np.ascontiguousarray(np.rint(y / self.step).astype("int16").T)

    def lower(self, s: int, e: int, a: int, b: int) -> np.ndarray:
        if self.metric == "euclidean":
            return self.x[s:e] @ self.y[:, a:b]
        out = np.zeros((e - s, b - a), "int16")
        diff = np.empty((8, b - a), "int16")
        for r in range(0, e - s, 8):
            total = out[r:r + 8]
            part, q = diff[:len(total)], self.x[s + r:s + r + len(total)]
            for j in range(self.width):
                np.subtract(q[:, j, None], self.y[j, a:b], out=part)
                np.abs(part, out=part)
                total += part
        return out

    def limit(self, s: int, e: int, theta: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":
            with np.errstate(over="ignore"):
                return np.nextafter((theta ** 2 * (1 + 1e-9) + self.error[s:e]).astype("float32"), np.float32(np.inf))
        steps = np.minimum(theta * (1 + 1e-9) / self.step + self.width + 1, np.iinfo("int16").max)
        return np.ceil(steps).astype("int16")


def _pair_distances(x: np.ndarray, y: np.ndarray, qi: np.ndarray, di: np.ndarray, metric: str) -> np.ndarray:
    """Distances of listed pairs of complete vectors, summed in the order of ``_distances``."""
    out = np.empty(len(qi))
    step = max(ROUTED_CELLS // max(x.shape[1], 1), 1)
    for s in range(0, len(qi), step):
        diff = x[qi[s:s + step]] - y[di[s:s + step]]
        terms = np.ascontiguousarray((diff * diff if metric == "euclidean" else np.abs(diff)).T)
        total = np.zeros(terms.shape[1])
        for t in terms:
            total += t
        out[s:s + step] = np.sqrt(total) if metric == "euclidean" else total
    return out


def _same_keys(q_key: np.ndarray, d_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (query, donor) of equal keys, by query."""
    q = pd.DataFrame({"key": q_key, "qi": np.arange(len(q_key))})
    d = pd.DataFrame({"key": d_key, "di": np.arange(len(d_key))})
    if q_key.dtype != object:                     # nulls come as NaN and equal nothing
        q, d = q.dropna(subset=["key"]), d.dropna(subset=["key"])
    both = q.merge(d, on="key").sort_values("qi", kind="stable")
    return both["qi"].to_numpy(dtype="int64"), both["di"].to_numpy(dtype="int64")


def _first_k(qi: np.ndarray, di: np.ndarray, dist: np.ndarray, k: int):
    """Of listed pairs the k best of every query, ties to the earlier donor."""
    order = np.lexsort((di, dist, qi))
    qi, di, dist = qi[order], di[order], dist[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = place < k
    return qi[keep], di[keep], dist[keep]


def tile_ranker(width: int, k: int, metric: str, exclude_self: bool):
    """As ``chunk_ranker`` and with its results, for chunks of any size: lower bounds first, distances where needed.

    Rows with missing or huge coordinates and questions for a coordinate go through ``chunk_ranker``.
    """
    plain = chunk_ranker(width, k, metric, exclude_self)

    def usual(x: np.ndarray) -> np.ndarray:
        return np.abs(x).max(axis=1, initial=0.0) < LARGEST        # NaN compares false

    def fast(x, y, q_key, d_key):
        bounds, (m, n) = _Bounds(x, y, metric), (len(x), len(y))
        own_q, own_d = _same_keys(q_key, d_key) if exclude_self else (np.empty(0, "int64"),) * 2
        found = []
        for s in range(0, m, TILE[0]):
            e = min(s + TILE[0], m)
            theta = np.full(e - s, np.inf)
            best = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
            mine = slice(*np.searchsorted(own_q, [s, e]))
            for a in range(0, n, TILE[1]):
                b = min(a + TILE[1], n)
                score = bounds.lower(s, e, a, b)
                here = (own_d[mine] >= a) & (own_d[mine] < b)
                never = np.inf if score.dtype.kind == "f" else np.iinfo(score.dtype).max
                score[own_q[mine][here] - s, own_d[mine][here] - a] = never
                if a == 0 and b - a > k:           # k donors of the first tile limit what is worth a distance
                    near = np.argpartition(score[:, :2048], k - 1, axis=1)[:, :k] if b - a > 2048 else \
                        np.argpartition(score, k - 1, axis=1)[:, :k]
                    real = np.take_along_axis(score, near, axis=1) < never
                    dist = _pair_distances(x, y, np.repeat(np.arange(s, e), k), near.ravel(), metric).reshape(-1, k)
                    theta = np.where(real, dist, np.inf).max(axis=1)
                ok = score <= bounds.limit(s, e, theta)[:, None]
                ok[own_q[mine][here] - s, own_d[mine][here] - a] = False
                qi, di = np.nonzero(ok)
                if len(qi) == 0:
                    continue
                qi, di = qi + s, di + a
                dist = _pair_distances(x, y, qi, di, metric)
                best = _first_k(np.concatenate([best[0], qi]), np.concatenate([best[1], di]),
                                np.concatenate([best[2], dist]), k)
                full, last = np.unique(best[0][::-1], return_index=True)
                count = np.bincount(best[0] - s, minlength=e - s)[full - s]
                kth = best[2][::-1][last]
                theta[full - s] = np.where(count >= k, np.minimum(theta[full - s], kth), theta[full - s])
            found.append(best)
        return [np.concatenate(c) for c in zip(*found)]

    def local_best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(d) == 0 or not 0 < width < 2048:
            return plain(q, d)
        d = d.sort_values("key", kind="stable")
        x, y = _matrix(q["vec"], width), _matrix(d["vec"], width)
        q_ok, d_ok = usual(x) & (q["target"].to_numpy() < 0), usual(y)
        odd = []
        if not (q_ok.all() and d_ok.all()):
            odd = [plain(q[~q_ok], d), plain(q[q_ok], d[~d_ok])]
            q, d, x, y = q[q_ok], d[d_ok], x[q_ok], y[d_ok]
        if len(q) == 0 or len(d) == 0:
            return pd.concat(odd)
        q_key, d_key = q["key"].to_numpy(), d["key"].to_numpy()
        qi, di, dist = fast(x, y, q_key, d_key)
        made = pd.DataFrame({"q_key": q_key[qi], "target": q["target"].to_numpy()[qi], "d_key": d_key[di],
                             "distance": dist, "payload": d["payload"].to_numpy(dtype="float64")[di]})
        return pd.concat([p for p in (made, *odd) if len(p)]) if odd else made
    return local_best


def scan_blocks(queries: DataFrame, donors: DataFrame, ranker, schema: str, width: int) -> DataFrame:
    """The best donors of every query, chunk by chunk of its whole block."""
    sizes = donors.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    load = queries.groupBy("block").agg(F.count(F.lit(1)).alias("nq"))
    pairs = sizes.join(load, "block").agg(F.sum(F.col("n").cast("double") * F.col("nq"))).first()[0] or 0
    chunk = int(min(max((pairs / SCAN_GROUPS) ** 0.5, CHUNK), max(SCAN_BYTES // (8 * max(width, 1)), CHUNK)))
    return scan_cells(queries, donors, sizes, ["block"], ranker, schema, chunk)


def scan_cells(routed: DataFrame, celled: DataFrame, cells: DataFrame, cell: list[str], ranker,
               schema: str, chunk: int) -> DataFrame:
    """The best donors of every query within the cells it was sent to.

    ``cells`` holds the rows ``n`` of each cell; cells and their queries are cut into chunks of about
    ``chunk`` rows, and every pair of chunks is one group.
    """
    load = routed.groupBy(*cell).agg(F.count(F.lit(1)).alias("nq"))
    plan, n_cells = store(cells.join(load, cell).select(
        *cell, F.ceil(F.col("n") / chunk).cast("int").alias("dn"),
        F.ceil(F.col("nq") / chunk).cast("int").alias("qn")), "plan")
    plan = F.broadcast(plan) if n_cells <= MAX_CELLS else plan
    q = (routed.join(plan, cell)
         .withColumn("qc", F.pmod(F.xxhash64("key", "target"), F.col("qn")).cast("int"))
         .withColumn("dc", F.explode(F.sequence(F.lit(0), F.col("dn") - 1))))
    d = (celled.join(plan, cell)
         .withColumn("dc", F.pmod(F.xxhash64("key"), F.col("dn")).cast("int"))
         .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))))
    keys = [*cell, "dc", "qc"]
    return (q.drop("dn", "qn").groupBy(*keys).cogroup(d.drop("dn", "qn").groupBy(*keys))
            .applyInPandas(ranker, schema))


def distinct_donors(donors: DataFrame, need: int) -> DataFrame:
    """Of identical donors only the first ``need`` by key can ever be among the nearest."""
    copies = Window.partitionBy("block", "vec").orderBy("key")
    return (donors.select("key", "block", "payload", "vec")
            .withColumn("_rn", F.row_number().over(copies)).where(F.col("_rn") <= need).drop("_rn"))


def nearest(queries: DataFrame, donors: DataFrame, k: int, metric: str = "euclidean",
            exclude_self: bool = False, chunk: int = CHUNK, max_pivots: int = MAX_PIVOTS,
            max_cells: int = MAX_CELLS, recall: float | None = None, **options) -> DataFrame:
    """(q_key, target, rank, d_key, distance, payload): the k nearest donors of every query.

    ``queries``: key, block, target, vec; ``donors``: key, block, payload, vec. ``block`` (string)
    must match; ``target`` >= 0 asks for donors that know that coordinate and returns it as the
    payload, -1 returns the donor's own payload. Ties go to the smaller donor key.

    ``recall`` asks for the approximate join of ``approximate.py`` with its ``options``; without it
    the answer is exact. Equal vectors are searched for once.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    if recall is not None:
        from tallyloom.operators.approximate import nearest_approximately
        return nearest_approximately(queries, donors, k, metric, exclude_self, recall=recall, **options)
    if options:
        raise ValueError(f"only the approximate join takes {sorted(options)}")
    need = k + 1 if exclude_self else k
    queries, n_queries = store(queries.select("key", "block", "target", "vec"), "queries")
    donors, n_donors = store(distinct_donors(donors, need), "donors")
    if exclude_self and (copies := _rows_per_key(donors)) <= MAX_COPIES:
        return _asked_once(queries, donors, k, copies, metric, chunk, max_pivots, max_cells)
    return _nearest(queries, n_queries, donors, n_donors, k, metric, exclude_self, chunk, max_pivots, max_cells)


def _rows_per_key(donors: DataFrame) -> int:
    """The most rows that share a key; a missing key counts as too many, for ties with it go by chunk."""
    n = donors.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max(F.when(F.col("key").isNull(), MAX_COPIES + 1).otherwise(F.col("n")))).first()[0] or 1


def _asked_once(queries: DataFrame, donors: DataFrame, k: int, copies: int, metric: str, chunk: int, max_pivots: int,
                max_cells: int) -> DataFrame:
    """Rows with equal vectors share one search for ``copies`` donors more; each then leaves out its own key."""
    named = queries.withColumn("ask", F.md5(F.to_json(F.struct("block", "target", "vec"))))
    asked, n_asked = store(named.select(F.col("ask").alias("key"), "block", "target", "vec").dropDuplicates(["key"]), "asked")
    found = _nearest(asked, n_asked, donors, donors.count(), k + copies, metric, False, chunk, max_pivots, max_cells)
    found = materialise(found.select(F.col("q_key").alias("ask"), "d_key", "distance", "payload"), "answers")
    near = (named.select(F.col("key").alias("q_key"), "target", "ask").join(found, "ask")
            .where(~F.col("q_key").eqNullSafe(F.col("d_key"))))
    ranked = Window.partitionBy("q_key", "target").orderBy("distance", "d_key")
    return (near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("q_key", "target", "rank", "d_key", "distance", "payload"))


def _nearest(queries: DataFrame, n_queries: int, donors: DataFrame, n_donors: int, k: int, metric: str,
             exclude_self: bool, chunk: int, max_pivots: int, max_cells: int) -> DataFrame:
    """``nearest`` of stored queries and distinct donors."""
    need = k + 1 if exclude_self else k
    key_type = donors.schema["key"].dataType.simpleString()
    out_schema = (f"q_key {queries.schema['key'].dataType.simpleString()}, target int, "
                  f"d_key {key_type}, distance double, payload double")
    if n_donors == 0 or n_queries == 0:
        empty = queries.sparkSession.createDataFrame([], out_schema)
        return empty.select("q_key", "target", F.lit(0).alias("rank"), "d_key", "distance", "payload")

    n_pivots = int(min(max(n_donors // chunk, 1), max_pivots))
    if n_pivots > 1:
        shape = donors.agg(F.max(F.size("vec"))).first()[0]
        blocks = donors.select("block").distinct().count()
        n_pivots = max(min(n_pivots, PIVOT_BYTES // (8 * shape), max_cells // (2 * blocks)), 1)
    picked = [r[0] for r in donors.orderBy(hash_key("key", "pivot"), "key").limit(n_pivots)
              .select("vec").collect()]                    # at most max_pivots vectors
    pivots = np.array([[np.nan if v is None else v for v in vec] for vec in picked], dtype="float64")
    known_rows = ~np.isnan(pivots)
    fill = np.where(known_rows.any(axis=0),
                    np.where(known_rows, pivots, 0.0).sum(axis=0) / np.maximum(known_rows.sum(axis=0), 1), 0.0)
    pivots = np.where(known_rows, pivots, fill)
    width = pivots.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf["vec"], width)
            step = max(MATRIX_CELLS // len(pivots), 1)
            pick, far = [], []
            for s in range(0, len(x), step):
                part = x[s:s + step]
                d = _distances(part, pivots, metric)
                d = np.where(np.isnan(d), np.inf, d)
                best = d.argmin(axis=1)
                got = ~np.isnan(part)
                factor = got.sum(axis=1) / width             # undo the scaling: plain distance
                plain = d[np.arange(len(part)), best]
                plain = plain * (np.sqrt(factor) if metric == "euclidean" else factor)
                pick.append(best)
                far.append(np.where(np.isfinite(plain), plain, 0.0))
            yield pdf.assign(mask=_patterns(x), pivot=np.concatenate(pick).astype("int32"),
                             far=np.concatenate(far))

    celled = materialise(donors.mapInPandas(
        assign, f"key {key_type}, block string, payload double, vec array<double>, "
                "mask string, pivot int, far double"), "celled")
    cell = ["block", "mask", "pivot"]
    def statistics(table: DataFrame) -> DataFrame:
        return table.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))

    # Patterns take cells of their own while half of the cells last, the most frequent first; the
    # donors of all others share one cell per block and pivot, which every query visits.
    stats = materialise(statistics(celled), "cells")
    if stats.count() > max_cells:
        frequent = stats.groupBy("mask").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"))
        room, keep = max_cells // 2, []
        for r in frequent.orderBy(F.desc("rows"), "mask").limit(max_cells // 2).collect():
            room -= r["cells"]
            if room < 0:
                break
            keep.append((r["mask"],))
        kept = celled.sparkSession.createDataFrame(keep, "mask string").withColumn("own", F.lit(True))
        joined = celled.join(F.broadcast(kept), "mask", "left")        # at most max_cells / 2 rows
        celled = materialise(joined.withColumn("mask", F.when(F.col("own"), F.col("mask")).otherwise(MIXED))
                             .select(*celled.columns), "celled")
        stats = statistics(celled)
    rows = bounded_rows(stats, max(max_cells, 2 * n_pivots), "neighbour cells")
    cells = _Cells(rows, pivots, metric)
    spark = donors.sparkSession
    ranked = Window.partitionBy("q_key", "target").orderBy("distance", "d_key")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    if queries.where(F.col("target") >= 0).limit(1).count() == 0 and cells.open_share(
            queries.orderBy(hash_key("key", "share"), "key").limit(SHARE_SAMPLE).collect(), need) > SCAN_SHARE:
        whole = scan_blocks(queries, donors, tile_ranker(width, k, metric, exclude_self), out_schema, width)
        return best(whole).select("q_key", "target", "rank", "d_key", "distance", "payload")
    cell_table = spark.createDataFrame(
        [(r["block"], r["mask"], r["pivot"], r["n"]) for r in rows],
        "block string, mask string, pivot int, n long")

    def route(batches: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(MATRIX_CELLS // max(len(cells.n), len(cells.pivots)), 1)
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                lower, upper = cells.bounds(_matrix(part["vec"], width),
                                            part["block"].to_numpy(dtype=object),
                                            part["target"].to_numpy())
                go = cells.home(upper, need)
                if not home:
                    theta = part["theta"].to_numpy(dtype="float64")
                    theta = np.where(np.isnan(theta), np.inf, theta) * (1 + 1e-9) + 1e-12
                    go = ~go & np.isfinite(lower) & (lower <= theta[:, None])
                every_q, every_c = np.nonzero(go)
                for at in range(0, len(every_q), max(ROUTED_CELLS // width, 1)):   # each row carries its vector
                    qi, ci = (i[at:at + max(ROUTED_CELLS // width, 1)] for i in (every_q, every_c))
                    yield pd.DataFrame({
                        "key": part["key"].to_numpy()[qi], "target": part["target"].to_numpy()[qi],
                        "vec": part["vec"].to_numpy(dtype=object)[qi],
                        "block": cells.block[ci], "mask": cells.mask[ci],
                        "pivot": cells.pivot[ci].astype("int32")})

    q_type = queries.schema["key"].dataType.simpleString()
    routed_schema = (f"key {q_type}, target int, vec array<double>, block string, mask string, "
                     "pivot int")

    def scan(routed: DataFrame) -> DataFrame:
        return scan_cells(materialise(routed, "routed"), celled.drop("far"), cell_table, cell,
                          chunk_ranker(width, k, metric, exclude_self), out_schema, chunk)

    first = scan(queries.mapInPandas(lambda it: route(it, True), routed_schema))
    if len(set(cells.block)) < len(cells.n):               # some block has several cells
        first = materialise(best(first).drop("rank"), "first")
        theta = (first.groupBy("q_key", "target")
                 .agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))
                 .select(F.col("q_key").alias("key"), "target",
                         F.when(F.col("_n") >= k, F.col("_far")).alias("theta")))
        bounded = queries.join(theta, ["key", "target"], "left").select(
            "key", "block", "target", "vec", "theta")
        first = first.unionByName(scan(bounded.mapInPandas(lambda it: route(it, False), routed_schema)))
    return best(first).select("q_key", "target", "rank", "d_key", "distance", "payload")


def _side(df: DataFrame, key: str, vector: str, block: str | None, payload: str | None) -> DataFrame:
    return df.select(
        F.col(key).alias("key"),
        (F.col(block).cast("string") if block else F.lit("")).alias("block"),
        F.lit(-1).alias("target"),
        (F.col(payload).cast("double") if payload else F.lit(None).cast("double")).alias("payload"),
        F.col(vector).cast("array<double>").alias("vec"))


def same_class_neighbors(df: DataFrame, key: str, vector: str, label: str, k: int = 5,
                         metric: str = "euclidean", **kw) -> DataFrame:
    """(q_key, rank, d_key, distance): the k nearest other rows of the same class."""
    side = _side(df, key, vector, label, None)
    return nearest(side, side, k, metric, exclude_self=True, **kw).drop("target", "payload")


def cross_neighbors(queries: DataFrame, donors: DataFrame, key: str, vector: str, label: str,
                    k: int = 5, metric: str = "euclidean", **kw) -> DataFrame:
    """(q_key, rank, d_key, distance, payload = donor label)."""
    return nearest(_side(queries, key, vector, None, None), _side(donors, key, vector, None, label),
                   k, metric, **kw).drop("target")


def vote(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """(q_key, payload, weight): class weights among the neighbours.

    ``distance`` weights are 1/d; donors at distance 0 outvote all others.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        nearest_one = F.min("distance").over(Window.partitionBy("q_key"))   # k rows per query
        neighbors = neighbors.withColumn("_zero", nearest_one == 0)
        w = F.when(F.col("_zero"), (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance")))
    return neighbors.groupBy("q_key", "payload").agg(F.sum(w).alias("weight"))


def predict_by_vote(votes: DataFrame) -> DataFrame:
    """(q_key, prediction): the heaviest class, ties to the smaller label."""
    return votes.groupBy("q_key").agg(
        F.min_by("payload", F.struct(-F.col("weight"), F.col("payload"))).alias("prediction"))
