"""Approximate nearest neighbours with a stated recall: random-projection buckets, several tables.

Every table halves the donors of a block along one random direction per level, at the median of each node, until a
bucket holds about ``leaf`` rows. A query visits in each table the ``probes`` buckets whose splits it violates least;
the donors found there are ranked by their exact distances. The number of probes is the smallest that finds
the asked share of the true neighbours of a sample of queries, which the exact join answers; the share is raised by two
standard errors of that sample.

Medians come from about ``PER_NODE`` donors of each node (a hash sample that grows with the level), so a level
is one small job. Buckets are equally full whatever the data look like, and their number grows with the donors: a query
meets tables x probes x leaf donors however many there are. Only ``MAX_LEAVES`` buckets fit; beyond
MAX_LEAVES x leaf / tables donors the buckets grow instead.

Without structure the asked share takes so many buckets that sending a query to them costs more than comparing it
with every donor of its block: a row sent to a bucket costs about as much as ``ROUTE_COST`` distances. The calibration
stops there, and the exact join answers; its recall is 1. Fixed ``probes`` are always followed.

Defined results: a query with fewer than k donors in its buckets is answered exactly. Missing coordinates
count as their mean for the choice of buckets and are left out of distances. Without donors or queries nothing is returned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.expr import hash_key
from tallyloom.functions.scale import bounded_rows, materialise, store
from tallyloom.operators.neighbors import (
    CHUNK, MATRIX_CELLS, ROUTED_CELLS, _matrix, chunk_ranker, distinct_donors, nearest, scan_cells,
)

# task functions travel whole, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 512
TABLES = 4
SAMPLE = 256              # queries answered exactly to choose the number of probes
PER_NODE = 512            # donors whose median splits a node
MAX_LEAVES = 1 << 21      # of all tables; the medians are shipped to every task
MAX_BLOCKS = 100_000
FIRST_PROBES = 8          # how far the sample looks at first; eight times as far until the share is reached
ROUTE_COST = 512          # distances that cost as much as a query's row in one bucket
CELL = ["block", "mask", "pivot"]      # block, table and bucket under the names of the exact join's cells


def _beam(p: np.ndarray, medians: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best buckets of every row of projections, best first, and their costs.

    A bucket costs the squared distances to the medians on whose other side it lies. One child of a node always costs
    as much as the node, so keeping ``width`` nodes a level loses none of the ``width`` best buckets.
    """
    node, cost = np.zeros((len(p), 1), "int64"), np.zeros((len(p), 1))
    for level in range(depth):
        gap = p[:, level:level + 1] - medians[(1 << level) - 1 + node]
        node = np.concatenate([2 * node, 2 * node + 1], axis=1)
        cost = np.concatenate([cost + np.maximum(gap, 0) ** 2, cost + np.maximum(-gap, 0) ** 2], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :width]
        node, cost = np.take_along_axis(node, order, axis=1), np.take_along_axis(cost, order, axis=1)
    return node, cost


class Forest:
    """Random-projection buckets of the donors; ``grow`` makes one."""

    def __init__(self, depths: dict[str, int], centre: np.ndarray, tables: int, seed: int,
                 sizes: dict[str, int] | None = None):
        self.depths, self.centre, self.tables, self.sizes = depths, centre, tables, sizes or {}
        deepest = max(depths.values())
        made = np.random.default_rng(seed).normal(size=(tables, max(deepest, 1), len(centre)))
        self.directions = made / np.linalg.norm(made, axis=2, keepdims=True)
        # a node without sampled donors sends everything to the left
        self.medians = {b: np.full((tables, (1 << d) - 1), np.inf) for b, d in depths.items()}

    @property
    def most(self) -> int:
        """Buckets of the largest block."""
        return 1 << max(self.depths.values())

    @property
    def affordable(self) -> int:
        """Probes that cost no more than comparing a query with all donors of its block, on the average donor's block;
        the first few are always allowed."""
        rows = sum(self.sizes.values())
        mean = sum(n * n for n in self.sizes.values()) / rows if rows else 0.0
        return max(int(mean // (ROUTE_COST * self.tables)), FIRST_PROBES)

    def _projections(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.where(np.isnan(x), self.centre, x) @ self.directions[table].T

    def _walk(self, pdf: pd.DataFrame, width: int, depth: int | None = None):
        """(rows, table, projections, buckets, costs) of the rows of one block, slice by slice."""
        for block, at in pdf.groupby("block", sort=False).indices.items():
            if block not in self.depths:
                continue
            deep = self.depths[block] if depth is None else depth
            for part in np.array_split(at, -(-len(at) * 2 * width // MATRIX_CELLS)):
                x = _matrix(pdf["vec"].iloc[part], len(self.centre))
                for table in range(self.tables):
                    p = self._projections(x, table)
                    yield part, table, p, *_beam(p, self.medians[block][table], deep, width)

    def splits(self, donors: DataFrame, sizes: dict[str, int], level: int) -> DataFrame:
        """(block, table, node, median) of one level, from a hash sample of the donors."""
        share = {b: min(1.0, PER_NODE * (1 << level) / n) for b, n in sizes.items() if self.depths[b] > level}

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["u"] < pdf["block"].map(share).fillna(0.0)].reset_index(drop=True)
                for part, table, p, node, _ in self._walk(pdf, 1, level):
                    yield pd.DataFrame({"block": pdf["block"].to_numpy()[part], "table": table, "node": node[:, 0],
                                        "p": p[:, level]})
        u = F.pmod(F.xxhash64("key", F.lit("split")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = donors.select("block", "vec", u.alias("u")).where(F.col("u") < max(share.values()))
        return (drawn.mapInPandas(placed, "block string, table int, node long, p double")
                .groupBy("block", "table", "node").agg(F.percentile("p", 0.5).alias("median")))

    def leaves(self, donors: DataFrame) -> DataFrame:
        """The donors once per table, with table (``mask``) and bucket (``pivot``)."""
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, table, _, node, _ in self._walk(pdf, 1):
                    yield pdf.iloc[part].assign(mask=str(table), pivot=node[:, 0].astype("int32"))
        return donors.mapInPandas(assign, f"{_fields(donors)}, mask string, pivot int")

    def routed(self, queries: DataFrame, probes: int) -> DataFrame:
        """The queries once per visited bucket, with its place (from 1) in the query's order."""
        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, table, _, node, cost in self._walk(pdf, probes):
                    every_q, every_c = np.nonzero(np.isfinite(cost))
                    step = max(ROUTED_CELLS // max(len(self.centre), 1), 1)          # each row carries its vector
                    for at in range(0, len(every_q), step):
                        qi, ci = every_q[at:at + step], every_c[at:at + step]
                        yield pdf.iloc[part[qi]].assign(mask=str(table), pivot=node[qi, ci].astype("int32"),
                                                        place=(ci + 1).astype("int32"))
        return queries.mapInPandas(route, f"{_fields(queries)}, mask string, pivot int, place int")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def grow(donors: DataFrame, leaf: int = LEAF, tables: int = TABLES, seed: int = 42) -> Forest:
    """Buckets of about ``leaf`` donors (key, block, vec) in each of ``tables`` tables."""
    sizes = {r["block"]: r["n"] for r in bounded_rows(
        donors.groupBy("block").agg(F.count(F.lit(1)).alias("n")), MAX_BLOCKS, "blocks of neighbours")}
    means = bounded_rows(donors.select(F.posexplode("vec").alias("at", "v")).groupBy("at").agg(
        F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("m")), 1 << 20, "coordinates")
    centre = np.zeros(len(means))
    for r in means:
        centre[r["at"]] = r["m"] or 0.0
    depths = {b: max(0, math.ceil(math.log2(n / leaf))) for b, n in sizes.items()}
    while tables * sum(1 << d for d in depths.values()) > max(MAX_LEAVES, tables * len(depths)):
        depths = {b: max(d - 1, 0) for b, d in depths.items()}
    forest = Forest(depths, centre, tables, seed, sizes)
    for level in range(max(depths.values())):
        for r in forest.splits(donors, sizes, level).toLocalIterator():      # at most MAX_LEAVES rows in all
            forest.medians[r["block"]][r["table"], (1 << level) - 1 + r["node"]] = r["median"]
    return forest


def probes_for(forest: Forest, queries: DataFrame, donors: DataFrame, leaves: DataFrame, k: int, metric: str,
               exclude_self: bool, recall: float, sample: int = SAMPLE, most: int | None = None) -> int | None:
    """The fewest probes that find the asked share of the exact neighbours of sampled queries; None if beyond ``most``."""
    most = forest.most if most is None else min(most, forest.most)
    asked, n = store(queries.orderBy(hash_key(F.concat_ws("-", "key", "target"), "probes"), "key", "target").limit(sample),
                     "asked")
    truth = nearest(asked, donors, k, metric, exclude_self).select(
        F.col("q_key").alias("key"), "target", F.col("d_key"))
    homes = leaves.select(F.col("key").alias("d_key"), *CELL)
    found = materialise(truth.join(asked.select("key", "target", "block"), ["key", "target"])
                        .join(homes, ["d_key", "block"]), "truth")
    goal = recall + min(2 * math.sqrt(recall * (1 - recall) / max(n, 1)), (1 - recall) / 2)
    width = min(FIRST_PROBES, most)
    while True:
        seen = forest.routed(asked, width).select("key", "target", *CELL, "place")
        first = (found.join(seen, ["key", "target", *CELL], "left").groupBy("key", "target", "d_key")
                 .agg(F.min("place").alias("place")))
        places = dict(first.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())   # width + 1 rows at most
        total = sum(places.values())
        reached = 0
        for p in range(1, width + 1):
            reached += places.get(p, 0)
            if reached >= goal * total:
                return p
        if width >= most:
            return width if width >= forest.most else None
        width = min(8 * width, most)


def nearest_approximately(queries: DataFrame, donors: DataFrame, k: int, metric: str = "euclidean",
                          exclude_self: bool = False, recall: float = 0.9, leaf: int = LEAF, tables: int = TABLES,
                          probes: int | None = None, chunk: int = CHUNK, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(q_key, target, rank, d_key, distance, payload) as ``neighbors.nearest``, at the asked recall.

    ``probes`` fixes the visited buckets per table instead of choosing them for ``recall``.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1; leave it out for the exact join")
    queries, n_queries = store(queries.select("key", "block", "target", "vec"), "queries")
    donors, n_donors = store(distinct_donors(donors, k + 1 if exclude_self else k), "donors")
    if n_queries == 0 or n_donors == 0:
        return nearest(queries, donors, k, metric, exclude_self)
    forest = grow(donors, leaf, tables, seed)
    leaves = materialise(forest.leaves(donors), "leaves")
    if probes is None:
        probes = probes_for(forest, queries, donors, leaves, k, metric, exclude_self, recall, sample, forest.affordable)
        if probes is None:
            return nearest(queries, donors, k, metric, exclude_self)
    cells = leaves.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    q_type, d_type = (t.schema["key"].dataType.simpleString() for t in (queries, donors))
    found = scan_cells(materialise(forest.routed(queries, probes).drop("place"), "routed"), leaves, cells, CELL,
                       chunk_ranker(len(forest.centre), k, metric, exclude_self),
                       f"q_key {q_type}, target int, d_key {d_type}, distance double, payload double", chunk)
    once = found.groupBy("q_key", "target", "d_key").agg(F.min("distance").alias("distance"), F.min("payload").alias("payload"))
    ranked = Window.partitionBy("q_key", "target").orderBy("distance", "d_key")
    best = materialise(once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
                       .select("q_key", "target", "rank", "d_key", "distance", "payload"), "best")
    full = best.where(F.col("rank") == k).select(F.col("q_key").alias("key"), "target")
    short, n_short = store(queries.join(full, ["key", "target"], "left_anti").select("key", "block", "target", "vec"), "short")
    if n_short == 0:
        return best
    whole = best.join(full.select(F.col("key").alias("q_key"), "target"), ["q_key", "target"])
    return whole.select(*best.columns).unionByName(nearest(short, donors, k, metric, exclude_self))
