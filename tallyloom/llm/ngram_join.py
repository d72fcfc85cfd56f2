"""Self-join of documents by the Jaccard similarity of their word shingles, with several global token orders.

A document is the set of its distinct five-word shingles. Two sets link when 100 * common >= ``PERCENT`` *
union. Documents with equal sets are one *node* from the first step on.

1. *First order:* by document frequency, rare tokens first. A node whose tokens are not shared with
   another one by 80 percent has no partner and is out: prose without a near copy ends here. Linked nodes share a
   token among the first n - ceil(0.8 n) + 1, and enough tokens are left from the first shared one on (sizes and
   positions are checked in the join). Passages that many documents share are frequent, hence last.
2. *Further orders:* two hash orders. A candidate pair must share a token among the first n - ceil(0.8 n) + 1 under
   each. Only pairs that pass all orders are verified, on the whole sets.

Pairs are not spelled out inside a large group of near copies. First every node is compared with one
pivot per token, the node with the most shared tokens; verified links are contracted to components, and only
then pairs of nodes in different components that share a token of their prefixes are compared. What is left unlinked
after that has no link, so the components are those of all links.

Tokens in very many nodes are found beforehand (at most ``HOT_TOKENS``, a proven bound) and placed last in
the first order without meeting in one bucket.

Sets are known by a 64-bit hash and their size, tokens by 64 bits (40 inside one verified pair).

Defined cases: A-Z count as a-z, nothing else is folded; a document with fewer than five words has one
shingle, its whole sequence; without words or text it has none and links with nothing. Rows with equal ids are
judged one by one. A component without any id has a null label. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import rows_packed, text_of, trim
from tallyloom.llm.exact_dedup import filter_bits, hit_bitmap, probe_bitmap
from tallyloom.llm.graph import components
from tallyloom.llm.shingles import narrow, set_keys, shingle_sets, smallest, widen
from tallyloom.llm.substrings import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERCENT = 80
BUCKET_BYTES = 8 << 20     # of text whose tokens meet in one bucket
FLUSH_BYTES = 8 << 20
BLOCK_BYTES = 1 << 19       # of text hashed at once; numpy needs about 50 times that
HOT_LEAST = 1000           # nodes that make a token hot at least
HOT_TOKENS = 200_000       # tokens that can be hot at most
ORDERS = (1, 2)            # salts of the further hash orders
PACKED = "bucket int, data binary"


def need(n, percent: int = PERCENT):
    """Smallest overlap with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


# ------------------------------------------------------------------ tasks

def _blocks(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(b.column("id").to_pylist(), b.column("text")):
        ids.append(i)
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for ids, texts in _blocks(b):
            token, counts = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column("id").type), pa.array(counts, pa.int64()),
                 pa.array(set_keys(token, counts).view(np.int64), pa.int64()), b.column("h").slice(at, len(ids))],
                ["doc_id", "n", "k", "h"])
            at += len(ids)
    trim()


class _Flush:
    """Tokens of the distinct sets of a stretch of texts."""

    def __init__(self):
        self.seen, self.tokens, self.keys, self.sizes, self.held = set(), [], [], [], 0

    def add(self, texts: list[bytes]) -> None:
        token, counts = shingle_sets(texts)
        keys = set_keys(token, counts).view(np.int64)
        at = np.cumsum(counts) - counts
        for i, (k, n) in enumerate(zip(keys.tolist(), counts.tolist())):
            if n and (k, n) not in self.seen:
                self.seen.add((k, n))
                self.tokens.append(token[at[i]:at[i] + n])
                self.keys.append(k)
                self.sizes.append(n)
        self.held += sum(map(len, texts))

    def flat(self):
        """(token, row) with row an index into keys and sizes."""
        return np.concatenate(self.tokens), np.repeat(np.arange(len(self.keys)), self.sizes)


def _flushes(batches) -> Iterator[_Flush]:
    now = _Flush()
    for b in batches:
        for _, texts in _blocks(b):
            now.add(texts)
            if now.held >= FLUSH_BYTES:
                if now.keys:
                    yield now
                now = _Flush()
    if now.keys:
        yield now
    del now
    trim()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens held twice or more in a flush, with that count; a row with token null counts the flush."""
    for flush in _flushes(batches):
        token = np.sort(flush.flat()[0])
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(at, len(token)))
        keep = n > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *token[at][keep].view(np.int64).tolist()], pa.int64()),
             pa.array([len(token), *n[keep].tolist()], pa.int64())], ["token", "n"])


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "i8")


def _by_node(to: np.ndarray, row: np.ndarray, keys: np.ndarray, sizes: np.ndarray, **columns) -> list[tuple]:
    """One packed row per destination: nodes, rows of each, columns."""
    if not len(to):
        return []
    order = np.lexsort((row, to))
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        r = row[part]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out.append((int(to[part[0]]), pickle.dumps(
            (keys[r[at]], _small(sizes[r[at]]), _small(np.diff(np.append(at, len(r)))),
             {k: _small(v[part]) for k, v in columns.items()}), 5)))
    return out


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {}
    for b in blobs:
        keys, sizes, counts, columns = pickle.loads(b)
        for k, v in {"k": np.repeat(keys, counts), "n": np.repeat(sizes, counts), **columns}.items():
            parts.setdefault(k, []).append(v.astype(np.int64))
    return {k: np.concatenate(v) for k, v in parts.items()}


def _home(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _poster(parts: int, hot):
    """Tokens to buckets; hot tokens, known to be shared, straight to the node's home (-1 - home)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.sort(np.array(hot.value, np.int64).view(np.uint64))
        for flush in _flushes(batches):
            token, row = flush.flat()
            keys, sizes = np.array(flush.keys, np.int64), np.array(flush.sizes, np.int64)
            spot = np.minimum(np.searchsorted(often, token), max(0, len(often) - 1))
            known = often[spot] == token if len(often) else np.zeros(len(token), bool)
            cold = ~known
            rows = _by_node((token[cold] % np.uint64(parts)).astype(np.int64), row[cold], keys, sizes,
                            token=(token[cold] // np.uint64(parts)).astype("u4").astype(np.int64))
            direct = [(-1 - b, d) for b, d in _by_node(
                _home(keys, parts)[row[known]], row[known], keys, sizes,
                token=spot[known], often=np.zeros(int(known.sum()), np.int64))]
            yield _packed(rows + direct)
    return run


def _frequencies(parts: int):
    """Of a bucket the tokens in two or more nodes, with their number of nodes, to the nodes' homes."""
    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("data").to_pylist()
        if bucket < 0:
            return pa.Table.from_batches([_packed([(-1 - bucket, d) for d in blobs])])
        a = _unpack(blobs)
        order = np.lexsort((a["n"], a["k"], a["token"]))
        t, k, n = a["token"][order], a["k"][order], a["n"][order]
        other = np.concatenate([[True], t[1:] != t[:-1]])
        new = other | np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        t, k, n = t[new], k[new], n[new]
        at = np.flatnonzero(other[new])
        often = np.repeat(np.diff(np.append(at, len(t))), np.diff(np.append(at, len(t))))
        keep = often > 1
        t, k, n, often = t[keep], k[keep], n[keep], often[keep]
        # nodes as rows of a table, so that a node's tokens travel together
        order = np.lexsort((n, k))
        t, k, n, often = t[order], k[order], n[order], often[order]
        row = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])) - 1 if len(k) else k
        first = np.flatnonzero(np.diff(np.concatenate([[-1], row]))) if len(k) else row
        rows = _by_node(_home(k, parts), row, k[first], n[first], token=t * parts + bucket, often=often)
        return pa.Table.from_batches([_packed(rows)])
    return run


_PREFIX = "token long, k long, n long, place int, shared int"


def _prefixes(percent: int):
    """Rare-first prefixes of the nodes that share enough tokens. Hot tokens (often = 0) are last."""
    def run(table: pa.Table) -> pa.Table:
        a = _unpack(table.column("data").to_pylist())
        order = np.lexsort((a["token"], np.where(a["often"] == 0, np.iinfo(np.int64).max, a["often"]), a["n"], a["k"]))
        token, often, k, n = (a[c][order] for c in ("token", "often", "k", "n"))
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1]) | (token[1:] != token[:-1])
                              | (often[1:] != often[:-1])])
        token, often, k, n = token[new], often[new], k[new], n[new]
        node = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        at = np.flatnonzero(node)
        shared = np.diff(np.append(at, len(k)))
        group = np.cumsum(node) - 1
        size = n[at]
        place = (size - shared)[group] + np.arange(len(k)) - at[group]       # tokens of one node alone come first
        keep = place < (size - need(size, percent) + 1)[group]
        # hot tokens get numbers of their own, below all others
        token = np.where(often == 0, -1 - token, token)
        return pa.table({"token": pa.array(token[keep], pa.int64()), "k": pa.array(k[keep], pa.int64()),
                         "n": pa.array(n[keep], pa.int64()), "place": pa.array(place[keep], pa.int32()),
                         "shared": pa.array(shared[group][keep], pa.int32())})
    return run


def _setter(percent: int):
    """Whole sets and the prefixes of the further orders, of the rows whose node was asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = iter(zip(b.column("k").to_pylist(), b.column("n").to_pylist()))
            for _, texts in _blocks(b):
                token, counts = shingle_sets(texts)
                keys, ends = set_keys(token, counts).view(np.int64).tolist(), np.cumsum(counts).tolist()
                rows = []
                for key, n, e in zip(keys, counts.tolist(), ends):
                    if next(asked) != (key, n):
                        continue
                    mine = token[e - n:e]
                    p = n - need(n, percent) + 1
                    low = np.sort(mine & np.uint64((1 << 40) - 1))
                    rows.append((key, n, narrow(low), pickle.dumps([smallest(mine, s, p) for s in ORDERS], 5)))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["k", "n", "tokens", "orders"])
    return run


def _shares_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [all(len(np.intersect1d(p, q)) for p, q in zip(pickle.loads(x), pickle.loads(y)))
              for x, y in zip(b.column("left").to_pylist(), b.column("right").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "an", "b", "bn")],
                                         ["a", "an", "b", "bn"]).filter(pa.array(ok, pa.bool_()))


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, n, m in zip(*[b.column(c).to_pylist() for c in ("left", "right", "an", "bn")]):
                common = len(np.intersect1d(widen(x), widen(y), assume_unique=True))
                ok.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


# ------------------------------------------------------------------ the job

def _hot_tokens(rows: DataFrame) -> list[int]:
    """Every token in at least max(HOT_LEAST, tokens / HOT_TOKENS, 4 * flushes) nodes is among them.

    A flush only reports tokens it saw twice, so a count may miss one node per flush, no more.
    """
    counted = materialise(rows.mapInArrow(_common, "token long, n long"), "common_tokens")
    flushes, total = counted.where("token is null").agg(F.count(F.lit(1)), F.sum("n")).first()
    bar = max(HOT_LEAST, -(-(total or 0) // HOT_TOKENS), 4 * flushes) - flushes
    hot = counted.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= bar)
    return [r.token for r in hot.select("token").toLocalIterator()]


def _side(sets: DataFrame, column: str, node: str, size: str, name: str) -> DataFrame:
    return sets.select(F.col("k").alias(node), F.col("n").alias(size), F.col(column).alias(name))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b) among candidates (a, an, b, bn)."""
    def with_both(df, column):
        return (df.join(_side(sets, column, "a", "an", "left"), ["a", "an"])
                  .join(_side(sets, column, "b", "bn", "right"), ["b", "bn"]))

    passed = materialise(with_both(pairs, "orders").select("a", "an", "b", "bn", "left", "right")
                         .mapInArrow(_shares_all, "a long, an long, b long, bn long"), "passed")
    return materialise(with_both(passed, "tokens").select("a", "an", "b", "bn", "left", "right")
                       .mapInArrow(_verifier(percent), "a long, b long"), "links")


def _plausible(percent: int) -> Column:
    """Size and position filters for prefix rows x and y of one token."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (small * 100 >= large * percent) & (rest * (100 + percent) >= (small + large) * percent)


def _ordered() -> list[Column]:
    first = (F.col("x.k") < F.col("y.k"))
    return [F.when(first, F.col("x.k")).otherwise(F.col("y.k")).alias("a"),
            F.when(first, F.col("x.n")).otherwise(F.col("y.n")).alias("an"),
            F.when(first, F.col("y.k")).otherwise(F.col("x.k")).alias("b"),
            F.when(first, F.col("y.n")).otherwise(F.col("x.n")).alias("bn")]


def node_components(docs: DataFrame, slim: DataFrame, text: str, id_col: str, percent: int) -> DataFrame:
    """(node, root) of the nodes that link with another one."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text]).alias("text"))
    total = docs.agg(F.sum(F.octet_length(docs[text]).cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(_hot_tokens(rows))
    posted = rows.mapInArrow(_poster(parts, hot), PACKED)
    shared = posted.groupBy("bucket").applyInArrow(_frequencies(parts), PACKED)
    prefixes = materialise(shared.groupBy("bucket").applyInArrow(_prefixes(percent), _PREFIX), "prefixes")

    nodes = prefixes.select("k", "n").distinct()
    # one id and text hash per node: ids alone may be null or repeated in any number of rows
    least = slim.groupBy("k", "n").agg(F.min("doc_id").alias("least"),
                                       F.coalesce(F.min_by("h", "doc_id"), F.min("h")).alias("body"))
    asked = materialise(least.join(nodes, ["k", "n"]).select("k", "n", "least", "body"), "asked")
    # most texts have no partner: a bitmap of the wanted rows (at most 64 MB) keeps them out of the shuffle
    bits = filter_bits(asked.count())
    wanted = materialise(hit_bitmap(asked.select(F.xxhash64("least", "body").alias("h")), "h", bits, 1), "wanted")
    hashed = rows.withColumn("own", F.xxhash64("text")).withColumn("h", F.xxhash64("id", "own"))
    near = probe_bitmap(hashed, "h", wanted, bits).where("maybe")
    found = near.join(asked, near.id.eqNullSafe(asked.least) & (near.own == asked.body)).select("id", "text", "k", "n")
    sets = materialise(found.mapInArrow(_setter(percent), "k long, n long, tokens binary, orders binary"), "sets")
    if sets.count() > asked.count():      # rows written twice, equal in id and text
        sets = materialise(sets.dropDuplicates(["k", "n"]), "sets")

    central = F.struct((F.col("shared") / F.col("n")).alias("part"), (-F.col("k")).alias("by"), "k", "n", "place")
    pivots = materialise(prefixes.groupBy("token").agg(F.max(central).alias("m"), F.count(F.lit(1)).alias("held"))
                                 .where("held > 1").select("token", "m.k", "m.n", "m.place"), "pivots")
    star = (prefixes.alias("x").join(pivots.alias("y"), "token")
                    .where((F.col("x.k") != F.col("y.k")) & _plausible(percent)).select(*_ordered()).distinct())
    star = materialise(star, "star")
    linked = _links(star, sets, percent)
    roots = components(linked)

    # pairs of nodes that no link has joined so far
    grouped = materialise(prefixes.join(pivots.select("token"), "token")
                                  .join(roots.withColumnRenamed("node", "k"), "k", "left")
                                  .withColumn("root", F.coalesce("root", "k")), "grouped")
    several = materialise(grouped.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                                 .where("lo < hi").select("token"), "several")
    open_rows = materialise(grouped.join(several, "token"), "open")
    rest = (open_rows.alias("x").join(open_rows.alias("y"), "token")
                     .where((F.col("x.k") < F.col("y.k")) & (F.col("x.root") != F.col("y.root")) & _plausible(percent))
                     .select(*_ordered()).distinct())
    rest = materialise(rest.join(star, ["a", "an", "b", "bn"], "left_anti"), "rest")
    more = _links(rest, sets, percent)
    if more.isEmpty():
        return roots
    return components(linked.unionByName(more))


def _sized(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Per row: doc_id, size and hash of its set (n, k), hash of its text (h)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text]).alias("text"),
                       F.xxhash64(text_of(docs[text])).alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialise(rows.mapInArrow(_sizes, f"doc_id {kind}, n long, k long, h long"), "sizes")


def ngram_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    slim = _sized(docs, text, id_col)
    roots = node_components(docs, slim, text, id_col, percent)
    nodes = slim.where("n > 0").groupBy("k", "n").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    placed = materialise(placed, "placed")
    linked = placed.join(roots.select("root").distinct(), "root", "left_semi")
    labels = materialise(linked.groupBy("root").agg(F.min("least").alias("label")), "labels")
    named = materialise(placed.join(labels, "root", "left")
                              .select("k", "n", F.coalesce("label", "least").alias("component_id")), "named")
    joined = slim.join(named, ["k", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The documents with exactly one row left of each component; columns as they were.

    The row with the smallest id stays (no id comes last), then the one with the smallest set key and text hash.
    Rows are known by id and a 64-bit hash of the text, so rows of other texts without an id or under the
    same id stay. Of rows that agree in both, one stays, by the hash of its other columns.
    """
    slim = _sized(docs, text, id_col)
    roots = node_components(docs, slim, text, id_col, percent).withColumnRenamed("node", "k")
    rows = slim.where("n > 0").join(roots, "k", "left").select(
        "doc_id", "k", "n", "h", F.coalesce("root", "k").alias("root"),
        F.when(F.col("root").isNull(), F.col("n")).otherwise(F.lit(0)).alias("alone"))    # 0: linked with other sets
    rows, of = materialise(rows, "members"), ["root", "alone"]
    several = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(*of)
    rows = materialise(rows.join(several, of), "several")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "n", "h")
    first = materialise(rows.groupBy(*of).agg(F.min(place).alias("first")), "first")
    keys = rows.join(first, of).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"),
                                       place.eqNullSafe(F.col("first")).alias("_kept"))
    keys = materialise(keys.groupBy("_id", "_h").agg(F.max("_kept").alias("_kept"), F.count(F.lit(1)).alias("_held")),
                       "keys")
    gone, twice = keys.where("not _kept or _held > 1"), keys.where("_kept and _held > 1")
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(text_of(docs[text])) == gone["_h"]),
                    "left_anti")
    if twice.isEmpty():
        return out
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (id_col, text)]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    equal = (rows_packed(docs).join(twice, F.col(f"row.`{id_col}`").eqNullSafe(twice["_id"])
                                    & (F.xxhash64(text_of(F.col(f"row.`{text}`"))) == twice["_h"]))
                              .select("row", "_id", "_h", rest.alias("rest")))
    once = materialise(equal, "equal").groupBy("_id", "_h").agg(F.min_by("row", "rest").alias("row"))
    return out.union(once.select("row.*"))
