"""Compression of vectors into four code bytes, codebooks fitted by exact integer rounds.

Components become integers, vectors four equal parts, each part position has a codebook of at most 256
entries. Every round assigns all parts to their nearest entry and moves the entries.

1. *Flat blocks.* Tasks take their rows in chunks and sort each part position of a chunk along a Hilbert curve, so
   that neighbours in space stand together; runs of ``BLOCK`` parts keep their least and largest components (a box)
   and their sums. The chunks are written once, every round reads that table; nothing is shuffled.
2. *Shortlists.* A round computes, for each box, the least and the largest distance to every entry. Entries
   farther at least than another one is at most cannot be nearest to anything inside; the rest is the shortlist.
   A shortlist of one takes the whole block by its stored sums. Otherwise the block's parts are
   compared with the shortlist only, in whole numbers (held in doubles where every sum is below 2**53, where
   they are exact, else in 64-bit integers).
3. *Sums.* Tasks add up what each entry gained; Spark adds the tasks. The driver sees the codebooks alone,
   4 * 256 entries at most, and floors the quotients in unbounded integers.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Rows with a null id stay and
count as larger than any id; rows with equal ids are ordered by their vectors and coded one by one. Equal labels
are summed together, null being one label. With fewer than 256 rows the codebooks are smaller. Vectors of
different lengths, of a length that four does not divide, or with components beyond +-2**27 / 1024 (whose squared
distances leave 64 bits) are an error. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import BROADCAST_ROWS, materialise, store
from tallyloom.llm.vectors import finite, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 27
BLOCK = 64
CHUNK_BYTES = 8 << 20      # of whole-number components sorted together
EXACT = 1 << 53            # whole numbers below are exact in a double


# ------------------------------------------------------------------ kernels

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid cells (rows x axes, ``bits`` bits each, 64 in all at most)."""
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    level = bits - 1
    while level > 0:                                       # undo the rotations, from the coarsest level on
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            inside = (axes[i] & bit) > 0
            swap = np.where(inside, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[i] = axes[i] ^ swap
            axes[0] = np.where(inside, axes[0] ^ low, axes[0] ^ swap)
        level -= 1
    for i in range(1, len(axes)):                          # Gray code
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << np.uint64(1)) | (((a ^ turn) >> np.uint64(level)) & np.uint64(1))
    return key


def hilbert_order(part: np.ndarray) -> np.ndarray:
    """Rows in the order of the curve through their bounding box (the first 64 axes, if there are more)."""
    used = part[:, :64]
    bits = max(1, min(16, 64 // used.shape[1]))
    low, high = used.min(axis=0), used.max(axis=0)
    cells = (used - low) * ((1 << bits) - 1) // np.maximum(high - low, 1)
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks x entries): whether the entry can be nearest to a point of the box."""
    least, most = np.zeros((2, len(low), len(book)), np.int64)
    for j in range(book.shape[1]):
        below, above = low[:, j, None] - book[None, :, j], book[None, :, j] - high[:, j, None]
        least += np.maximum(np.maximum(below, above), 0) ** 2
        most += np.maximum(np.abs(below), np.abs(above)) ** 2
    return least <= most.min(axis=1)[:, None]


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries)."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * rows.shape[1] < EXACT:
        a, b = rows.astype(float), book.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(rows), len(book)), np.int64)
    for j in range(rows.shape[1]):
        out += (rows[:, j, None] - book[None, :, j]) ** 2
    return out


def assign(rows: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry of every row, whether its block had a single candidate); ties go to the lower entry."""
    near = shortlists(low, high, book)
    code, sure = np.zeros(len(rows), np.int64), near.sum(axis=1) == 1
    single = near.argmax(axis=1)
    for b in range(len(low)):
        span = slice(b * BLOCK, (b + 1) * BLOCK)
        if sure[b]:
            code[span] = single[b]
        else:
            short = np.flatnonzero(near[b])
            code[span] = short[distances(rows[span], book[short]).argmin(axis=1)]
    return code, sure


# ------------------------------------------------------------------ flat blocks

FLAT = ("order", "rows", "low", "high", "sums")


def _whole(x: np.ndarray) -> np.ndarray:
    z = np.floor(x * SCALE)
    if (np.abs(z) > LARGEST).any():
        raise ValueError(f"components beyond {LARGEST / SCALE:.0f} cannot be coded in 64 bits")
    return z.astype(np.int64)


def _flat(part: np.ndarray) -> dict[str, bytes]:
    order = hilbert_order(part)
    rows = part[order]
    at = np.arange(0, len(rows), BLOCK)
    return {"order": order.astype("<u4").tobytes(), "rows": rows.astype("<i4").tobytes(),
            "low": np.minimum.reduceat(rows, at).astype("<i4").tobytes(),
            "high": np.maximum.reduceat(rows, at).astype("<i4").tobytes(),
            "sums": np.add.reduceat(rows, at).astype("<i8").tobytes()}


def _unflat(flat: dict, width: int) -> dict[str, np.ndarray]:
    kinds = {"order": "<u4", "rows": "<i4", "low": "<i4", "high": "<i4", "sums": "<i8"}
    out = {k: np.frombuffer(flat[k], kind).astype(np.int64) for k, kind in kinds.items()}
    return {k: v if k == "order" else v.reshape(-1, width) for k, v in out.items()}


def _packer(dims: int):
    most = max(BLOCK, CHUNK_BYTES // (8 * dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            for a in range(0, len(whole), most):
                t = whole.slice(a, most)
                z = _whole(matrix(t.column("vec"), dims)).reshape(len(t), PARTS, dims // PARTS)
                flats = [_flat(z[:, k]) for k in range(PARTS)]
                one = pa.array([0, len(t)], pa.int32())
                lists = [pa.ListArray.from_arrays(one, t.column(c).combine_chunks()) for c in ("vec_id", "label")]
                kind = pa.list_(pa.struct([(c, pa.binary()) for c in FLAT]))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([flats], kind)], ["ids", "labels", "flats"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()
    return run


def flat_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """One row per chunk of (vec_id, label, vec): ids, labels and the sorted blocks of each part position."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    flat = ", ".join(f"{c}: binary" for c in FLAT)
    return materialise(rows.mapInArrow(_packer(dims), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, "
                                                      f"flats array<struct<{flat}>>"), "flat_blocks")


# ------------------------------------------------------------------ rounds

def _gains(books: list[np.ndarray]):
    """Per task, (slot, value): component sums and counts that the entries gained."""
    m, width = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, m, width + 1), np.int64)
        for b in batches:
            for flats in b.column("flats").to_pylist():
                for k, f in enumerate(flats):
                    f = _unflat(f, width)
                    code, sure = assign(f["rows"], f["low"], f["high"], books[k])
                    total[k, :, width] += np.bincount(code, minlength=m)
                    np.add.at(total[k, :, :width], code[::BLOCK][sure], f["sums"][sure])
                    open_rows = ~np.repeat(sure, BLOCK)[:len(code)]
                    order = np.argsort(code[open_rows], kind="stable")
                    c = code[open_rows][order]
                    if len(c):
                        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                        total[k, c[at], :width] += np.add.reduceat(f["rows"][open_rows][order], at)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total.ravel()[slot], pa.int64())],
                                         ["slot", "value"])
    return run


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    m, width = books[0].shape
    gained = (blocks.select("flats").mapInArrow(_gains(books), "slot int, value long")
                    .groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
    total = [0] * (PARTS * m * (width + 1))
    for r in gained.collect():                             # at most one row per component of the codebooks
        total[r["slot"]] = int(r["value"])
    out = []
    for k in range(PARTS):
        book = books[k].copy()
        for i in range(m):
            at = (k * m + i) * (width + 1)
            if n := total[at + width]:
                book[i] = [s // n for s in total[at:at + width]]
        out.append(book)
    return out


def _coder(books: list[np.ndarray]):
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, flats in enumerate(b.column("flats").to_pylist()):
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, f in enumerate(flats):
                    f = _unflat(f, width)
                    code, _ = assign(f["rows"], f["low"], f["high"], books[k])
                    codes[f["order"], k] = code
                    error[f["order"]] += ((f["rows"] - books[k][code]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[a:a + 2 * PARTS] for a in range(0, len(text), 2 * PARTS)], pa.string()),
                     pa.array(error)], ["vec_id", "label", "code", "error"])
    return run


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", label: str = "label",
             rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256, label."""
    spark = vectors.sparkSession
    kept = vectors.select(vectors[id_col].alias("vec_id"), vectors[label].alias("label"), vectors[vec].alias("vec"))
    kept = kept.where(finite(F.col("vec")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return kept.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256",
                               "label")
    dims = len(first[0].vec)
    if dims == 0 or dims % PARTS or any(len(r.vec) != dims for r in first):
        raise ValueError(f"vectors need one length that is a multiple of {PARTS}")
    start = _whole(np.array([r.vec for r in first], float)).reshape(len(first), PARTS, dims // PARTS)
    books = [start[:, k].copy() for k in range(PARTS)]
    blocks = flat_blocks(kept, dims)
    for _ in range(rounds):
        books = moved(blocks, books)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = materialise(blocks.mapInArrow(_coder(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
                                                         f"code string, error long"), "codes")
    sums, n = store(coded.groupBy("label").agg(F.sum("error").alias("label_error"))
                         .withColumnRenamed("label", "of"), "label_errors")
    joined = coded.join(F.broadcast(sums) if n <= BROADCAST_ROWS else sums, coded.label.eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error",
                         F.lit(books_sha256(books)).alias("codebooks_sha256"), "label")
