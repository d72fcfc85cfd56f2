"""Removal of byte strings that repeat across documents, by threshold-bounded interval expansion.

Every byte covered by a string of ``size`` bytes that also starts in a document with a smaller id goes.

1. *Deal.* Tasks cut each text's windows of ``size`` bytes into runs that share their smallest seed
   hash (``substrings.window_runs``); equal windows get equal seeds wherever they stand. A run travels
   as hashes and places, about 15 bytes, to the bucket of its seed. Of equal runs a task sends only the smallest
   document's, so a passage in a third of all documents is a row per task.
2. *Compare runs.* A bucket settles equal runs (the larger ids lose all of the run). Seeds with several
   different runs stay open: only those bytes, a small part of the corpus, are fetched.
3. *Expand.* The open runs of a bucket are joined into one text. Breadth-first backward extension on its
   Burrows-Wheeler transform finds the borders between suffixes by increasing common prefix and stops at
   ``size``: rows without a border between them start with the same ``size`` bytes, and all but the smallest id
   among them lose that window. Seeds with more than ``HOT_RUNS`` different runs are dealt again by a
   second seed, so that they share the work of many buckets.
4. *Cut.* The windows of a document are gathered, merged into spans and removed.

Comparison of runs trusts 80 bits of hashes besides the bucket; everything open is compared byte by byte. All
shuffles carry packed arrays of bounded size; nothing is collected.

Defined cases: a null text is empty; texts shorter than ``size`` lose nothing. Strings are judged on the
input. A document is known by its id and a 64-bit hash of its text. Documents with equal ids never remove from one
another, and rows equal in id and text have the same result; a null id counts as larger than any other. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import text_of
from tallyloom.llm.substrings import mix, repeated_windows, window_runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 50
BUCKET_BYTES = 16 << 20      # of text whose runs meet in one bucket
OPEN_BUCKETS = 4             # buckets of open runs for each bucket of runs
FLUSH_BYTES = 32 << 20       # of text between two sendings of a task
PIECE = 4 << 20              # of text cut at once
EXPAND_BYTES = 768 << 10     # of text expanded at once, a single seed's runs excepted
HOT_RUNS = 20_000
NO_ID = (1 << 63) - 1
PACKED = "bucket int, kind string, data binary"


# ------------------------------------------------------------------ packed rows

def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "i8")


def _keyed(ids: np.ndarray, marks: np.ndarray, **columns: np.ndarray) -> bytes:
    """Columns with their document key, rows of one document in a row, in the smallest whole types."""
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    at = np.flatnonzero(new)
    base = int(ids.min())
    return pickle.dumps((base, _small(ids[at].astype("u8") - np.uint64(base & (1 << 64) - 1)),
                         marks[at].astype("<i8"), _small(np.diff(np.append(at, len(ids)))),
                         {k: (v if v.dtype.itemsize == 1 else _small(v)) for k, v in columns.items()}), 5)


def _unkeyed(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {}
    for b in blobs:
        base, ids, marks, counts, columns = pickle.loads(b)
        for k, v in {"id": np.repeat(ids.astype(np.int64) + base, counts), "mark": np.repeat(marks, counts),
                     **columns}.items():
            parts.setdefault(k, []).append(v if v.ndim > 1 else v.astype(np.int64))
    return {k: np.concatenate(v) for k, v in parts.items()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()),
                                       pa.array(cols[2], pa.binary())], ["bucket", "kind", "data"])


def _home(ids: np.ndarray, marks: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + marks.astype(np.uint64))
            % np.uint64(parts)).astype(np.int64)


def _send(kind: str, to: np.ndarray, ids: np.ndarray, marks: np.ndarray, **columns: np.ndarray) -> list[tuple]:
    """One packed row per destination."""
    if not len(to):
        return []
    order = np.lexsort((marks, ids, to))
    cut = np.flatnonzero(np.diff(to[order])) + 1
    return [(int(to[part[0]]), kind, _keyed(ids[part], marks[part], **{k: v[part] for k, v in columns.items()}))
            for part in np.split(order, cut)]


def _settle(seed, run, ids, marks, first, count, parts):
    """Equal runs: (packed decisions, order, mask of the smallest documents' first places in that order).

    A decision names windows of a document: ``like`` < 0 removes them, else they fare as those at ``like - 1``.
    """
    order = np.lexsort((first, marks, ids, run, seed))
    seed, run, ids, marks, first, count = (a[order] for a in (seed, run, ids, marks, first, count))
    new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (run[1:] != run[:-1])])
    group = np.cumsum(new) - 1
    least = ids[new][group]
    fresh = new | np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    lost, again = ids > least, (ids == least) & ~fresh
    said = lost | again
    like = np.where(again, first[lead] + 1, 0)
    out = _send("windows", _home(ids[said], marks[said], parts), ids[said], marks[said],
                first=first[said], count=count[said], like=like[said])
    return out, order, ~said


# ------------------------------------------------------------------ tasks

def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for i, m, t in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("text")):
        yield i, m, (t.as_py() or "").encode("utf-8", "surrogatepass")


def _dealer(size: int, parts: int):
    def flush(ids, marks, made):
        seed, run, text, first, count = (np.concatenate(x) for x in zip(*made))
        ids, marks = np.array(ids, np.int64)[text], np.array(marks, np.int64)[text]
        out, order, stay = _settle(seed, run, ids, marks, first, count, parts)
        k = order[stay]
        run6 = np.ascontiguousarray(run[k]).view("u1").reshape(-1, 8)[:, :6]
        to = (seed[k] % np.uint64(parts)).astype(np.int64)
        rest = (seed[k] // np.uint64(parts)).astype("u4")
        return out + _send("runs", to, ids[k], marks[k], seed=rest.astype(np.int64), run=run6,
                           first=first[k], count=count[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, made, size_now = [], [], [], 0
        block: list[tuple[int, int, bytes]] = []         # text index, first byte, bytes
        held = 0

        def cut():
            lengths = np.array([len(x) for _, _, x in block], np.int64)
            starts = np.cumsum(lengths) - lengths
            seed, content, at, first, count = window_runs(b"".join(x for _, _, x in block), starts, lengths, size)
            index = np.array([i for i, _, _ in block], np.int64)
            offset = np.array([o for _, o, _ in block], np.int64)
            made.append((seed, content, index[at], first + offset[at], count))
            block.clear()

        for b in batches:
            for i, m, data in _texts(b):
                if len(data) < size:
                    continue
                ids.append(NO_ID if i is None else i)
                marks.append(m)
                for a in range(0, len(data) - size + 1, PIECE):
                    piece = data[a:a + PIECE + size - 1]
                    block.append((len(ids) - 1, a, piece))
                    held += len(piece)
                    size_now += len(piece)
                    if held >= PIECE:
                        cut()
                        held = 0
                    if size_now >= FLUSH_BYTES and not block:
                        yield _rows(flush(ids, marks, made))
                        keep = a + PIECE < len(data) - size + 1
                        ids, marks, made, size_now = ids[-1:] * keep, marks[-1:] * keep, [], 0
        if block:
            cut()
        if made:
            yield _rows(flush(ids, marks, made))
    return run


def _comparer(parts: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rows = [(b, k, d) for b, k, d in zip(table.column("bucket").to_pylist(), kinds, data) if k == "windows"]
        blobs = [d for k, d in zip(kinds, data) if k == "runs"]
        if blobs:
            a = _unkeyed(blobs)
            wide = np.zeros((len(a["run"]), 8), "u1")
            wide[:, :6] = a["run"]
            run_hash = wide.view("<u8").ravel()
            more, order, stay = _settle(a["seed"], run_hash, a["id"], a["mark"], a["first"], a["count"], parts)
            rows += more
            k = order[stay]
            seed, run_hash, ids = a["seed"][k], run_hash[k], a["id"][k]
            new = np.concatenate([[True], seed[1:] != seed[:-1]])
            other = new | np.concatenate([[True], run_hash[1:] != run_hash[:-1]])
            at = np.flatnonzero(new)
            runs = np.add.reduceat(other.astype(np.int64), at)
            mixed = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            group = np.cumsum(new) - 1
            ask = ((runs > 1) & mixed)[group]
            hot = (runs > HOT_RUNS)[group][ask].astype(np.int64)
            k, bucket = k[ask], table.column("bucket")[0].as_py()
            full = a["seed"][k] * parts + bucket
            rows += _send("ask", _home(a["id"][k], a["mark"][k], parts), a["id"][k], a["mark"][k],
                          seed=full, first=a["first"][k], count=a["count"][k], hot=hot)
        return pa.Table.from_batches([_rows(rows)])
    return run


def _per_document(table: pa.Table) -> pa.Table:
    """Requests of a bucket as one row per document."""
    a = _unkeyed(table.column("data").to_pylist())
    order = np.lexsort((a["first"], a["mark"], a["id"]))
    a = {k: v[order] for k, v in a.items()}
    new = np.concatenate([[True], (a["id"][1:] != a["id"][:-1]) | (a["mark"][1:] != a["mark"][:-1])])
    at = np.append(np.flatnonzero(new), len(new))
    blobs = [pickle.dumps(tuple(_small(a[c][s:e]) for c in ("seed", "first", "count", "hot")), 5)
             for s, e in zip(at[:-1], at[1:])]
    return pa.table({"_id": pa.array(a["id"][at[:-1]], pa.int64()), "_mark": pa.array(a["mark"][at[:-1]], pa.int64()),
                     "asked": pa.array(blobs, pa.binary())})


def _fetcher(size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, seeds, firsts, contents, held = [], [], [], [], [], 0

        def flush():
            to, order = np.array(seeds, np.uint64) % np.uint64(parts), np.arange(len(seeds))
            order = np.argsort(to, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                rows.append((int(to[part[0]]), "open", pickle.dumps(
                    ([ids[i] for i in part], [marks[i] for i in part], np.array([seeds[i] for i in part], np.uint64),
                     [firsts[i] for i in part], [len(contents[i]) for i in part],
                     b"".join(contents[i] for i in part)), 5)))
            return _rows(rows)

        for b in batches:
            for (i, m, data), asked in zip(_texts(b), b.column("asked").to_pylist()):
                for seed, first, count, hot in zip(*[x.tolist() for x in pickle.loads(asked)]):
                    content = data[first:first + count + size - 1]
                    parts_of = [(seed, first, content)]
                    if hot:     # deal the run's windows again, by the seed under another order
                        s2, _, _, f2, c2 = window_runs(content, np.zeros(1, np.int64),
                                                       np.array([len(content)], np.int64), size, salt=seed % 65521 + 1)
                        parts_of = [(int(x) ^ seed & (1 << 64) - 1, first + f, content[f:f + c + size - 1])
                                    for x, f, c in zip(s2.tolist(), f2.tolist(), c2.tolist())]
                    for s, f, c in parts_of:
                        ids.append(i)
                        marks.append(m)
                        seeds.append(s)
                        firsts.append(f)
                        contents.append(c)
                        held += len(c)
                if held >= FLUSH_BYTES // 4:
                    yield flush()
                    ids, marks, seeds, firsts, contents, held = [], [], [], [], [], 0
        if ids:
            yield flush()
    return run


def _expander(size: int, parts: int):
    def expand(ids, marks, firsts, contents):
        """Removed windows of runs that share their seeds; equal contents are expanded once."""
        distinct: dict[bytes, int] = {}
        for c, i in zip(contents, ids):
            distinct[c] = min(distinct.get(c, i), i)
        flags = dict(zip(distinct, repeated_windows(list(distinct), np.array(list(distinct.values()), np.int64), size)))
        out = []
        for i, m, f, c in zip(ids, marks, firsts, contents):
            if i > distinct[c]:
                out.append((i, m, f, len(c) - size + 1))
                continue
            gone = np.flatnonzero(np.diff(np.concatenate([[0], flags[c].view(np.int8), [0]])))
            out += [(i, m, f + int(a), int(e - a)) for a, e in zip(gone[::2], gone[1::2])]
        return out

    def run(table: pa.Table) -> pa.Table:
        ids, marks, seeds, firsts, contents = [], [], [], [], []
        for blob in table.column("data").to_pylist():
            i, m, s, f, lengths, data = pickle.loads(blob)
            ids += i
            marks += m
            seeds += s.tolist()
            firsts += f
            ends = np.cumsum(lengths).tolist()
            contents += [data[e - n:e] for e, n in zip(ends, lengths)]
        order = np.argsort(np.array(seeds, np.uint64), kind="stable").tolist()
        found, chunk, held = [], [], 0
        for at, k in enumerate(order):
            chunk.append(k)
            held += len(contents[k])
            if at + 1 == len(order) or held >= EXPAND_BYTES and seeds[order[at + 1]] != seeds[k]:
                found += expand(*[[x[j] for j in chunk] for x in (ids, marks, firsts, contents)])
                chunk, held = [], 0
        rows = []
        if found:
            i, m, f, n = (np.array(x, np.int64) for x in zip(*found))
            rows = _send("windows", _home(i, m, parts), i, m, first=f, count=n, like=np.zeros(len(i), np.int64))
        return pa.Table.from_batches([_rows(rows)])
    return run


def _merger(size: int):
    def spans(first, count, like):
        """Merged byte ranges of a document's removed windows."""
        if like.any():
            flags = np.zeros(int(max((first + count).max(), (like - 1 + count).max())), bool)
            for f, n in zip(first[like == 0], count[like == 0]):
                flags[f:f + n] = True
            for f, n, k in zip(first[like > 0], count[like > 0], like[like > 0]):
                flags[f:f + n] |= flags[k - 1:k - 1 + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            first, count = edge[::2], edge[1::2] - edge[::2]
        if not len(first):
            return None
        order = np.argsort(first, kind="stable")
        first, end = first[order], (first + count + size - 1)[order]
        reach = np.maximum.accumulate(end)
        new = np.concatenate([[True], first[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        return np.stack([first[at], reach[np.append(at[1:], len(first)) - 1]], axis=1)

    def run(table: pa.Table) -> pa.Table:
        a = _unkeyed(table.column("data").to_pylist())
        order = np.lexsort((a["first"], a["mark"], a["id"]))
        a = {k: v[order] for k, v in a.items()}
        new = np.concatenate([[True], (a["id"][1:] != a["id"][:-1]) | (a["mark"][1:] != a["mark"][:-1])])
        at = np.append(np.flatnonzero(new), len(new))
        ids, marks, out = [], [], []
        for s, e in zip(at[:-1], at[1:]):
            found = spans(a["first"][s:e], a["count"][s:e], a["like"][s:e])
            if found is not None:
                ids.append(int(a["id"][s]))
                marks.append(int(a["mark"][s]))
                out.append(found.astype("<i8").tobytes())
        return pa.table({"_id": pa.array(ids, pa.int64()), "_mark": pa.array(marks, pa.int64()),
                         "spans": pa.array(out, pa.binary())})
    return run


def _cutter(kind: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for (_, _, data), packed in zip(_texts(b), b.column("spans").to_pylist()):
                spans = np.frombuffer(packed or b"", "<i8").reshape(-1, 2).tolist()
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(),
                             [{"start": s, "stop": e} for s, e in spans] if with_text else None,
                             left if with_text else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans",
                                              "kept"])
    return run, (f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                 f"spans array<struct<start: long, stop: long>>, kept binary")


# ------------------------------------------------------------------ the job

def repeated_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(_id, _mark, spans) of every document that loses bytes; the mark tells texts of equal ids apart."""
    spark = docs.sparkSession
    rows = _marked(docs, text, id_col)
    total = docs.agg(F.sum(F.octet_length(docs[text]).cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = rows.select("id", "mark", "text").mapInArrow(_dealer(size, parts), PACKED)
    compared = materialise(dealt.groupBy("bucket").applyInArrow(_comparer(parts), PACKED), "compared")
    asked = materialise(compared.where("kind = 'ask'").groupBy("bucket")
                                .applyInArrow(_per_document, "_id long, _mark long, asked binary"), "asked")
    fetched = rows.join(asked, [rows.id == asked["_id"], rows.mark == asked["_mark"]])
    fetched = fetched.select("id", "mark", "text", "asked").mapInArrow(_fetcher(size, parts * OPEN_BUCKETS), PACKED)
    expanded = materialise(fetched.groupBy("bucket").applyInArrow(_expander(size, parts), PACKED), "expanded")
    windows = compared.where("kind = 'windows'").unionByName(expanded)
    return materialise(windows.groupBy("bucket").applyInArrow(_merger(size), "_id long, _mark long, spans binary"),
                       "spans")


def _marked(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    body = text_of(docs[text])
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(body).alias("mark"), body.alias("text"))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SIZE,
                   with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, spans and kept bytes."""
    spans = repeated_spans(docs, text, id_col, size)
    rows = _marked(docs, text, id_col)
    joined = rows.join(spans, [rows.id == spans["_id"], rows.mark == spans["_mark"]], "left")
    run, schema = _cutter(rows.schema["doc_id"].dataType.simpleString(), with_text)
    out = joined.select("doc_id", "id", "mark", "text", "spans").mapInArrow(run, schema)
    return out if with_text else out.drop("spans", "kept")
