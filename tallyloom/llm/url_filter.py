"""URL filters on a sorted digest array.

The list's entries (``host/path``) are kept as files of sorted 64-bit xxhash keys beside the full
strings. Workers memory-map the files and probe all candidate keys of a batch with one vectorised binary search;
a hit counts only when the stored string equals the candidate, so hash collisions cannot decide.

An entry fits its host and all subdomains when the url's path starts with the entry's path. A url
is asked for one candidate per *shape* of the list (number of host labels, length of the path), built
and hashed natively. Entries come as ``rules``, whose longest match decides, and as a plain ``list``
that decides where no rule fits; what neither names gets ``default``.

The index is built by Spark in files of at most ``ENTRIES_PER_FILE`` entries; only one file at a time passes
through the driver into the shared folder, from where every executor (also a late one) fetches it. Memory-mapped
pages are the only memory a larger list takes. Distinct shapes come from the list alone.

Defined cases: a null url or one without ``://`` has an empty host and path and gets ``default``; the host
ends at ``/``, ``?``, ``#``; a port or user name stays part of it. An empty path starts with no rule
path but the empty one. Entries without ``/`` have an empty path. Of equal entries a rule beats a list entry, then block
beats allow. Repeated rows are judged alike, other columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise, new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES_PER_FILE = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def entry_table(spark: SparkSession, rules: dict[str, str], listed: dict[str, str]) -> DataFrame:
    rows = [(k, v, True) for k, v in rules.items()] + [(k, v, False) for k, v in listed.items()]
    return spark.createDataFrame(rows, "entry string, verdict string, is_rule boolean")


class Index:
    """Files of a built list and the shapes its candidates take."""

    def __init__(self, files: list[str], shapes: list[tuple[int, int]]):
        self.files, self.shapes = files, shapes


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of bytes per partition: count, keys, string ends, flags, strings."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    strings = [s.encode() for s in t.column("entry").to_pylist()]
    ends = np.cumsum([len(s) for s in strings]).astype("<i8")
    flags = np.array([2 * r + (v == "block") for r, v in
                      zip(t.column("is_rule").to_pylist(), t.column("verdict").to_pylist())], "u1")
    data = b"".join([np.array([len(strings)], "<i8").tobytes(),
                     t.column("key").to_numpy().astype("<i8").tobytes(), ends.tobytes(), flags.tobytes(), *strings])
    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])


def build_index(entries: DataFrame) -> Index:
    """Deduplicate, hash and sort the entries; put the files where executors can fetch them."""
    spark = entries.sparkSession
    cut = F.instr("entry", "/")
    host = F.when(cut > 0, F.substring("entry", F.lit(1), cut - 1)).otherwise(F.col("entry"))
    path = F.when(cut > 0, F.substring("entry", cut, F.length("entry"))).otherwise(F.lit(""))
    clean = (entries.where(F.length("entry") > 0)
                    .withColumn("entry", F.concat(F.translate(host, UPPER, LOWER), path))
                    .groupBy("entry").agg(F.max(F.struct("is_rule", (F.col("verdict") == "block").alias("blocks"))).alias("m"))
                    .select("entry", F.xxhash64("entry").alias("key"), F.col("m.is_rule").alias("is_rule"),
                            F.when(F.col("m.blocks"), "block").otherwise("allow").alias("verdict")))
    clean = materialise(clean, "url_entries")
    n = clean.count()
    labels = F.size(F.split(F.substring_index("entry", "/", 1), r"\."))
    at = F.instr("entry", "/")
    length = F.when(at > 0, F.length("entry") - at + 1).otherwise(F.lit(0))
    shapes = [(r[0], r[1]) for r in clean.select(labels, length).distinct().collect()]
    packed = (clean.repartitionByRange(max(1, -(-n // ENTRIES_PER_FILE)), "key").sortWithinPartitions("key")
                   .select("key", "entry", "verdict", "is_rule").mapInArrow(_pack, "data binary"))
    files = []
    fs = spark._jvm.org.apache.hadoop.fs
    for row in packed.toLocalIterator():
        target = fs.Path(f"{new_path(spark, 'url_index')}.bin")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(row.data))
        out.close()
        spark.sparkContext.addFile(target.toString())
        files.append(target.getName())
    return Index(files, sorted(shapes))


class _Mapped:
    def __init__(self, path: str):
        n = int(np.memmap(path, "<i8", "r", 0, 1)[0])
        self.keys = np.memmap(path, "<i8", "r", 8, n)
        self.ends = np.memmap(path, "<i8", "r", 8 + 8 * n, n)
        self.flags = np.memmap(path, "u1", "r", 8 + 16 * n, n)
        self.blob = np.memmap(path, "u1", "r", 8 + 17 * n)

    def entry(self, i: int) -> bytes:
        return self.blob[self.ends[i - 1] if i else 0:self.ends[i]].tobytes()


def probe(files: list, keys: np.ndarray, strings: pa.Array) -> list[tuple[int, int, bytes]]:
    """(candidate, flags, entry) of every confirmed hit."""
    hits = []
    for f in files:
        at = np.searchsorted(f.keys, keys)
        alive = np.flatnonzero(at < len(f.keys))
        while len(alive):
            alive = alive[f.keys[at[alive]] == keys[alive]]
            missed = []
            for c in alive:
                text = f.entry(at[c])
                if text == strings[c].as_py().encode():
                    hits.append((int(c), int(f.flags[at[c]]), text))
                else:
                    missed.append(c)
            alive = np.array(missed, dtype=int)
            at[alive] += 1
            alive = alive[at[alive] < len(f.keys)]
    return hits


def _prober(names: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [_Mapped(SparkFiles.get(n)) for n in names]
        for b in batches:
            lists = b.column("keys")
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            row = np.repeat(np.arange(b.num_rows), sizes)
            hits = probe(files, np.asarray(lists.flatten()), b.column("candidates").flatten())
            best: dict[int, tuple] = {}
            for c, flags, entry in hits:
                rank = (flags >= 2, len(entry.decode()), entry.find(b"/"), flags, entry)
                best[row[c]] = max(best.get(row[c], rank), rank)
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            for r, (is_rule, _, _, flags, entry) in best.items():
                verdict[r] = "block" if flags & 1 else "allow"
                rule[r] = entry.decode() if is_rule else None
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])
    return run


def judge_urls(pages: DataFrame, index: Index, id_col: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """Per row: the id, host, path, rule (null where none fits) and verdict. Map-only."""
    host, path = url_parts(pages[url])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"),
                        F.split(host, r"\.", -1).alias("labels"))
    if not index.shapes:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    shapes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in index.shapes])
    fits = F.filter(shapes, lambda s: (s["n"] <= F.size("labels")) & (s["m"] <= F.length("path")))
    make = F.transform(fits, lambda s: F.concat(
        F.array_join(F.slice("labels", F.size("labels") - s["n"] + 1, s["n"]), "."),
        F.substring(F.col("path"), F.lit(1), s["m"])))
    rows = rows.withColumn("candidates", make)
    rows = rows.select("id", "host", "path", "candidates",
                       F.transform("candidates", lambda c: F.xxhash64(c)).alias("keys"))
    kind = rows.schema["id"].dataType.simpleString()
    judged = rows.mapInArrow(_prober(index.files, default),
                             f"id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)
