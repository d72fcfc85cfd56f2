"""Packing by cutting-stock column generation.

1. Documents are tokenised once, in tasks, and cut: whole sequences first, then one remainder. Each piece
   gets a size class: its length up to ``FINE`` tokens, beyond that its length rounded up to ``GRAIN`` tokens.
2. The histogram of classes, at most FINE + capacity / GRAIN numbers, is all the driver sees. A linear program over
   patterns (how many pieces of each class share a sequence) is solved by column generation: a knapsack
   dynamic program prices new patterns with the current duals until none improves; the first patterns are
   filled with the largest classes left, which is near the optimum. Patterns are rounded down; what is left over is packed by filling one pattern at a time with the largest classes.
3. Pieces are ranked inside their class (sliced ranks, no class in one task); every pattern owns a
   stretch of ranks of each class, so the rank names the sequence without any pairing of rows. Offsets
   are running sums inside one sequence (at most ``capacity`` pieces).

Tokens of a text are those of the tokenizer file. Words between single spaces are
looked up in a bounded cache; missing ones are encoded together with the same vocabulary's ranks.
Texts with doubled white space or a special token's string take the plain way, so ids never differ.

Defined cases: a null text is empty and has the closing id alone. Rows with equal ids are packed one by
one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.llm.common import id_text, sliced_rank, trim

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
GRAIN = 8
FINE = 64           # lengths up to here are classes of their own
CLOSING = 0
CACHE_WORDS = 300_000
BLOCK_BYTES = 2 << 20
MAX_ROUNDS = 200_000    # beyond it the patterns found so far are used: valid, perhaps not the best
SPECIAL = ("<|endoftext|>",)   # fixed value: strings of the tokenizer's special tokens
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
# white space that is doubled or neither blank nor line feed, and the mark of a text's beginning
ODD = (r"[ \n][ \n]|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
       r"|\x00")


# ------------------------------------------------------------------ tokens

class WordTokenizer:
    """Ids of the byte-level tokenizer, as bytes of little-endian unsigned 32-bit numbers.

    Its pre-tokenizer never joins across a single white-space character between two others: a blank belongs
    to what follows, a line feed stands alone. Hence a text is cut there, a batch's distinct words
    are looked up or encoded once, and Arrow puts the ids of all words in their places. ``\\0`` marks
    a text's beginning, whose first word has no blank.
    """

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        self.place = lambda name: os.path.join(folder, name) if folder else public_tokenizers.path(name)
        with open(self.place(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.odd = "|".join([ODD, *[re.escape(t) for t in SPECIAL]])
        self.line = self.words.encode_ordinary("\n")[0]
        self.cache: dict[str, bytes] = {}

    @functools.cached_property
    def whole(self):
        """The tokenizer file itself, read only for texts with a special token's string."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.place(VOCABULARY))

    def _ids(self, text: str) -> bytes:
        return np.array(self.words.encode_ordinary(text), "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        if any(t in text for t in SPECIAL):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._ids(text)

    def _learn(self, words: list[str]) -> None:
        """Encode new words together, a line feed before each; a blank follows it unless it is the word's own."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        first = [w for w in words if w[:1] == "\0"]
        self.cache.update({w: self._ids(w[1:]) for w in first})
        self.cache.update({"": self._ids(" "), "\n": self._ids("\n")})
        rest = [w for w in words if w not in self.cache]
        if not rest:
            return
        ids = np.array(self.words.encode_ordinary("".join([w if w[0] == "\n" else "\n " + w for w in rest])), "<u4")
        cut = 4 * np.flatnonzero(ids == self.line)
        if len(cut) != len(rest):
            raise ValueError("words cannot be told apart")
        data, skip = ids.tobytes(), [0 if w[0] == "\n" else 4 for w in rest]
        ends = np.append(cut[1:], 4 * len(ids)).tolist()
        self.cache.update(zip(rest, [data[a + k:e] for a, k, e in zip(cut.tolist(), skip, ends)]))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        usual = pc.if_else(pa.array(odd), "", texts)
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(usual, "\n", " \n"),
                                             pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.cache]
        known = [self.cache.get(w) for w in words] if new else None
        if new:
            self._learn(new)
            known = [self.cache[w] if k is None else k for w, k in zip(words, known)]
        else:
            known = [self.cache[w] for w in words]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        data = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] else b""
        out = [data[a:e] for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
        for i in np.flatnonzero(odd):
            out[i] = self.plain(texts[int(i)].as_py())
        return out


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BLOCK_BYTES of text; a longer text is a block of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)).astype("i8")
    block = np.cumsum(size) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
    for a, e in zip(edges, edges[1:]):
        if e > a:
            yield b.slice(a, e - a)


def _piecer(capacity: int, with_ids: bool, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(folder)
        closing = np.array([CLOSING], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        for b in (block for whole in batches for block in _blocks(whole)):
            rows = []
            for doc, data in zip(b.column("doc_id").to_pylist(), tokenizer.encode(b.column("text"))):
                data += closing
                n = len(data) // 4
                for a in range(0, n, capacity):
                    part = data[4 * a:4 * (a + capacity)]
                    rows.append((doc, a, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            kinds = [b.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        del tokenizer
        trim()
    return run


def token_pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
                 with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids) of every piece."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_piecer(capacity, with_ids, folder), f"doc_id {kind}, start long, length long, ids_crc32 long, "
                                                               f"doc_tokens long, ids binary")
    return out if with_ids else out.drop("ids")


# ------------------------------------------------------------------ patterns

def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the used capacity.

    A class is added as 1, 2, 4, ... copies, which together allow any number of them.
    """
    best, trial = np.zeros(capacity + 1), np.empty(capacity + 1)
    for s, v in zip(size.tolist(), value.tolist()):
        while v > 0 and s <= capacity:
            np.add(best[:-s], v, out=trial[s:])
            np.maximum(best[s:], trial[s:], out=best[s:])
            s, v = 2 * s, 2 * v
    pattern, room = np.zeros(len(size), int), capacity
    while best[room] > 0:
        fits = np.flatnonzero((size <= room) & (value > 0))
        worth = best[room - size[fits]] + value[fits]
        k = int(worth.argmax())
        if worth[k] < best[room] - 1e-12:      # nothing ends here
            room -= 1
            continue
        pattern[fits[k]] += 1
        room -= int(size[fits[k]])
    return float(best[capacity]), pattern


def first_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used): filled with the largest classes left until one of them runs out.

    A class that has run out is in no later pattern, so the columns are independent.
    """
    m = len(size)
    basis, amount, left, open_ = np.zeros((m, m)), np.zeros(m), demand.astype(float), np.ones(m, bool)
    for _ in range(m):
        pattern, room = np.zeros(m), capacity
        for k in np.flatnonzero(open_)[::-1]:
            pattern[k] = room // size[k]
            room -= int(pattern[k]) * int(size[k])
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        out = int(used[times.argmin()])
        basis[:, out], amount[out] = pattern, times.min()
        left = np.maximum(left - times.min() * pattern, 0.0)
        open_[out] = False
    return basis, amount


def fractional_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used, dual price of a piece of each class), optimal among
    all patterns once no pattern is worth more than 1 at the prices. ``size`` ascends."""
    basis, amount = first_patterns(size, demand, capacity)
    inverse = np.linalg.inv(basis)
    for _ in range(MAX_ROUNDS):
        worth, pattern = best_pattern(np.maximum(inverse.sum(axis=0), 0.0), size, capacity)
        if worth <= 1.0 + 1e-9:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount -= ratio[out] * move
        amount[out] = ratio[out]
        amount = np.maximum(amount, 0.0)
        basis[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    return basis, amount, inverse.sum(axis=0)


def solve_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that together hold exactly ``demand`` pieces of each class."""
    m = len(size)
    if m == 0:
        return []
    basis, amount, _ = fractional_patterns(size, demand, capacity)
    left = demand.astype(int).copy()
    plan = []
    for j in np.argsort(-amount, kind="stable"):
        pattern = basis[:, j].astype(int)
        used = pattern > 0
        times = min(int(amount[j] + 1e-9), int((left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((times, pattern))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros(m, int), capacity
        for k in np.argsort(-size, kind="stable"):
            take = min(int(left[k]), int(room // size[k]))
            pattern[k] += take
            room -= take * size[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((times, pattern))
        left -= times * pattern
    return plan


def _stretches(plan: list[tuple[int, np.ndarray]], size: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence) of every pattern's class."""
    rows, rank, sequence = [], np.zeros(len(size), int), 0
    for times, pattern in plan:
        for k in np.flatnonzero(pattern):
            n = times * int(pattern[k])
            rows.append((int(size[k]), int(rank[k]), int(rank[k]) + n, int(pattern[k]), sequence))
            rank[k] += n
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, fine: int = FINE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (doc_id, start, length, ids_crc32, ...)."""
    spark: SparkSession = pieces.sparkSession
    rounded = F.least(F.ceil(F.col("length") / grain) * grain, F.lit(capacity))
    sized = pieces.withColumn("class", F.when(F.col("length") <= fine, F.col("length")).otherwise(rounded).cast("int"))
    histogram = {r["class"]: r["n"] for r in sized.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = np.array(sorted(histogram), int)
    plan = solve_patterns(size, np.array([histogram[s] for s in size], float), capacity)
    rows = _stretches(plan, size)
    stretches = spark.createDataFrame(rows, "of int, first long, stop long, each long, base long")
    digest = F.md5(F.concat_ws(":", id_text(F.col("doc_id")), F.col("start").cast("string"), F.col("ids_crc32").cast("string")))
    ranked = sliced_rank(sized.withColumn("digest", digest), ["class"], "digest",
                         ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")
    # one row per class and pattern: at most the square of the number of classes
    placed = ranked.join(F.broadcast(stretches), (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("stop")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - first) div each"))
    order = (Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank")
                   .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
                  .select(*pieces.columns, "sequence_id", "offset"))


def packed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
                     with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(materialise(token_pieces(docs, text, id_col, capacity, with_ids, folder), "pieces"), capacity)
