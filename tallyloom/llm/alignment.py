"""Alignment of two tokenizers over the same texts, and corpus-wide counts of linked token ids.

1. *Tokens.* A blank plus the text is cut where both tokenizers always cut: before a single blank or line feed
   between two characters that are no white space. A block of about ``BLOCK_BYTES`` of text looks its distinct
   words up in a bounded cache of both tokenizers' ids. Texts longer than ``PIECE`` characters go through in pieces.
2. *Galloping intersection.* The ends of the block's tokens, as byte offsets, are two sorted lists. The shorter one
   drives: each of its ends gallops from its predecessor's place in the longer list by doubling steps and
   closes in by binary search. Many stretches of the shorter list gallop side by side in numpy. Common ends slice the
   tokens into groups; the difference of ranks is the range of tokens of the longer list that a
   token of the shorter one overlaps.
3. *Counts.* A block names each linked id pair once with its number of documents; Spark adds them up, and sends
   each block the counts of its pairs. A pair in every document is hence a row per block, not per document.

Defined cases: texts that are null, empty, or whose tokens' bytes differ from a blank plus the text (as those with
the piece tokenizer's own blank sign) have no tokens: zeros and an empty digest. Every row is a
document, repeated rows count repeatedly. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTE_RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
PIECE = 1 << 20            # characters of one text handled at once
CACHE_WORDS = 300_000
LONG_WORD = 200            # characters beyond which a word is not kept
TOGETHER = 4096            # new words encoded in one text
LANE = 64                  # ends that gallop one after the other
SHIFT = 32                 # a pair is (first id << SHIFT) | second id
BLANK = "▁"           # fixed value: the piece tokenizer's sign for a blank
# white space that is doubled, or neither blank nor line feed
ODD = (r"[ \n][ \n]|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
INSIDE = re.compile(r"\s")
BLANK_CUT = re.compile(r"(?<=\S)(?= \S)")


# ------------------------------------------------------------------ tokens

class WordPairs:
    """Ids of both tokenizers for words (a blank or line feed and what follows up to the next one)."""

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import sentencepiece
        import tiktoken

        place = lambda name: os.path.join(folder, name) if folder else public_tokenizers.path(name)
        with open(place(BYTE_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_ = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=place(PIECES))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            p = self.pieces.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else p.replace(BLANK, " ").encode())
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes))
        self.a_line, self.b_line = ranks[b"\n"], self.pieces.piece_to_id("<0x0A>")
        self.cache: dict[str, tuple[bytes, bytes, bool]] = {}

    def encode(self, word: str) -> tuple[bytes, bytes, bool]:
        """(first ids, second ids, whether both sets of bytes are the word's). A line feed before the word stands alone
        in every piece, so the word is encoded behind one, without a blank of its own."""
        a, b = self.bytes_.encode_ordinary(word), self.pieces.encode("\n" + word)[2:]
        raw = word.encode("utf-8", "surrogatepass")
        right = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes(), right

    def _together(self, words: list[str]) -> list[tuple[bytes, bytes, bool]] | None:
        """``encode`` of words without white space inside, all in one text, a line feed before each; None if a
        tokenizer changes their bytes."""
        text = "".join([w if w[0] == "\n" else "\n" + w for w in words])
        raw, out = text.encode("utf-8", "surrogatepass"), []
        for ids, names, line in ((self.bytes_.encode_ordinary(text), self.a_names, self.a_line),
                                 (self.pieces.encode(text)[1:], self.b_names, self.b_line)):
            ids = np.array(ids, "<u4")
            cut = np.flatnonzero(ids == line)
            if len(cut) != len(words) or names.take(pa.array(ids)).buffers()[2].to_pybytes()[:len(raw) + 1] != raw:
                return None
            data, skip = ids.tobytes(), [0 if w[0] == "\n" else 4 for w in words]
            out.append([data[4 * a + k:4 * e] for a, k, e in zip(cut.tolist(), skip, [*cut[1:].tolist(), len(ids)])])
        return [(x, y, True) for x, y in zip(*out)]

    def look_up(self, words: list[str]) -> list[tuple[bytes, bytes, bool]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found = {w: self.cache[w] for w in words if w in self.cache}
        new = [w for w in words if w not in found]
        plain = [w for w in new if len(w) > 1 and not INSIDE.search(w, 1)]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at:at + TOGETHER]
            if (got := self._together(some)) is not None:
                found.update(zip(some, got))
        for w in new:
            if w not in found:
                found[w] = self.encode(w)
        self.cache.update((w, found[w]) for w in new if len(w) <= LONG_WORD)
        return [found[w] for w in words]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, place of each text's first word and the end) of a blank plus each text, none for empty ones."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    odd = np.asarray(pc.match_substring_regex(spaced, ODD)) | (np.asarray(pc.binary_length(texts)) == 0)
    usual = pc.if_else(pa.array(odd), "", texts)
    lists = pc.split_pattern(pc.replace_substring(usual, "\n", " \n"), " ")
    words = lists.flatten()
    words = pc.if_else(pc.starts_with(words, "\n"), words,
                       pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string())))
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    if not odd.any():
        return words, at
    parts, counts, last = [], np.diff(at), 0
    for i in np.flatnonzero(odd):                           # split one by one, in place of the empty text's word
        parts.append(words.slice(last, at[i] - last))
        own = CUT.split(" " + texts[int(i)].as_py()) if len(texts[int(i)].as_py()) else []
        parts.append(pa.array(own, pa.large_string()))
        counts[i], last = len(own), at[i + 1]
    parts.append(words.slice(last))
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(counts)])


# ------------------------------------------------------------------ galloping intersection

def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each end of the shorter list, the number of smaller ends in the longer one.

    Stretches of ``LANE`` ends run side by side. A stretch starts at the place of its first end; every further end
    starts where its predecessor stopped, doubles its step until it has passed, and halves the last step.
    """
    out, n = np.zeros(len(short), np.int64), len(long)
    if not len(short) or not n:
        return out
    heads = np.arange(0, len(short), LANE)
    place = np.searchsorted(long, short[heads])
    for t in range(LANE):
        lane = heads + t
        live = lane < len(short)
        lane, low = lane[live], place[live]
        want = short[lane]
        step = np.ones(len(lane), np.int64)
        going = np.flatnonzero(low < n)
        while len(going):                                   # below + step is still too small: double
            probe = low[going] + step[going] - 1
            small = long[np.minimum(probe, n - 1)] < want[going]
            small &= probe < n
            going = going[small]
            low[going] += step[going]
            step[going] *= 2
        high = np.minimum(low + step - 1, n)                # long[high] is not smaller
        while True:
            wide = np.flatnonzero(low < high)
            if not len(wide):
                break
            middle = (low[wide] + high[wide]) // 2
            small = long[middle] < want[wide]
            low[wide] = np.where(small, middle + 1, low[wide])
            high[wide] = np.where(small, high[wide], middle)
        out[lane] = low
        place = place.copy()
        place[live] = low
    return out


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, second token) of every overlap, and the common ends' places in both lists.

    Both lists end at the same byte.
    """
    swap = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    rank = gallop(short, long)                              # longer tokens that end before this one does
    met = long[rank] == short if len(short) else np.zeros(0, bool)
    begin = np.concatenate([[0], (rank + met)[:-1]]) if len(short) else rank
    width = rank - begin + 1
    one = np.repeat(np.arange(len(short)), width)
    other = np.repeat(begin - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum()) \
        if len(short) else one
    common = (np.flatnonzero(met), rank[met])
    return (other, one, common[1], common[0]) if swap else (one, other, *common)


# ------------------------------------------------------------------ blocks

class _Digits:
    """Decimal ids followed by a separator, looked up for all tokens of a block at once."""

    def __init__(self, n: int):
        self.n = n
        self.text = pa.array([f"{i}{s}" for s in ",|;" for i in range(n)], pa.large_string())

    def joined(self, ids: np.ndarray, separator: np.ndarray) -> tuple[bytes, np.ndarray]:
        out = self.text.take(pa.array(separator * self.n + ids))
        return out.buffers()[2].to_pybytes() if len(out) else b"", np.frombuffer(out.buffers()[1], "<i8", len(out) + 1)


def _aligned(pairs: WordPairs, digits: _Digits, texts: pa.Array) -> dict:
    """Figures of every text of a block: counts, group digits, and its distinct pairs with their number of links."""
    words, at = words_of(texts)
    coded = words.dictionary_encode()
    known = pairs.look_up(coded.dictionary.to_pylist())
    index = np.asarray(coded.indices).astype(np.int64)
    right = np.array([k[2] for k in known], bool)[index] if len(index) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    good = np.ones(len(texts), bool)
    good[owner[~right]] = False
    use = good[owner]
    index, owner = index[use], owner[use]
    ids, ends, begins = [], [], []
    for k, length in ((0, pairs.a_length), (1, pairs.b_length)):
        coded_ids = pa.array([x[k] for x in known], pa.large_binary())
        each = np.diff(np.frombuffer(coded_ids.buffers()[1], "<i8", len(known) + 1)) // 4
        data = coded_ids.take(pa.array(index))
        found = np.frombuffer(data.buffers()[2] or b"", "<u4")[:each[index].sum()].astype(np.int64) if len(index) else \
            np.zeros(0, np.int64)
        ids.append(found)
        ends.append(np.cumsum(length[found]))
        begins.append(np.concatenate([[0], np.cumsum(np.bincount(owner, each[index], len(texts)).astype(np.int64))]))
    (a, b), (a_at, b_at) = ids, begins
    one, other, a_last, b_last = links(*ends)
    # groups: tokens of both sides in the order in which they are written
    group_a = np.searchsorted(a_last, np.arange(len(a)))
    group_b = np.searchsorted(b_last, np.arange(len(b)))
    place_a = np.arange(len(a)) + np.concatenate([[0], b_last + 1])[group_a]
    place_b = np.arange(len(b)) + (a_last + 1)[group_b] if len(b) else group_b
    merged, separator = np.zeros((2, len(a) + len(b)), np.int64)
    merged[place_a], merged[place_b] = a, b
    separator[place_a[a_last]], separator[place_b[b_last]] = 1, 2
    text, edge = digits.joined(merged, separator)
    span = edge[a_at + b_at]
    # distinct pairs of each text
    key = a[one] << SHIFT | b[other]
    doc = np.searchsorted(a_at, one, "right") - 1
    coded = pa.array(key).dictionary_encode()
    names, rank = np.asarray(coded.dictionary), np.zeros(len(coded.dictionary), np.int64)
    order = np.argsort(names)
    names, rank[order] = names[order], np.arange(len(names))
    counted = pc.value_counts(pa.array(doc * np.int64(max(1, len(names))) + rank[np.asarray(coded.indices)]))
    seen, times = (np.asarray(counted.field(i)) for i in (0, 1))
    order = np.argsort(seen)
    seen, times = seen[order], times[order]
    return {"good": good, "n_a": np.diff(a_at), "n_b": np.diff(b_at), "names": names,
            "n_groups": np.bincount(np.searchsorted(a_at, a_last, "right") - 1, minlength=len(texts)),
            "n_links": np.bincount(doc, minlength=len(texts)),
            "digits": [text[s:e] for s, e in zip(span[:-1].tolist(), span[1:].tolist())],
            "doc": seen // max(1, len(names)), "code": seen % max(1, len(names)), "times": times}


class _Long:
    """A text that goes through in pieces."""

    def __init__(self):
        self.good, self.counts, self.digest, self.tail = True, np.zeros(4, np.int64), hashlib.sha256(), b""
        self.pairs: dict[int, int] = {}

    def add(self, x: dict) -> None:
        self.good &= bool(x["good"][0])
        self.counts += [x[k][0] for k in ("n_a", "n_b", "n_groups", "n_links")]
        self.digest.update(self.tail + x["digits"][0][:-1])
        self.tail = x["digits"][0][-1:]                    # the last separator is not written
        for k, n in zip(x["names"][x["code"]].tolist(), x["times"].tolist()):
            self.pairs[k] = self.pairs.get(k, 0) + n


def _pieces(text: str) -> Iterator[str]:
    """Cut at blanks between two other characters, PIECE characters on or soon after; a piece's own blank is left out."""
    a = 0
    while len(text) - a > PIECE and (cut := BLANK_CUT.search(text, a + PIECE)):
        yield text[a:cut.start()]
        a = cut.start() + 1
    yield text[a:]


RESULT = ["n_a", "n_b", "n_groups", "n_links"]


def _blocker(folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pairs = WordPairs(folder)
        digits = _Digits(max(len(pairs.a_bytes), len(pairs.b_bytes)))
        number = TaskContext.get().partitionId() << 33

        def row(ids: pa.Array, counts: np.ndarray, sha: list[str], names, docs, doc, code, times) -> pa.RecordBatch:
            nonlocal number
            number += 1
            one = pa.array([0, len(ids)], pa.int32())
            small = lambda v: v.astype("<u2" if v.max(initial=0) < 1 << 16 else "<u4").tobytes()
            cols = [pa.array([number]), pa.ListArray.from_arrays(one, ids),
                    *[pa.array([c.tolist()], pa.list_(pa.int64())) for c in counts], pa.array([sha]),
                    pa.array([names.tolist()], pa.list_(pa.int64())), pa.array([docs.tolist()], pa.list_(pa.int64())),
                    pa.array([np.bincount(doc, minlength=len(ids)).astype("<u4").tobytes()], pa.binary()),
                    pa.array([small(code)], pa.binary()), pa.array([small(times)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "ids", *RESULT, "sha", "names", "docs", "each", "code", "times"])

        def block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            x = _aligned(pairs, digits, texts)
            sha = [hashlib.sha256(d[:-1]).hexdigest() if d else "" for d in x["digits"]]
            return row(ids, np.array([x[k] for k in RESULT]), sha, x["names"],
                       np.bincount(x["code"], minlength=len(x["names"])), x["doc"], x["code"], x["times"])

        def long(ids: pa.Array, text: str) -> pa.RecordBatch:
            whole = _Long()
            for piece in _pieces(text):
                whole.add(_aligned(pairs, digits, pa.array([piece], pa.large_string())))
            if not whole.good:
                none = np.zeros(0, np.int64)
                return row(ids, np.zeros((4, 1), np.int64), [""], none, none, none, none, none)
            names = np.array(sorted(whole.pairs), np.int64)
            code = np.arange(len(names))
            return row(ids, whole.counts[:, None], [whole.digest.hexdigest()], names, np.ones_like(code), code * 0, code,
                       np.array([whole.pairs[k] for k in names.tolist()], np.int64))

        for b in batches:
            texts = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            size = np.asarray(pc.binary_length(texts)).astype(np.int64)
            big = size > PIECE
            cut = np.cumsum(size) // BLOCK_BYTES
            edge = np.flatnonzero((cut[1:] != cut[:-1]) | big[1:] | big[:-1]) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if e > s:
                    ids = b.column("doc_id").slice(s, e - s)
                    yield long(ids, texts[s].as_py()) if big[s] else block(ids, texts.slice(s, e - s))
    return run


def token_blocks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Stored blocks of documents: results of each, and the block's distinct pairs with their number of documents."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"block long, ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in RESULT)
              + ", sha array<string>, names array<long>, docs array<long>, each binary, code binary, times binary")
    return materialise(rows.mapInArrow(_blocker(folder), schema), "token_blocks")


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair) of every pair of a block, and the stored (pair, n, best): documents that hold it, and whether no other
    pair of its first id is held by more."""
    uses = (blocks.select("block", F.explode(F.arrays_zip("names", "docs")).alias("u"))
                  .select("block", F.col("u.names").alias("pair"), F.col("u.docs").alias("docs")))
    counts = materialise(uses.groupBy("pair").agg(F.sum("docs").alias("n")), "pair_counts")
    # one row per first id: the vocabulary bounds it
    top = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("top"))
    counts = counts.join(F.broadcast(top), F.shiftright("pair", SHIFT) == F.col("a"))
    return uses.drop("docs"), counts.select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _finish(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    names = ["doc_id", *RESULT, "n_best", "count_sum", "groups_sha256"]
    out = []
    for b in blocks.to_batches():
        for i in range(b.num_rows):
            ids = b.column("ids")[i].values
            each = np.frombuffer(b.column("each")[i].as_py(), "<u4").astype(np.int64)
            code, times = (_wide(b.column(c)[i].as_py(), int(each.sum())) for c in ("code", "times"))
            order = np.argsort(np.asarray(counts.column("pair")), kind="stable")     # as the block's names
            n = np.asarray(counts.column("n"))[order][code] * times
            best = np.asarray(counts.column("best"))[order][code] * times
            doc = np.repeat(np.arange(len(ids)), each)
            sums = np.zeros((2, len(ids)), np.int64)
            np.add.at(sums[0], doc, best)
            np.add.at(sums[1], doc, n)
            out.append(pa.RecordBatch.from_arrays(
                [ids, *[b.column(c)[i].values for c in RESULT], pa.array(sums[0]), pa.array(sums[1]), b.column("sha")[i].values],
                names))
    return pa.Table.from_batches(out)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if n and len(data) == 4 * n else "<u2").astype(np.int64)


def align(docs: DataFrame, text: str = "text", id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = token_blocks(docs, text, id_col, folder)
    uses, counts = pair_counts(blocks)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in [*RESULT, "n_best", "count_sum"]) + ", groups_sha256 string"
    told = uses.join(counts, "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    slim = blocks.drop("names", "docs")
    return slim.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_finish, schema)
