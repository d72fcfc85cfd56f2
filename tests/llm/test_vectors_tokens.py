"""Cross-tokenizer alignment, vector codes and approximate neighbours, against brute force."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import alignment, ann, vector_codes
from tallyloom.llm.queries import QUERIES

# ------------------------------------------------------------------ alignment


def byte_of():
    """The byte that each character of a byte-level vocabulary stands for (published rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_of()

    def tokens(text):
        one = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            byte = p.startswith("<0x") and len(p) == 6
            two.append((i, bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode()))
        return one, two
    return tokens


def brute_alignment(rows, tokens):
    found, corpus = [], Counter()
    for doc, text in rows:
        a, b = tokens(text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(x[1] for x in a) != want or b"".join(x[1] for x in b) != want:
            a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        sides = []
        for side in spans:
            parts = [[] for _ in common]
            for i, s, _ in side:
                parts[bisect.bisect_right(common, s)].append(str(i))
            sides.append(parts)
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)]
        linked = Counter()
        j = 0
        for i, s, e in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                linked[i, spans[1][k][0]] += 1
                k += 1
        corpus.update(linked.keys())
        found.append((doc, len(a), len(b), groups, linked))
    best = {}
    for (i, _), n in corpus.items():
        best[i] = max(best.get(i, 0), n)
    return [(doc, na, nb, len(g), sum(linked.values()),
             sum(n for p, n in linked.items() if corpus[p] == best[p[0]]),
             sum(n * corpus[p] for p, n in linked.items()),
             hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for doc, na, nb, g, linked in found]


def odd_texts(n):
    rng = random.Random(5)
    bits = ["the", "Straße", "naïve", "123", "don't", "x", " ", "  ", "\n", "\n\n", "\r\n", "\t", " ", "　", "▁", "日本",
            "😀", "é", "<|endoftext|>", "<0x0A>", "<s>", "<unk>", "\x00", "!!", "…", "\x85", " ", "ab" * 150]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(bits) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(14))))
    return out


def test_gallop_and_links():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (3, 400), (900, 1000), (5000, 40)):
        short, long = np.sort(rng.choice(6000, n, replace=False)), np.sort(rng.choice(6000, m, replace=False))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()
    for _ in range(50):
        ends = [np.sort(np.append(rng.choice(59, rng.integers(1, 40), replace=False), 60)) for _ in range(2)]
        one, two, a_last, b_last = alignment.links(*ends)
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i] and ends[0][i] > starts[0][i]
                and ends[1][j] > starts[1][j]}
        got = [p for p in zip(one.tolist(), two.tolist())
               if ends[0][p[0]] > starts[0][p[0]] and ends[1][p[1]] > starts[1][p[1]]]
        assert len(got) == len(set(got)) and set(got) == want
        assert (ends[0][a_last] == ends[1][b_last]).all() and len(a_last) == len(set(ends[0]) & set(ends[1]))


def test_alignment_equals_brute_force(spark, odd_docs, no_docs, plain_tokens, same):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(odd_texts(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("block", "names", "of", "pair")}).repartition(3)
    same(alignment.align(df).collect(), brute_alignment(rows, plain_tokens))
    assert alignment.align(no_docs).count() == 0


def test_alignment_of_the_table(spark, sf, docs, plain_tokens, same):
    got = QUERIES["op11_galloping_alignment"](spark, sf).collect()
    same(got, brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plain_tokens))


def test_long_texts_go_through_in_pieces(spark, plain_tokens, same, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 50)
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    texts = ["der die das und\nist nicht " * 40, "▁ " + "of a kind " * 20, "x" * 200, "a  b\n\nc " * 30, "short", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    same(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute_alignment(rows, plain_tokens))


# ------------------------------------------------------------------ vector codes

def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    part = lambda z, k: z[k * width:(k + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(z, k) for _, z, _ in first] for k in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            own = {}
            for _, z, _ in kept:
                own.setdefault(nearest(part(z, k), books[k])[1], []).append(part(z, k))
            books[k] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else b for i, b in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, sums = [], Counter()
    for i, z, l in kept:
        found = [nearest(part(z, k), books[k]) for k in range(4)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), l))
        sums[l] += out[-1][2]
    return [(i, c, e, sums[l], sha, l) for i, c, e, l in out]


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        path = grid[np.argsort(vector_codes.hilbert_keys(grid, bits))]
        assert sorted(vector_codes.hilbert_keys(grid, bits).tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_the_nearest_and_leave_others_out():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-20, 20, (512, 3)) + c for c in rng.integers(-500, 500, (8, 3))])
    rows = rows[vector_codes.hilbert_order(rows)]
    book = rng.integers(-500, 500, (64, 3))
    at = np.arange(0, len(rows), vector_codes.BLOCK)
    low, high = np.minimum.reduceat(rows, at), np.maximum.reduceat(rows, at)
    code, _ = vector_codes.assign(rows, low, high, book)
    assert (code == vector_codes.distances(rows, book).argmin(axis=1)).all()
    assert vector_codes.shortlists(low, high, book).mean() < 0.5


def test_distances_are_exact_beyond_doubles():
    top = 1 << 27
    rows, book = np.array([[top, -top, 1]]), np.array([[-top, top, 0], [-top, top, 2], [-top, top, 3]])
    assert vector_codes.distances(rows, book).tolist() == [[8 * top * top + 1, 8 * top * top + 1, 8 * top * top + 4]]


def odd_vectors():
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.3, 0.30001, 2.0]) for _ in range(8)], rng.choice([None, 1, 2]))
            for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 3 + [(None, rows[3][1], 2), (None, rows[3][1], 2), (-5, [0.0] * 8, None)]
    rows += [(900, None, 1), (901, [None] + [1.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, None)]
    return rows


def test_codes_equal_brute_force(spark, same, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_BYTES", 8 * 8 * 128)      # several chunks in a task
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit("x") for c in ("code", "error", "of", "vec", "slot")}).repartition(3)
    same(vector_codes.compress(df).collect(), brute_codes(rows))
    same(vector_codes.compress(df, entries=7, rounds=2).collect(), brute_codes(rows, 7, 2))
    assert vector_codes.compress(df.limit(0)).count() == 0
    few = df.where("vec_id < 3 and vec_id >= 0").select("vec_id", "label", "embedding")
    same(vector_codes.compress(few).collect(), brute_codes([r for r in rows if r[0] in (0, 1, 2)]))


def test_vectors_that_cannot_be_coded(spark):
    frame = lambda *v: spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    for bad in (frame([1.0] * 6), frame([1.0] * 4, [1.0] * 8), frame([1.0] * 4, [1e9] * 4), frame([])):
        with pytest.raises(Exception, match="vectors|components"):
            vector_codes.compress(bad).collect()


# ------------------------------------------------------------------ neighbours

def brute_neighbours(rows, k=20, every=20):
    use = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)
           and any(v)]
    x = np.array([v for _, v in use])
    out = []
    for at, (i, v) in enumerate(use):
        if i is None or i % every:
            continue
        scores = np.zeros(len(use))
        for j in range(x.shape[1]):
            scores += v[j] * x[:, j]
        best = sorted((-s, c is None, c or 0) for n, (s, (c, _)) in enumerate(zip(scores.tolist(), use)) if n != at)[:k]
        out += [(i, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best)]
    return out


def test_traversal_yields_pairs_by_falling_sum():
    rng = np.random.default_rng(4)
    u, v, counts = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 3, 30)
    got = list(ann.traverse(u, v, counts))
    want = sorted(np.flatnonzero(counts), key=lambda c: -(u[c // 5] + v[c % 5]))
    assert [c for c, _ in got] == want and all(counts[c] == n for c, n in got)


def test_large_cells_get_buckets_of_their_own(monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 10)
    index = ann.Index(np.zeros((2, 1)), np.zeros((3, 1)))
    index.count(np.array([4, 5, 35, 0, 9, 2]))
    assert index.bucket.tolist() == [0, 0, 1, 0, 5, 6] and index.slices.tolist() == [1, 1, 4, 1, 1, 1]


def test_all_neighbours_when_everything_is_visited(spark, same, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    monkeypatch.setattr(ann, "TILE", 4)
    rows = [(i, v) for i, v, _ in odd_vectors()] + [(i, [0.5] * 8) for i in range(1000, 1200)]     # a common vector, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("uid", "cell", "bucket", "score", "rank", "slice")}).repartition(3)
    got, want = ann.search(df, target=1.0).collect(), brute_neighbours(rows)
    share = len({(r.query_id, r.vec_id) for r in got} & {w[:1] + w[2:3] for w in want}) / len({w[:1] + w[2:3] for w in want})
    assert share > 0.97 and len(got) == len(want)
    few = df.where("vec_id in (20, 3, 4, 900)")
    same(ann.search(few).collect(), brute_neighbours([r for r in rows if r[0] in (20, 3, 4, 900)]))
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 3")).count() == 0


def test_recall_and_scores_on_the_table(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = QUERIES["op13_multi_index"](spark, path).collect(), brute_neighbours(rows)
    x = dict(rows)
    assert len(got) == len(want)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(got) and len(found & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9
    for r in got[:200]:
        s = 0.0
        for a, b in zip(x[r.query_id], x[r.vec_id]):
            s += a * b
        assert s == r.score
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) == 20 for v in by.values())
