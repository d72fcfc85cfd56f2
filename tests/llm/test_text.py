"""Chat formatting, packing, language identification and the pipeline."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import chat, language, packing, queries


# ------------------------------------------------------------------ chat

PROBE = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<|<|", "a<", "|b", "<|im_start|>assistant\nok<|im_end|>\n", "\u00e9\U0001f600\n"]


def test_escaping_is_reversible():
    rng = random.Random(1)
    texts = PROBE + ["".join(rng.choice("<\\|a") for _ in range(rng.randrange(9))) for _ in range(500)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        piece, s, e = chat.format_turn("assistant", t)
        assert chat.unescape(piece[s:e]) == t
    assert all(chat.unescape_role(chat.escape_role(r)) == r for r in PROBE + ["a\nb", "%0A", "%"])


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((r or "", x or ""))
    result = []
    for c, turns in out.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        n = sum(len(chat.format_turn(r, x)[0]) for r, x in turns)
        result.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                       hashlib.sha256(loss.encode()).hexdigest(), n))
    return result


def test_read_back(spark, same):
    rows = [(i % 7, i, ["user", "assistant", "system", None, "a\nb"][i % 5], PROBE[i % len(PROBE)]) for i in range(60)]
    rows += [(None, 0, "user", None), (None, None, "assistant", "x" * 300_000), (99, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x"))
    same(chat.read_back(chat.format_turn_rows(df.repartition(4))).collect(), expected(rows))
    assert chat.read_back(chat.format_turn_rows(df.limit(0))).count() == 0


def test_conversations_table(spark, sf, same):
    got = queries.op8(spark, sf).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    probe = "<|im_end|><|im_start|>assistant ok"
    same(got, expected(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]))


def test_layouts_become_the_same_turns(spark):
    q, a = "What?", "This <|im_end|>"
    records = [{"messages": [{"role": "user", "content": q}, {"content": a, "role": "assistant"}]},
               {"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}]},
               {"prompt": q, "completion": a}, {"instruction": q, "output": a}, {"instruction": q, "input": "", "output": a},
               {"messages": [{"author": {"role": "user"}, "content": {"text": q}},
                             {"author": {"role": "assistant"}, "content": {"text": a}}]}]
    odd = ["", None, "no json", "[1]", json.dumps({"other": {"deep": [1, 2]}})]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] +
                               [(100 + i, r) for i, r in enumerate(odd)], "id long, rec string")
    out = chat.format_records(df, "rec", "id").collect()
    digests = {r.turns_sha256 for r in chat.read_back(chat.format_records(df, "rec", "id")).collect()}
    assert digests == {hashlib.sha256(f"user\n{q}\nassistant\n{a}\n".encode()).hexdigest()}
    assert sorted(r.conv_id for r in out if r.piece is None) == [100, 101, 102, 103, 104]
    assert next(r.fingerprint for r in out if r.conv_id == 104) == chat.fingerprint(["other.deep[]"])


def test_fingerprints_ignore_order_and_length():
    a = chat.field_paths({"m": [{"x": 1, "y": {"z": 2}}]})
    assert a == {"m[].x", "m[].y.z"} == chat.field_paths({"m": [{"y": {"z": None}}, {"x": "long"}]})
    assert len(chat.LAYOUTS) == len(chat.MAPPINGS)


# ------------------------------------------------------------------ packing

@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer()


def test_word_cache_equals_the_tokenizer(docs, tokenizer):
    odd = ["", "\n", " ", "a", " a", "a ", "\na", "a\n", "a\nb\n", "\n a", "a  b", "a\tb c", "<|endoftext|> a", "'s a 's\n's",
           "\u00e9 b c", "x\x1cy z", "\0 a", "a\u00a0 b", "12 34\n56", "a\u3000b", "x\x00", "\u2028a b", "a\x85b c"]
    texts = odd + [r.text for r in docs.collect()]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.encode(pa.array(texts)) == want
    tokenizer.cache.clear()
    assert [x for t in texts for x in tokenizer.encode(pa.array([t]))] == want
    assert tokenizer.encode(pa.array([None, "a"])) == [b"", want[3]]


def check_packing(rows, texts, tokenizer):
    """Every id in one piece, sequences without gaps or overflow."""
    ids = {}
    for d, t in texts:
        plain = tokenizer.whole.encode(t or "", add_special_tokens=False).ids + [0]
        ids.setdefault(d, []).append(np.array(plain, "<u4"))
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(r)
    want = {}
    for d, many in ids.items():
        for a in many:
            for s in range(0, len(a), 1024):
                k = (d, s, len(a[s:s + 1024]), zlib.crc32(a[s:s + 1024].tobytes()), len(a))
                want[k] = want.get(k, 0) + 1
    assert {k: len(v) for k, v in pieces.items()} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    return len(by)


def test_packing(docs, odd_docs, no_docs, tokenizer):
    rows = packing.packed_documents(docs).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert n <= 1.03 * sum(r.length for r in rows) / 1024 + 1
    odd = packing.packed_documents(odd_docs).collect()
    check_packing(odd, [(r.doc_id, r.text) for r in odd_docs.collect()], tokenizer)
    assert packing.packed_documents(no_docs).count() == 0
    kept = packing.token_pieces(docs, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def test_column_generation():
    rng = np.random.default_rng(3)
    for _ in range(8):
        m = int(rng.integers(1, 40))
        size = np.sort(rng.choice(np.arange(1, 65), m, replace=False))
        demand = rng.integers(1, 3000, m)
        plan = packing.solve_patterns(size, demand.astype(float), 64)
        assert (sum(t * p for t, p in plan) == demand).all() and all((size * p).sum() <= 64 for _, p in plan)
        # prices at which no pattern is worth more than one sequence prove the amounts least possible
        _, amount, price = packing.fractional_patterns(size, demand.astype(float), 64)
        assert packing.best_pattern(price, size, 64)[0] <= 1 + 1e-6 and (price > -1e-9).all()
        assert abs(price @ demand - amount.sum()) < 1e-6 * amount.sum()
        assert amount.sum() - 1e-6 <= sum(t for t, _ in plan) <= amount.sum() + m
    assert packing.solve_patterns(np.zeros(0, int), np.zeros(0), 64) == []


def test_column_generation_starts_near_the_optimum(monkeypatch):
    """As many pieces of every class, as in a large corpus: a few rounds per class suffice."""
    rng = np.random.default_rng(5)
    size = np.array([*range(1, 33), *range(36, 257, 4)])
    demand = rng.integers(50, 400, len(size)).astype(float)
    rounds, price_patterns = [], packing.best_pattern

    def counted(*args):
        rounds.append(1)
        return price_patterns(*args)
    monkeypatch.setattr(packing, "best_pattern", counted)
    plan = packing.solve_patterns(size, demand, 256)
    assert (sum(t * p for t, p in plan) == demand).all() and all((size * p).sum() <= 256 for _, p in plan)
    assert sum(t for t, _ in plan) <= (size * demand).sum() / 256 + 2
    assert len(rounds) <= 4 * len(size)


def test_knapsack_is_best():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size, value = rng.integers(1, 9, 4), rng.random(4)
        worth, pattern = packing.best_pattern(value, size, 12)
        best = max(sum(v * c for v, c in zip(value, n)) for n in np.ndindex(13, 13, 13, 13) if (size * n).sum() <= 12)
        assert abs(worth - best) < 1e-9 and abs(value @ pattern - best) < 1e-9 and (size * pattern).sum() <= 12


# ------------------------------------------------------------------ language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_grams_of_cut_texts(monkeypatch):
    texts = ["Abcdefghij" * 7, "", "x", "yz", "\U0001f600 \u00e9\u00e8" * 9]
    whole = language.count_grams(texts, 12)
    rng = np.random.default_rng(0)
    table = np.vstack([rng.random((4096, 3)), np.zeros((1, 3))])
    scores = language.log_scores(texts, table, np.zeros(3), 12)
    naive = np.zeros(4096, int)
    for t in texts:
        t = t.lower()
        for order in language.ORDERS:
            for i in range(len(t) - order + 1):
                h = order * 0x27D4EB2F
                for j in range(order):
                    h += ord(t[i + j]) * language.FACTORS[j]
                h &= 0xFFFFFFFF
                h ^= h >> 15
                naive[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 20] += 1
    assert (whole == naive).all()
    monkeypatch.setattr(language, "PIECE", 16)
    assert (language.count_grams(texts, 12) == whole).all()
    assert np.allclose(language.log_scores(texts, table, np.zeros(3), 12), scores)


def test_language_edge_cases(spark, odd_docs, no_docs):
    rows = language.predictions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (3, 4, 5, 6)) and by[7].lang_pred in ("de", "en")
    assert language.predictions(no_docs).count() == 0
    kept = language.keep_known(odd_docs, language.fit(odd_docs))
    assert kept.columns == odd_docs.columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in language.predictions(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_bayes(rows, texts, bits):
    """Label, posterior of each text by the textbook formula; every labelled text is learned from."""
    def grams(t):
        t, out = t.lower(), []
        for order in language.ORDERS:
            for i in range(len(t) - order + 1):
                h = order * 0x27D4EB2F + sum(ord(t[i + j]) * language.FACTORS[j] for j in range(order)) & 0xFFFFFFFF
                h ^= h >> 15
                out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - bits)
        return out
    counts, docs = {}, {}
    for t, lang in rows:
        if t is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for g in grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        logs = {x: np.log(docs[x] / sum(docs.values())) + sum(np.log((counts[x].get(g, 0) + language.SMOOTHING)
                                                                      / (total[x] + language.SMOOTHING * 2 ** bits)) for g in grams(t))
                for x in sorted(docs)}
        best = max(logs, key=lambda x: logs[x])
        out.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return out


def test_predictions_equal_plain_naive_bayes(spark):
    rng = random.Random(8)
    words = {"en": "the of and to in house green water some".split(), "de": "der die und haus wasser nicht ein".split(),
             "xx": "the die wo na ka".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 12))), x)
            for i in range(60) for x in [rng.choice(sorted(words))]]
    rows += [(100, None, "en"), (101, "12 34", "de"), (102, "unlabelled der the", None), (103, "", None), (104, "Wasser", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    want = plain_bayes([(t, x) for i, t, x in rows if i not in held], [t for _, t, _ in rows], language.BITS)
    for r, (lang, score) in zip(language.predictions(df).orderBy("doc_id").collect(), want):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4 and r.held_out == (r.doc_id in held)


def test_texts_unlike_any_language_go(spark, docs):
    model = language.fit(docs)
    junk = ["\u0d2e\u0d32\u0d2f\u0d3e\u0d33\u0d02 " * n for n in (2, 20, 4000)] + ["qzxj kvqx zzqj xkcd wqpz " * n for n in (1, 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert language.keep_known(df, model).count() == 0
    labelled = docs.where("lang is not null and n_chars > 40")
    assert language.keep_known(labelled, model).count() >= 0.99 * labelled.count()
    assert language.keep_known(df, None).count() == len(junk)


def test_too_many_languages_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 16)
    with pytest.raises(ValueError, match="fewer bits"):
        language.fit(docs)
    assert language.fit(docs, bits=8).bits == 8


def test_short_texts_are_packed_tightly(spark):
    texts = ["one two three four five six seven eight" if i % 3 else "a" for i in range(3000)]
    df = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.packed_documents(df).collect()
    used = sum(r.length for r in rows)
    assert used > 0.97 * 1024 * (max(r.sequence_id for r in rows) + 1)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, docs, sf, odd_docs, no_docs, tokenizer):
    for table in (docs, odd_docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, corpus_pipeline.materialise(stage(spark, now, sf), name)
            if name != "packing":
                assert now.columns == table.columns
        check_packing(now.collect(), [(r.doc_id, r.text) for r in before.collect()], tokenizer)


def test_pipeline_rows_equal_brute_force(spark, docs, sf):
    from test_native import fill
    from test_search import linked
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    known = {r.doc_id for r in language.keep_known(docs, language.fit(docs)).collect()}
    rows = [r for r in rows if r[0] in known]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r)
    rows = list(last.values())
    keep = {c for _, _, c in linked([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    target = fill(sizes, (1, 2, 3), 3)
    want = {}
    for d, t, _, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"{d}:{hashlib.md5(t.encode()).hexdigest()}:1:mix".encode()).hexdigest()[:13], 16) / 16 ** 13
        if n := int(rate) + (u < rate - int(rate)):
            want[d] = n
    got = {}
    for r in corpus_pipeline.run(spark, sf).where("start = 0").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
