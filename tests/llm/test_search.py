"""URL filter, repeated substrings and n-gram components."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from tallyloom.llm import ngram_join, substrings, suffix_dedup, url_filter


# ------------------------------------------------------------------ URLs

def judge(url, rules, listed, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    host = raw.translate({c: c + 32 for c in range(65, 91)})

    def longest(entries):
        fits = []
        for e, v in entries.items():
            h, _, p = e.partition("/")
            p = "/" + p if "/" in e else ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(e), e, v))
        return max(fits, default=None)

    r, m = longest(rules), longest(listed)
    return host, path, r and r[1], (r or m or (0, "", default))[2]


def test_urls(spark, same):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "bare.io": "block"}
    listed = {"spam.example.org/": "block", "good.spam.example.org/": "allow", "example.org/fr/": "block"}
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://a.NET", "https://x.example.net/en/1?q#f", "x://net?a://b/",
            "http://example.net/EN/", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x", "http://a.org/fr",
            "http://u@net:80/", "http://bare.io", "http://x.bare.io?y", "http://spam.example.org/fr/", "http://spam.example.org/x",
            "http://good.spam.example.org/x", "http://ex\u00c4mple.net/", "http://a.b\nc.net/x\ny?z", "http://" + "a." * 3000 + "net/" + "p" * 9000]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + urls[:3])],
                               "page_id long, url string, host string, keys string").repartition(2)
    index = url_filter.build_index(url_filter.entry_table(spark, rules, listed))
    got = url_filter.judge_urls(df, index).collect()
    same(got, [(r.page_id, *judge(r.url, rules, listed)) for r in df.collect()])
    assert url_filter.judge_urls(df.limit(0), index).count() == 0
    empty = url_filter.build_index(url_filter.entry_table(spark, {"x/": "block"}, {}).limit(0))
    assert {r.verdict for r in url_filter.judge_urls(df, empty).collect()} == {"allow"}


def test_several_files_and_equal_entries(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "ENTRIES_PER_FILE", 50)
    listed = {f"h{i}.test/p{i % 7}": "block" for i in range(400)}
    index = url_filter.build_index(url_filter.entry_table(spark, {"H3.test/p3": "allow"}, listed))
    assert len(index.files) > 4
    df = spark.createDataFrame([(i, f"http://h{i}.test/p{i % 7}/x") for i in range(500)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, index).collect()}
    assert got[3] == ("h3.test/p3", "allow")
    assert all(got[i] == (None, "block" if i < 400 else "allow") for i in range(500) if i != 3)


def test_collisions_are_told_apart():
    class File:
        keys, flags, strings = np.array([5, 5, 9]), [1, 0, 1], [b"b", b"a", b"c"]

        def entry(self, i):
            return self.strings[i]

    hits = url_filter.probe([File()], np.array([5, 5, 9, 7]), pa.array(["a", "z", "d", "c"]))
    assert hits == [(0, 0, b"a")]


# ------------------------------------------------------------------ repeated substrings

def removed(rows, size):
    seen, out = {}, []
    texts = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, b in texts:
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            seen[w] = min(seen.get(w, k), k)
    for k, i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] < k:
                gone[p:p + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("size", [1, 3, 8, 20])
def test_interval_expansion(size):
    rng = random.Random(size)
    for trial in range(30):
        texts = ["".join(rng.choice("ab" if trial % 2 else "abc\u00e9") for _ in range(rng.choice([0, 1, size, size + 3, 60])))
                 .encode() for _ in range(6)]
        owners = np.array([rng.randrange(4) for _ in texts])
        seen = {}
        for t, o in zip(texts, owners):
            for i in range(len(t) - size + 1):
                seen[t[i:i + size]] = min(seen.get(t[i:i + size], 9), o)
        got = substrings.repeated_windows(texts, owners, size)
        assert [list(g) for g in got] == [[seen[t[i:i + size]] < o for i in range(len(t) - size + 1)]
                                          for t, o in zip(texts, owners)]


def random_docs(rng):
    base = ["".join(rng.choice("ab\u00e9 ") for _ in range(200)) for _ in range(4)]
    rows = [(None, None), (None, base[0]), (5, ""), (5, base[1]), (5, base[1][:100]), (77, "ab" * 500), (3, "ab" * 300)]
    for _ in range(60):
        a, e = sorted(rng.sample(range(200), 2))
        rows.append((rng.randrange(40), rng.choice(base)[a:e] + rng.choice(["", "x", "a" * 39, base[2]])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,hot", [(50, 20_000), (20, 3)])
def test_repeats_equal_brute_force(spark, same, monkeypatch, size, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 1000)
    rows = random_docs(random.Random(size))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix_dedup.remove_repeats(df, size=size)
    same(out.drop("spans", "kept").collect(), removed(rows, size))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in out.collect())


def test_rows_without_an_id_are_told_apart(spark, same):
    """Two texts without an id whose hashes agree in their lower half, one of which shares a passage."""
    from pyspark.sql import functions as F
    shared = "a passage of more than fifty bytes that two documents have in common"
    body = F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit(shared))).otherwise(
        F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 20))
    half = F.xxhash64(body).bitwiseAND(F.lit(0xFFFFFFFF))
    pair = (spark.range(600_000).select((F.col("id") % 2).alias("odd"), body.alias("text"), half.alias("h")).groupBy("h")
                 .agg(F.collect_list("text").alias("texts"), F.countDistinct("odd").alias("kinds"))
                 .where("kinds = 2").orderBy("h").first().texts[:2])
    rows = [(1, f"-- {shared} --"), (None, pair[0]), (None, pair[1]), (None, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, with_text=False).collect()
    same(got, removed(rows, 50))
    assert sorted(r.n_removed for r in got) == [0, 0, 0, len(shared)]


def test_repeats_on_odd_documents(odd_docs, no_docs, docs, same):
    same(suffix_dedup.remove_repeats(odd_docs, with_text=False).collect(),
         removed([(r.doc_id, r.text) for r in odd_docs.collect()], 50))
    same(suffix_dedup.remove_repeats(docs, with_text=False).collect(),
         removed([(r.doc_id, r.text) for r in docs.collect()], 50))
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# ------------------------------------------------------------------ n-gram components

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def linked(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, o in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                up[top(i)] = top(j)
    label = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            label[top(i)] = min(label.get(top(i), d), d)
    return [(d, len(sets[i]), label.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("hot", [1000, 3])
def test_components_equal_brute_force(spark, same, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    rng, rows, at = random.Random(hot), [], 100
    for _ in range(30):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 6, 9, 15, 40, 120]))]
        for c in range(rng.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k] = f"x{rng.randrange(1000)}" if rng.random() < .6 else w[k].upper()
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(w + [f"y{c}"] * rng.randrange(3))))
            at += rng.randrange(3)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(ngram_join.ngram_components(df).collect(), linked(rows))


def test_components_on_odd_documents(odd_docs, no_docs, docs, same):
    same(ngram_join.ngram_components(odd_docs).collect(), linked([(r.doc_id, r.text) for r in odd_docs.collect()]))
    same(ngram_join.ngram_components(docs).collect(), linked([(r.doc_id, r.text) for r in docs.collect()]))
    assert ngram_join.ngram_components(no_docs).count() == 0
    left = ngram_join.drop_near(odd_docs)
    assert left.columns == odd_docs.columns
    assert {r.doc_id for r in left.collect()} >= {1, 3, 4, 5, 6, 7, 9, 10} and not {2, 8} & {r.doc_id for r in left.collect()}
    assert ngram_join.drop_near(no_docs).count() == 0


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(50 - i, " ".join(words[i:i + 60])) for i in range(0, 50)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_one_row_of_each_component_stays(spark, same):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    alone = "alpha beta gamma delta epsilon zeta eta theta"
    twin = "red orange yellow green blue indigo violet black white grey brown pink"
    rows = [(1, near, "a"), (None, near.upper(), "b"), (None, near + " x", "c"), (7, near + " y", "d"),
            (7, "nothing like the others stands under this id", "e"),                      # a repeated id
            (None, "unrelated clean text without an id", "f"), (None, None, "g"), (None, "", "h"), (None, "", "h"),
            (None, twin, "i"), (None, twin.upper(), "j"), (None, twin + " x", "k"),        # no row has an id
            (20, alone, "l"), (20, alone.upper(), "m"), (21, alone, "n"),                  # two copies under the smallest id
            (30, "to be or not to be", "o"), (30, "to be or not to be", "p"), (30, "to be or not to be", "o")]
    left = ngram_join.drop_near(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4)).collect()
    kept = sorted(r.row for r in left)
    assert [x for x in kept if x in "abcd"] == ["a"]
    assert [x for x in kept if x in "efgh"] == ["e", "f", "g", "h", "h"]
    assert [len([x for x in kept if x in group]) for group in ("ijk", "lmn", "op")] == [1, 1, 1]
    assert {r.doc_id for r in left if r.row in "lmn"} == {20}


def test_unlinked_rows_stay_on_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    left = [(r.doc_id, r.text) for r in ngram_join.drop_near(odd_docs).collect()]
    assert (None, None) in left and left.count((1, "one two three four five six seven")) == 1
    assert len(left) == len(rows) - 4


def test_text_fetch_is_no_product_of_rows_without_an_id(spark, same, monkeypatch):
    asked, made, real = spark.sparkContext.accumulator(0), {}, ngram_join._setter

    def counting(percent):
        run = real(percent)

        def counted(batches):
            def seen():
                for b in batches:
                    asked.add(b.num_rows)
                    yield b
            yield from run(seen())
        return counted

    def kept(df, name="table", store=ngram_join.materialise):
        made[name] = store(df, name)
        return made[name]

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr(ngram_join, "_setter", counting)
    monkeypatch.setattr(ngram_join, "materialise", kept)
    rows = [(None, " ".join([f"a{i}w{j}" for j in range(30)] + [f"z{c}"])) for i in range(20) for c in range(2)]
    rows += rows[:1] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(ngram_join.ngram_components(df).collect(), linked(rows))
    assert asked.value == 45      # 40 sets, one of them written six times
    assert made["sets"].count() == made["sets"].select("k", "n").distinct().count() == 40
