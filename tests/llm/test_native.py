"""Exact dedup, sharding, mixing and line frequency."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, mixing, quality, sharding


# ------------------------------------------------------------------ exact dedup

def brute_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (max(known) if known else None), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1, hashlib.sha256(t.encode()).hexdigest()))
            left -= i == keep and left == 1
    return out


def test_exact_groups(spark, odd_docs, same):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    same(exact_dedup.exact_groups(odd_docs).collect(), brute_groups(rows))


def test_exact_with_a_full_filter(spark, docs, same, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", exact_dedup.BUCKET)
    monkeypatch.setattr(exact_dedup, "_positions", lambda h, bits: [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(8)) + i * bits
                                                                    for i in range(2)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(exact_dedup.exact_groups(docs).collect(), brute_groups(rows))


def test_unique_rows_do_not_reach_the_grouping(docs):
    flagged = exact_dedup._flagged(docs, "text", "doc_id")
    several = flagged.groupBy("sha").count().where("count > 1").count()
    assert flagged.where("maybe").select("sha").distinct().count() <= several + 3


def test_drop_exact_keeps_columns_and_one_row_per_text(odd_docs, no_docs):
    out = exact_dedup.drop_exact(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd_docs.collect()})
    kept = {(r.text or ""): r.doc_id for r in out.collect()}
    assert kept["one two three four five six seven"] == 1 and kept[""] == 4
    assert exact_dedup.drop_exact(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


# ------------------------------------------------------------------ sharding

def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 10863919174838991, 16, 255] + [random.Random(1).getrandbits(63) for _ in range(200)]
    for n in (1, 2, 16, 200):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        got = df.select("k", sharding.jump_shards(F.col("k"), n).alias("s")).select("k", "s.*").collect()
        assert all((r.shard, r.grown) == (jump(r.k, n), jump(r.k, n + 1)) for r in got)


def test_manifest(odd_docs, no_docs):
    rows = sharding.manifest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for s, slots in [(s, sorted(r.slot for r in rows if r.shard == s)) for s in {r.shard for r in rows}]:
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes
    assert sharding.manifest(no_docs).count() == 0


def test_assign_and_write(spark, odd_docs, tmp_path):
    out = sharding.assign(odd_docs, "text", 5)
    assert out.columns == [*odd_docs.columns, "shard"] and {r.shard for r in out.collect()} <= set(range(5))
    sharding.write_shards(odd_docs.drop("dotted.name"), "doc_id", str(tmp_path / "out"), 4, 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


# ------------------------------------------------------------------ mixing

def fill(sizes, weights, cap):
    """Share out round by round until no target is above its stop."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})


def test_targets_equal_filling_by_rounds(spark):
    rng = random.Random(7)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 5000, 200]) for i in range(9)} | {None: 40}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = fill(sizes, (1, 2, 3), 3)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in got)


def test_mix(odd_docs, no_docs, docs):
    plan = mixing.mix_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count() and all(r.copies <= 3 and r.taken == r.size * r.copies for r in plan)
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter(r.source for r in out.collect()) == Counter({s: n for s, n in (
        (s, sum(r.copies for r in plan if r.source == s)) for s in {r.source for r in plan}) if n})
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, mixing.mix_plan(docs.repartition(7)).collect()))
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_comes_near_its_targets(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text",
                                       "concat('s', id % 4) as source")
    for r in (mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()):
        assert abs(r.t - r.g) < 0.03 * r.g


def test_rows_without_an_id_draw_and_rank_one_by_one(spark):
    df = spark.range(30000).selectExpr("case when id % 3 > 0 then id end as doc_id",
                                       "concat('n', id, ' ', repeat('w ', cast(id % 40 as int))) as text",
                                       "concat('s', id % 4) as source").unionByName(
        spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same text here' as text", "'s9' as source"))
    for r in mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.03 * r.g
    mixed = mixing.mix(df).groupBy("source").count().collect()
    plan = mixing.mix_plan(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r["count"] for r in mixed} == {r.source: r.n for r in plan}
    rows = sharding.manifest(df).where("doc_id is null").groupBy("shard").count().collect()
    assert len(rows) == 1                                    # one key, one shard: the law
    digest = F.md5(F.concat(F.lit(":"), F.crc32(F.encode(F.col("text"), "UTF-8")).cast("string")))
    largest = df.where("doc_id is null and source <> 's9'").groupBy(F.substring(digest, 1, 3)).count().agg(F.max("count")).first()[0]
    assert largest < 20


# ------------------------------------------------------------------ line frequency

def test_lines_above_the_limit(spark, same):
    rows = [(i, f"footer of the site\nown line number {'x' * i} with quite some words in it so that it stays here", "h1")
            for i in range(8)]
    rows += [(100 + i, "footer of the site\nfooter OF  the site\nfooter of the site 7\n\nshort", "h1") for i in range(2)]
    rows += [(200, "footer of the site\n" + "many words that stand in this one document alone and nowhere else at all", "h2")]
    rows += [(300, None, None), (301, "", "h1"), (302, "a b c d e a b c d e a b c d e x", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(df, max_docs=5).collect()}
    assert len(got) == 14
    assert all(got[i].kept and got[i].n_left == got[i].n_words - 4 for i in range(8))
    assert not got[100].kept and got[100].n_dup_lines == 0 and not got[100].base_failed
    assert got[200].kept and got[200].n_left == got[200].n_words      # another host
    assert got[300].base_failed and got[301].base_failed and got[300].n_words == 0
    assert got[302].n_repeat_words == 15 and got[302].base_failed
    texts = {r.doc_id: r.text for r in quality.clean_lines(df, max_docs=5).collect()}
    assert texts[3].startswith("own line") and texts[200].startswith("footer") and texts[300] == ""


def test_copies_of_a_document_count_once(spark):
    text = "this line has enough words\nand this one has enough words too so nothing is ever depleted here"
    df = spark.createDataFrame([(i, text, "h") for i in range(40)], "doc_id long, text string, source string")
    assert all(r.kept and r.n_left == r.n_words for r in quality.quality_rules(df, max_docs=5).collect())


def test_quality_edge_cases(odd_docs, no_docs):
    rows = quality.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    long = [r for r in rows if r.doc_id == 7][0]
    assert long.n_words == 32000 and long.n_repeat_words == 32000 and long.base_failed
    assert quality.quality_rules(no_docs).count() == 0 and quality.clean_lines(no_docs).count() == 0
