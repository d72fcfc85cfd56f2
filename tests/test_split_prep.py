import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import neighbors, prep, split


def grouped(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("k"), F.when(F.col("id") < n // 3, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("g"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("y"))


@pytest.mark.parametrize("make", [
    lambda df: split.split_by_groups(df, "g", 0.2, 0.2),
    lambda df: split.split_by_groups_and_target(df, "g", "y", 0.2, 0.2),
    lambda df: split.split_by_groups_and_target(df, "g", "y", 0.2, 0.2, limit=3)])
def test_groups_stay_whole(spark, make):
    df = grouped(spark)
    done = make(df)
    assert done.count() == df.count()
    assert {r["kind"]: r["n"] for r in split.group_overlaps(done, "g").where("kind like '%&%'").collect()} == {
        "train&val": 0, "train&test": 0, "val&test": 0}


def test_target_split_shares(spark):
    done = split.split_by_target(grouped(spark), "y", "k", 0.2, 0.1)
    counts = {(r["split"], r["y"]): r["count"] for r in done.groupBy("split", "y").count().collect()}
    assert counts == {(s, y): n for s, n in (("test", 40), ("val", 20), ("train", 140)) for y in "abc"}
    assert not split.stratification_check(done, "y").first()["alert"]
    again = split.split_by_target(grouped(spark).repartition(11), "y", "k", 0.2, 0.1)
    assert done.exceptAll(again).isEmpty()


def test_bad_sizes(spark):
    for sizes in ((0, None), (1.2, None), (0.5, 0.6)):
        with pytest.raises(ValueError):
            split.split_by_target(grouped(spark), "y", "k", *sizes)


def test_folds(spark):
    df = grouped(spark)
    by_class = split.stratified_folds(df, "y", "k", 5).groupBy("fold", "y").count()
    assert {r["count"] for r in by_class.collect()} == {40}
    whole = split.whole_group_folds(df, "g", 5, limit=4)
    assert whole.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert split.sample_fraction(df, "k", 0.3).count() == 180


def test_mode_ties_and_constant(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id_log long, t string")
    assert prep.DataImputer().fit_transform(df).where("id_log = 5").first()["t"] == "a"
    assert prep.DataImputer(categorical_strategy="constant").fit_transform(df).where("id_log = 5").first()["t"] == "missing"


def test_numeric_labels_sort_as_numbers(spark):
    df = spark.createDataFrame([(10,), (2,), (9,)], "y long")
    codes = prep.LabelCodes("y").fit(df)
    assert codes.class_mapping == {2: 0, 9: 1, 10: 2} and codes.n_classes == 3
    with pytest.raises(Exception, match="unknown value"):
        codes.transform(spark.createDataFrame([(3,)], "y long")).collect()
    with pytest.raises(ValueError, match="fit"):
        prep.LabelCodes("y").transform(df)


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a", "lo"), ("b", "hi"), ("c", "lo")], "t string, o string")
    enc = prep.DataEncoder(nominal=["t"], ordinal={"o": ["lo", "hi"]}).fit(train)
    row = enc.transform(spark.createDataFrame([("zz", "hi")], "t string, o string")).first()
    assert row.asDict() == {"t_b": 0, "t_c": 0, "o_code": 1}
    with pytest.raises(Exception, match="unknown value"):
        enc.transform(spark.createDataFrame([("a", "mid")], "t string, o string")).collect()


def _null_aware(x, y, width):
    ok = ~np.isnan(x) & ~np.isnan(y)
    return np.sqrt(width / ok.sum() * ((x[ok] - y[ok]) ** 2).sum()) if ok.any() else np.nan


@pytest.mark.parametrize("options", [{}, {"chunk": 16}, {"chunk": 8, "max_pivots": 5}])
def test_knn_imputation_against_brute_force(spark, options):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 4)).round(1)
    x[60:110] = x[60]                                   # a third of the rows are copies
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "id_log long, a double, b double, c double, d double")
    got = {r["id_log"]: list(r)[1:] for r in prep.DataImputer(knn_neighbors=3, **options).fit_transform(df).collect()}
    for i, row in enumerate(x):
        for j in range(4):
            want = row[j]
            if np.isnan(want):
                d = np.array([_null_aware(row, y, 4) if not np.isnan(y[j]) else np.nan for y in x])
                order = [k for k in np.lexsort((np.arange(len(x)), d)) if not np.isnan(d[k])][:3]
                want = x[order, j].mean() if order else np.nanmean(x[:, j])
            assert got[i][j] == pytest.approx(want), (i, j)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("options", [{}, {"chunk": 16}])
def test_neighbors_with_a_hot_block_of_copies(spark, metric, options):
    rng = np.random.default_rng(2)
    x = np.vstack([np.zeros((40, 3)), rng.normal(size=(80, 3)).round(1)])
    label = np.r_[np.zeros(40), rng.integers(0, 3, 80)].astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))],
                               "k long, v array<double>, y int")
    got = {}
    for r in neighbors.same_class_neighbors(df, "k", "v", "y", 4, metric, **options).orderBy("q_key", "rank").collect():
        got.setdefault(r["q_key"], []).append(r["d_key"])
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "euclidean" else np.abs(x - x[i]).sum(1)
        d[(label != label[i])] = np.inf
        d[i] = np.inf
        want = [k for k in np.lexsort((np.arange(len(x)), d)) if np.isfinite(d[k])][:4]
        assert got[i] == want


def test_equal_vectors_of_a_class_are_searched_for_once(spark, monkeypatch):
    rows = [(i, [float(i % 5), float(i % 2)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    searched, search = [], neighbors._nearest
    monkeypatch.setattr(neighbors, "_nearest", lambda q, n, *a: searched.append(n) or search(q, n, *a))
    got = {}
    for r in neighbors.same_class_neighbors(df, "k", "v", "y", 4).orderBy("q_key", "rank").collect():
        got.setdefault(r["q_key"], []).append((r["d_key"], r["distance"]))
    assert searched == [30]
    for k, v, y in rows:
        same = [i for i, w, c in rows if c == y and w == v and i != k]
        assert got[k] == [(i, 0.0) for i in same[:4]]


def test_oversampling(spark):
    rng = np.random.default_rng(4)
    sizes = {0: 40, 1: 12, 2: 3}
    rows = [(c * 100 + i, [float(v) for v in rng.normal(c, 1, 3)], c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    grown = prep.balance_data(df, "k", "v", "y")
    assert {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()} == {0: 40, 1: 40, 2: 40}
    points = {k: np.array(v) for k, v, _ in rows}
    classes = {k: c for k, _, c in rows}
    made = prep.smote_rows(df, "k", "v", "y").collect()
    assert len(made) == 28 + 37
    for r in made:
        a, b, p = points[r["base"]], points[r["neighbor"]], np.array(r["vec"])
        assert classes[r["base"]] == classes[r["neighbor"]] == r["label"]
        t = ((p - a) @ (b - a)) / ((b - a) @ (b - a))
        assert -1e-9 <= t <= 1 + 1e-9 and np.allclose(p, a + t * (b - a))
    with pytest.raises(ValueError, match="too small"):
        prep.smote_rows(spark.createDataFrame(rows[:41], df.schema), "k", "v", "y")


def test_strategies():
    counts = {"a": 10, "b": 4, "c": 6}
    assert prep.target_counts(counts, "auto") == {"a": 10, "b": 10, "c": 10}
    assert prep.target_counts(counts, "minority") == {"a": 10, "b": 10, "c": 6}
    assert prep.target_counts(counts, "not minority") == {"a": 10, "b": 4, "c": 10}
    assert prep.target_counts({"a": 10, "b": 4}, 0.75) == {"a": 10, "b": 7}
    for bad in ("majority", "other"):
        with pytest.raises(ValueError):
            prep.target_counts(counts, bad)
    with pytest.raises(ValueError, match="two classes"):
        prep.target_counts(counts, 0.5)


def test_task_functions_travel_by_value():
    from pyspark import cloudpickle
    assert neighbors.__name__ in cloudpickle.list_registry_pickle_by_value()


def test_small_and_large_shares_leave_training_folds(spark):
    from tallyloom.operators.split import fold_shares, split_by_groups, split_by_groups_and_target
    assert fold_shares(0.15, 0.3) == (20, 3, 6) and fold_shares(0.2, 0.0) == (20, 4, 0)
    assert fold_shares(0.02, 0.0) == (50, 1, 0)
    k, test, val = fold_shares(0.5, 0.49)
    assert (test + val) < k and abs(test / k - 0.5) <= 0.025 and abs(val / k - 0.49) <= 0.025
    df = spark.range(3000).selectExpr("id", "case when id % 10 = 0 then null else id % 400 end as g", "cast(id % 3 as int) as y")
    out = split_by_groups_and_target(df, "g", "y", 0.5, 0.49)
    share = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert set(share) == {"train", "val", "test"} and out.where("g is null").isEmpty()
    assert split_by_groups(df, "g").where("split is null").isEmpty()


def test_more_patterns_than_cells(spark):
    """Donors of rare null patterns share mixed cells; answers stay those of a full comparison."""
    rng = np.random.default_rng(2)
    rows = [(i, [None if rng.random() < .4 else float(v) for v in rng.normal(size=6)]) for i in range(160)]
    side = spark.createDataFrame(rows, "key long, vec array<double>").selectExpr(
        "key", "'' as block", "cast(null as double) as payload", "vec")
    asked = side.where("vec[2] is null and exists(vec, x -> x is not null)").selectExpr("key", "block", "2 as target", "vec")
    def found(**kw):
        return {(r["q_key"], r["rank"]): (r["d_key"], round(r["distance"], 9), r["payload"])
                for r in neighbors.nearest(asked, side, 3, **kw).collect()}
    many, few = found(chunk=8), found(chunk=8, max_cells=30)
    assert many == few and all(v[2] is not None for v in few.values()) and len(few) > 100


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_vectors_without_structure_are_scanned_in_large_chunks(spark, metric, monkeypatch):
    """Cells rule out nothing here: no query is sent to cells, and the answers are those of a full comparison."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 24)).round(2)
    x[600:640] = x[:40]                                  # copies: ties go to the smaller key
    x[650, 3], x[651, 0] = np.nan, 1e20                  # rows that the bounds cannot hold
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    side = spark.createDataFrame(rows, "key long, vec array<double>").selectExpr(
        "key", "if(key % 7 = 0, 'a', 'b') as block", "-1 as target", "double(key) as payload", "vec")
    written = []
    store = neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df, name="table": (written.append(name), store(df, name))[1])
    monkeypatch.setattr(neighbors, "SCAN_BYTES", 1 << 12)
    got = {}
    for r in neighbors.nearest(side, side, 4, metric, exclude_self=True, chunk=32).orderBy("q_key", "rank").collect():
        assert r["payload"] == r["d_key"]
        got.setdefault(r["q_key"], []).append((r["d_key"], r["distance"]))
    assert "routed" not in written
    want_d = neighbors._distances(x, x, metric)
    for i in range(700):
        d = np.where((np.arange(700) % 7 == 0) == (i % 7 == 0), want_d[i], np.nan)
        d[i] = np.nan
        order = [j for j in np.lexsort((np.arange(700), d)) if not np.isnan(d[j])][:4]
        assert got[i] == [(j, d[j]) for j in order]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_tiles_keep_every_donor_within_reach(metric):
    """Offsets, equal distances and fewer donors than asked, against the comparison of all pairs."""
    import pandas as pd
    rng = np.random.default_rng(8)
    for m, n, k, make in ((300, 5000, 5, lambda s: rng.integers(0, 3, s)), (70, 4, 6, lambda s: rng.normal(size=s)),
                          (40, 4500, 3, lambda s: 1e7 + rng.normal(size=s)), (5, 20, 2, lambda s: np.zeros(s))):
        q, d = (pd.DataFrame({"key": np.arange(r), "target": -1, "payload": np.arange(r) * 2.0,
                              "vec": list(make((r, 9)).astype(float))}) for r in (m, n))
        one, all_ = (f(9, k, metric, True)(q, d).sort_values(["q_key", "distance", "d_key"]).reset_index(drop=True)
                     for f in (neighbors.tile_ranker, neighbors.chunk_ranker))
        pd.testing.assert_frame_equal(one, all_, check_dtype=False, check_exact=True)
