"""Splits, preprocessing, pairs, projections, population, sources and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorlens.operators import cleaning as C
from spoorlens.operators import evaluation as E
from spoorlens.operators import pairs as PR
from spoorlens.operators import population as PO
from spoorlens.operators import preprocess as P
from spoorlens.operators import reduction as R
from spoorlens.operators import splits as S
from spoorlens.sources import readers, sinks
from spoorlens.streaming import incremental

D4 = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 1], [5, 5, 1, 0]], float)


def people(spark, n=40):
    rnd = random.Random(1)
    rows = [(k, f"i{k % n:02d}", rnd.choice(["F", "m", "unknown"]) if k >= n else "fm"[k % 2], f"t{k % (2 * n)}", rnd.gauss(10 * (k % 2), 2), rnd.gauss(0, 1), float(k % 7)) for k in range(10 * n)]
    return spark.createDataFrame(rows, "id long, individual_id string, sex string, trail string, v1 double, v2 double, v3 double")


# ------------------------------------------------------------------ cleaning
def test_names_and_roles(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "x", 3.0)], "` Print No` int, Animal string, `V1` double, `Trail ID` string, `v-1` double")
    assert C.with_normal_names(df).columns == ["print_no", "individual_id", "v1", "trail_id", "v_1"]
    f = spark.createDataFrame([(1, 2.0, 3.0, 4.0, "x", 5)], "id int, v1 double, AreaWidth double, DistMean double, trail string, extra int")
    assert C.feature_columns(f) == ["v1", "AreaWidth", "DistMean"]
    g = spark.createDataFrame([(1, 2, 3, 4, 5, 6.0, "x")], "a int, b int, c int, d int, e int, g double, h string")
    assert C.feature_columns(g) == ["g"]
    assert C.present(f, ["none", "AREAWIDTH"]) == "AreaWidth" and C.present(f, ["none"]) is None
    assert C.prefixed(f, "Dist") == ["DistMean"] and "fold" in C.with_case(f.withColumn("Fold", F.lit(1)), "fold").columns


def test_majority_numeric(spark):
    df = spark.createDataFrame([("1,5", "a", None), ("2", "b", None), ("3", "4", None), ("4", "c", None), ("x", "d", None)], "a string, b string, c string")
    out = C.majority_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"} and [r[0] for r in out.select("a").collect()] == [1.5, 2.0, 3.0, 4.0, None]
    assert C.majority_numeric(df.limit(0)).dtypes == df.dtypes


def test_running_id(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(1000), 500)], "x int")
    got = C.running_id(df, ["x"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(500)) and [r["x"] for r in got] == sorted(r["x"] for r in got)
    assert C.running_id(df.limit(0), ["x"]).collect() == []


# ------------------------------------------------------------------ splits
def test_splits_keep_individuals(spark):
    df = people(spark)
    out = S.stratified_split(df)
    assert out.groupBy("individual_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "test"}
    again = S.stratified_split(df.repartition(7))
    assert sorted(map(tuple, out.select("id", "split").collect())) == sorted(map(tuple, again.select("id", "split").collect()))
    half = S.group_split(df, "individual_id", 0.25)
    n = {r[0]: r[1] for r in half.groupBy("split").agg(F.countDistinct("individual_id")).collect()}
    assert n == {"train": 30, "test": 10}


def test_folds(spark):
    df = people(spark)
    own = S.individuals(df)
    folds = S.stratified_folds(own)
    assert folds.groupBy("individual_id").count().filter("count > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5
    out, how = S.make_folds(df.drop("sex").join(own, "individual_id"))
    assert how == "stratified" and S.folds_valid(out)
    assert S.make_folds(out)[1] == "existing"
    with pytest.raises(ValueError):
        S.stratified_folds(own.limit(1))


def test_holdouts_chunks_and_subsamples(spark):
    df = people(spark, 10)
    h = S.sequential_holdouts(df, (1, 4, 99), 2)
    assert {(r[0], r[1]): r[2] for r in h.groupBy("iteration", "n_val").count().collect()} == {(i, s): c for i in (0, 1) for s, c in ((1, 2), (4, 4), (99, 9))}
    with pytest.raises(ValueError):
        S.sequential_holdouts(df.filter("individual_id in ('i00', 'i01')"), (2,), 1)
    c = S.chunk_trails(df, 4)
    assert {r[0] for r in c.filter("new_trail is not null").groupBy("new_trail").count().select("count").collect()} == {4}
    assert c.filter("new_trail is null").count() == 20
    d = S.diverse_subsamples(df, (2, 3), candidates=6, keep=2)
    assert all(len(r["samples"]) == r["size"] and r["sub_trail"] == f"{r['trail']}_sub{r['size']}_sample{r['sample']}" for r in d.collect())
    assert d.groupBy("trail", "size").count().agg(F.max("count")).first()[0] <= 2


def test_origin_split_triplets_and_pairs(spark):
    df = people(spark, 12).withColumn("dataorigin", F.element_at(F.array(*map(F.lit, "abc")), (F.substring("individual_id", 2, 2).cast("int") % 3 + 1)))
    out = S.origin_split(df, ["a"], ["b"], [("c", "m", 1)])
    assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "test", "inference"}
    t = S.triplets(df, "individual_id", "id").collect()
    ind = {r["id"]: r["individual_id"] for r in df.collect()}
    assert len(t) == 120 and all(ind[r["anchor"]] == ind[r["positive"]] != ind[r["negative"]] and r["anchor"] != r["positive"] for r in t)
    p = S.random_pairs(df, "id", 200).collect()
    assert len(p) == 200 and all(r["a"] != r["b"] for r in p)


# ------------------------------------------------------------------ preprocessing
def test_scaling_and_clipping_match_numpy(spark):
    df = people(spark)
    x = np.array([r["v1"] for r in df.select("v1").collect()])
    clip = P.fit_clip(df, ["v1"], 0.05, 0.95).first()
    np.testing.assert_allclose([clip["lo"], clip["hi"]], np.quantile(x, [0.05, 0.95]))
    z = P.fit_standard(df, ["v1", "v3"]).filter("feature = 'v1'").first()
    np.testing.assert_allclose([z["centre"], z["scale"]], [x.mean(), x.std()])
    same = df.withColumn("v1", F.lit(2.0))
    assert P.apply_scale(same, P.fit_standard(same, ["v1"])).agg(F.max("v1"), F.min("v1")).first() == (0.0, 0.0)
    with pytest.raises(ValueError):
        P.fit_outliers(df, ["v1"], "iqr")
    gaps = df.withColumn("v1", F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).when(F.col("id") % 9 > 1, F.col("v1")))
    assert P.apply_fill(gaps, P.fit_median(gaps.filter("not isnan(v1)"), ["v1"])).filter("v1 is null or isnan(v1)").count() == 0


def test_rankings(spark):
    df = people(spark).withColumn("g", (F.col("id") % 2).cast("string"))
    assert P.rank_univariate(df, ["v2", "v1", "v3"], "g").orderBy("rank_no").first()["feature"] == "v1"
    assert P.rank_variance(df, ["v2", "v1"]).orderBy("rank_no").first()["feature"] == "v1"
    assert [r["feature"] for r in P.rank_none(df, ["v2", "v1"]).orderBy("rank_no").collect()] == ["v2", "v1"]
    assert P.rank_mutual_information(df, ["v2", "v1"], "g").orderBy("rank_no").first()["feature"] == "v1"
    assert P.forward_selection(df, ["v2", "v1", "v3"], "g", 2).filter("rank_no = 1").first()["feature"] == "v1"
    assert P.select_features(df, P.rank_variance(df, ["v2", "v1"]), 1, ["id", "none"]).columns == ["id", "v1"]


def test_anova_matches_formula(spark):
    rng = np.random.default_rng(0)
    groups = [rng.normal(m, 1, n) for m, n in ((0, 8), (1, 5), (3, 9))]
    rows = [("x", str(k), float(v)) for k, g in enumerate(groups) for v in g] + [("x", "0", None), ("x", None, 1.0)]
    got = E.anova(spark.createDataFrame(rows, "feature string, g string, value double"), "g").first()["f"]
    every = np.concatenate(groups)
    ssb = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert abs(got - (ssb / 2) / (ssw / (len(every) - 3))) < 1e-9


# ------------------------------------------------------------------ pairs
def test_pairs_of_trails(spark):
    rows = [(0, "A", "a1", "f", 1, "mud"), (1, "A", "a1", "f", 1, "sand"), (2, "A", "a2", "unknown", None, "sand"), (3, "B", "b1", "m", 0, None), (4, "unknown", "c1", "m", 0, "mud"), (5, "A", "a1_sub2_sample1", "f", 1, "mud"), (6, "B", "unknown", "m", 0, "mud"), (7, "B", None, "m", 0, "mud")]
    df = spark.createDataFrame(rows, "id long, individual_id string, trail string, sex string, fold int, substrate string")
    t = PR.trail_table(df, substrate="substrate")
    assert {r["trail_id"]: (r["ind"], r["sex"], r["substrate"]) for r in t.collect()} == {"a1": ("A", "f", "mud"), "a2": ("A", None, "sand"), "b1": ("B", "m", None), "c1": (None, "m", "mud"), "a1_sub2_sample1": ("A", "f", "mud")}
    p = {(r["trail_a_id"], r["trail_b_id"]): r for r in PR.trail_pairs(t).collect()}
    assert len(p) == 9 and ("a1", "a1_sub2_sample1") not in p
    assert p["a1", "a2"]["same_individual"] is True and p["a1", "b1"]["same_individual"] is False and p["a1", "c1"]["same_individual"] is None
    assert p["a1", "a2"]["same_sex"] is None and p["a1", "b1"]["fold"] == 1


def test_joins(spark):
    left = spark.createDataFrame([(1, 5, 0), (2, 6, 0)], "id int, x int, pred_a int")
    preds = spark.createDataFrame([(1, 7, 8)], "id int, pred_a int, other int")
    assert [tuple(r) for r in PR.merged_predictions(left, preds).orderBy("id").collect()] == [(1, 5, 7), (2, 6, None)]
    with pytest.raises(ValueError):
        PR.validated_join(left, preds.union(preds), ["id"])
    base = spark.createDataFrame([("10",), ("20",)], "id string")
    got = PR.resolved_ids(spark.createDataFrame([("20",), ("0",)], "r string"), base, "r", "id")
    assert {r["r"]: r["resolved"] for r in got.collect()} == {"20": "20", "0": "10"}
    with pytest.raises(Exception, match="no such id"):
        PR.resolved_ids(spark.createDataFrame([("zz",)], "r string"), base, "r", "id").collect()
    near = PR.nearest_value(spark.createDataFrame([("k", 1.4), ("none", 1.0)], "g string, c double"), spark.createDataFrame([("k", 1.0, 5), ("k", 1.8, 6)], "g string, c double, v int"), "c", ["g"])
    assert {r["g"]: r["nearest_v"] for r in near.collect()} == {"k": 5, "none": None}


# ------------------------------------------------------------------ population
def optimal_cutoff(spark, d, k):
    one = spark.createDataFrame([(PO.heights(d), len(d), k)], "heights array<double>, n int, k int")
    return tuple(one.select(PO.cutoff_range(F.col("heights"), F.col("n"), F.col("k")).alias("c")).first()["c"])


def test_ward_of_four(spark):
    h = PO.heights(D4)
    np.testing.assert_allclose(h[:2], [1, 1])
    # joined pairs: Lance-Williams by hand
    q = D4**2
    step = lambda i: ((2 * q[0, i] + 2 * q[1, i] - q[0, 1]) / 3)
    last = ((2 + 1) * step(2) + (2 + 1) * step(3) - 2 * 1) / 4
    np.testing.assert_allclose(h[2], math.sqrt(last))
    assert PO.cluster_count(D4, 1.0) == 2 and PO.cluster_count(D4, 0.5) == 4 and PO.cluster_count(D4, 99) == 1
    assert PO.silhouette_count(D4) == 2
    cut, lo, hi = optimal_cutoff(spark, D4, 2)
    assert PO.cluster_count(D4, cut) == 2 and lo < cut < hi
    assert optimal_cutoff(spark, D4, 4)[0] == 0.5 and optimal_cutoff(spark, D4, 1)[0] == pytest.approx(h[2])
    for k in (0, 5):
        with pytest.raises(Exception, match="out of range"):
            optimal_cutoff(spark, D4, k)
    with pytest.raises(ValueError):
        PO.silhouette_count(D4[:2, :2])
    assert PO.heights(np.zeros((1, 1))) == []


def test_population_of_groups(spark):
    rows = [(g, f"t{i}", f"t{j}", float(D4[i, j])) for g in ("x", "y") for i in range(4) for j in range(i)] + [("x", "t0", "t1", None), ("z", "a", "b", float("nan"))]
    pairs = spark.createDataFrame(rows, "g string, a string, b string, d double")
    sq = PO.square_distances(pairs, ["g"], "a", "b", "d")
    link = PO.merge_heights(sq.filter("g <> 'z'"), ["g"])
    assert {r["g"]: r["pred_count"] for r in PO.counts_at(link, F.lit(1.0)).collect()} == {"x": 2, "y": 2}
    cut = link.withColumn("c", PO.cutoff_range(F.col("heights"), F.col("n"), F.lit(2))).first()["c"]
    h = PO.heights(D4)
    np.testing.assert_allclose(tuple(cut), [h[1] + (h[2] - h[1]) * x for x in (0.5, 0.25, 0.75)])
    assert [(r["g"], r["pred_count"], r["erd"]) for r in PO.reevaluated(link.withColumn("true_count", F.lit(2)), ["g"], 1.0).orderBy("g").collect()] == [("x", 2, 0.0), ("y", 2, 0.0)]
    with pytest.raises(Exception, match="out of range"):
        link.select(PO.cutoff_range(F.col("heights"), F.col("n"), F.lit(9))).collect()
    assert {r["g"]: r["pred_count"] for r in PO.silhouette_counts(sq.filter("g <> 'z'"), ["g"]).collect()} == {"x": 2, "y": 2}
    labels = PO.cluster_labels(sq.filter("g = 'x'"), [], [0.5, 1.0])
    truth = spark.createDataFrame([("t0", "A"), ("t1", "A"), ("t2", "B"), ("t3", "B")], "trail string, individual string")
    s = {r["cutoff"]: r for r in PO.cutoff_sweep(labels, truth, []).collect()}
    assert s[1.0]["erd"] == 0 and abs(s[1.0]["score"] - 1) < 1e-9 and s[0.5]["pred_count"] == 4
    holes = PO.complete_trails(PO.square_distances(pairs.filter("g = 'x' and not (a = 't3' and b = 't0')"), ["g"], "a", "b", "d"), ["g"])
    assert {r["i"] for r in holes.select("i").distinct().collect()} == {"t1", "t2"}


def slow_ward(d):
    """Merges by the smallest distance of all, step by step."""
    q, size, out = {(i, j): d[i, j] ** 2 for i in range(len(d)) for j in range(i)}, [1] * len(d), []
    at = lambda x, y: q[max(x, y), min(x, y)]
    live = list(range(len(d)))
    while len(live) > 1:
        h, i, j = min((at(x, y), y, x) for k, x in enumerate(live) for y in live[:k])
        out.append(math.sqrt(max(h, 0)))
        for m in live:
            if m not in (i, j):
                q[max(m, i), min(m, i)] = ((size[i] + size[m]) * at(m, i) + (size[j] + size[m]) * at(m, j) - size[m] * h) / (size[i] + size[j] + size[m])
        size[i] += size[j]
        live.remove(j)
    return sorted(out)


def test_chains_of_neighbours_give_the_same_linkage():
    rng = np.random.default_rng(2)
    for n in (2, 3, 7, 25):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
        np.testing.assert_allclose(PO.heights(d), slow_ward(d))
        # labels at every height are nested and as many as merges are left out
        for k, h in enumerate(PO.heights(d)):
            assert PO.cluster_count(d, h + 1e-9) == n - k - 1
    assert PO.heights(np.zeros((5, 5))) == [0.0] * 4
    with pytest.raises(ValueError):
        PO.ward(np.zeros((PO.MOST_TRAILS + 1, 2)))


def test_full_sweep(spark):
    rng = np.random.default_rng(4)
    rows = []
    for origin, fold in (("cv", 0), ("cv", 1), ("test", None)):
        at = {f"{origin}{fold}_i{k}_t{t}": (f"i{k}", 3.0 * k + rng.normal(0, 0.1)) for k in range(4) for t in range(3)}
        names = sorted(at)
        rows += [(origin, fold, a, b, at[a][0], at[b][0], abs(at[a][1] - at[b][1]), None if a.endswith("i0_t0") and b.endswith("i1_t0") else 0.01 * abs(at[a][1] - at[b][1])) for k, b in enumerate(names) for a in names[:k]]
    pairs = spark.createDataFrame(rows, "origin string, fold int, trail_a_id string, trail_b_id string, ind_a string, ind_b string, dist_x double, dist_y double")
    curves = PO.sweep_curves(pairs, ["origin", "fold"], ["dist_x", "dist_y"])
    assert curves.count() == 3 * 2 * 2 * 38
    got = {(r["dist"], r["prep"]): r for r in PO.sweep_benchmark(curves, []).collect()}
    best = got["dist_x", "raw"]
    assert best["cv_score"] == pytest.approx(1) and best["test_v"] == pytest.approx(1) and best["test_pred_count"] == 4 and best["test_erd"] == 0
    assert got["dist_y", "raw"]["cv_score"] < 1 and got["dist_y", "minmax"]["cv_score"] > got["dist_y", "raw"]["cv_score"]
    # a trail without a distance to all others takes no part
    assert {r["true_count"] for r in curves.filter("dist = 'dist_y'").collect()} == {4} and curves.filter("dist = 'dist_y' and cutoff = 0.4 and prep = 'minmax'").agg(F.max("pred_count")).first()[0] <= 10


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1), (None, 1, 0.5)], "t int, p int, s double")
    c = E.confusion(df, "t", "p").first()
    assert (c["tp"], c["fn"], c["fp"], c["tn"], c["bcr"]) == (1, 1, 0, 2, 0.75)
    assert E.confusion(df.filter("t = 1"), "t", "p").first()["bcr"] is None
    assert E.roc_auc(df, "t", "s").first()["auc"] == 0.875
    assert df.filter("t is not null").agg(E.concordance("t", "t")).first()[0] == 1
    with pytest.raises(Exception, match="positive"):
        df.select(E.relative_difference("p", F.lit(0))).collect()
    assert E.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").first()["n"] == 2


def test_projections(spark):
    df = people(spark).withColumn("g", (F.col("id") % 2).cast("string"))
    cols = ["v1", "v2", "v3"]
    x = np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()])
    model = R.fit_pca(df, cols, 2)
    np.testing.assert_allclose(model["variance"], np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])
    assert R.fit_pca(df, cols, None, 0.98)["axes"].shape[1] <= 3
    pred = R.lda_predict(R.project(df, R.fit_lda(df, cols, "g", 5)), R.fit_lda(df, cols, "g"), "pred")
    assert "LDA1" in pred.columns and "LDA2" not in pred.columns and pred.filter("pred = g").count() > 0.95 * pred.count()
    with pytest.raises(ValueError):
        R.fit_reducer(df, cols, "umap")
    np.testing.assert_allclose(sorted(abs(R.classical_mds(np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0))), 1)[:, 0])), [0.5, 0.5, 1.5, 1.5], atol=1e-9)
    assert R.isomap(x[:12], 2, 3).shape == (12, 2)


# ------------------------------------------------------------------ sources
def test_folder_and_splits(spark, tmp_path):
    for name, rows in (("red fox", ["a,1", "b,2"]), ("otter", ["c,3"])):
        (tmp_path / f"{name}.csv").write_text("Animal,v 1\n" + "\n".join(rows) + "\n")
    (tmp_path / "notes.txt").write_text("x")
    got = readers.read_folder(spark, f"{tmp_path}/*.csv", "Animal string, v int", add_id=True).collect()
    assert sorted(r["id"] for r in got) == ["otter_1", "red_fox_1", "red_fox_2"]
    raw = readers.read_raw_tables(spark, f"{tmp_path}/*.csv", "Animal string, v int")
    assert raw.columns[0] == "id" and sorted(r["id"] for r in raw.collect()) == [0, 1, 2] and "individual_id" in raw.columns
    assert readers.discover_splits(["/d/otter/train.parquet", "/d/red_fox_test.parquet", "/d/x.csv"]) == {"otter": {"train": "/d/otter/train.parquet"}, "red_fox": {"test": "/d/red_fox_test.parquet"}}
    with pytest.raises(ValueError):
        readers.load_split(spark, "x.csv")
    with pytest.raises(ValueError):
        readers.require(raw, "sex")
    with pytest.raises(ValueError):
        readers.merge_masters({}, "cv")


def test_annotations(spark, tmp_path):
    import json

    for k in range(2):
        marks = [{"x": float(i + k), "y": 0.0, "visible": True} for i in range(11)]
        (tmp_path / f"{k}.json").write_text(json.dumps({"image_path": f"{k}.jpg", "landmarks": marks, "metadata": {"a": "b"}}, indent=1))
    df = readers.read_annotations(spark, str(tmp_path), {"w": ("distance", (1, 12))})
    assert sorted((r["image_path"], r["w"]) for r in df.collect()) == [("0.jpg", 0.5), ("1.jpg", 0.5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1]), (1, "a", [2]), (2, "b", [3])], "k int, s string, l array<int>")
    assert sinks.merged(None, df).count() == 2
    made = []
    at = f"{tmp_path}/t"
    for _ in range(2):
        out = sinks.reuse(spark, at, lambda: made.append(1) or df)
    assert out.count() == 3 and made == [1]
    sinks.append_csv(df.select("k", "s"), f"{tmp_path}/c")
    sinks.append_csv(df.select("k", "s"), f"{tmp_path}/c")
    assert readers.read_csv(spark, f"{tmp_path}/c").count() == 6
    sinks.add_part(df.select("k", "s"), f"{tmp_path}/p", ["k"])
    sinks.add_part(df.filter("k = 1").select("k", "s"), f"{tmp_path}/p", ["k"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3
    left = sinks.unfinished(df.select("k").distinct(), spark.read.parquet(f"{tmp_path}/p").filter("k = 1"), ["k"])
    assert [r[0] for r in left.collect()] == [2]


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, s string").write.parquet(src)
    for n in range(2):
        s = spark.readStream.schema("k int, s string").parquet(src)
        incremental.append_new(s, out, ["k"], f"{tmp_path}/ck{n}").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [1, 2]


# ------------------------------------------------------------------ pipelines
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4):
        for t in range(2):
            for _ in range(5):
                v = rng.normal(0, 1, 4) + 6 * np.eye(4)[i]
                rows.append((len(rows), f"i{i}", f"i{i}_t{t}", "fm"[i % 2], i % 2, *map(float, v)))
    return spark.createDataFrame(rows, "id long, individual_id string, trail string, sex string, fold int, a double, b double, c double, d double")


def test_projected_pairs_part_individuals(spark):
    from spoorlens.plans import pipelines as PL

    df, cols = vectors(spark), ["a", "b", "c", "d"]
    pairs = PR.trail_pairs(PR.trail_table(df)).select("trail_a_id", "trail_b_id", "same_individual")
    out = PL.overlap_predictions(PL.project_pairs(pairs, df, cols, PL.PairConfig(k_features=3)))
    rows = out.collect()
    assert len(rows) == 28 and all(len(r["selected_features"]) == 3 and len(r["coords_a"]) == 5 for r in rows)
    mean = lambda same: np.mean([r["dist_euclidean"] for r in rows if r["same_individual"] is same])
    assert mean(False) > 2 * mean(True)
    got = E.confusion(out.withColumn("t", F.col("same_individual").cast("int")), "t", "pred_same").first()
    assert got["bcr"] > 0.9
    # a pair's rest needs two rows
    few = df.filter("trail in ('i0_t0', 'i1_t0')")
    assert PL.project_pairs(pairs.filter("trail_a_id = 'i0_t0' and trail_b_id = 'i1_t0'"), few, cols).collect() == []
    for wrong in ({"reducer": "umap"}, {"selection": "forwards"}, {"scaler": "odd"}):
        with pytest.raises(ValueError):
            PL.PairConfig(**wrong)


def test_pair_record_in_full(spark):
    """Distances within and between in reduced coordinates, sums in place of rows, probabilities of a sex model."""
    from spoorlens.plans import pipelines as PL

    cols = ["a", "b", "c", "d"]
    df = vectors(spark).withColumns({"proba_0": F.col("id") / 100, "proba_1": 1 - F.col("id") / 100})
    pairs = PR.trail_pairs(PR.trail_table(df)).select("trail_a_id", "trail_b_id")
    config = PL.PairConfig(k_features=2)
    rows = PL.project_pairs(pairs, df, cols, config, proba=["proba_0", "proba_1"]).collect()
    one = rows[0]
    a, b = np.array(one["coords_a"]), np.array(one["coords_b"])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=-1))
    w = np.array([np.abs(a[i] - a[j]).sum() for i in range(len(a)) for j in range(i)])
    assert one["mean_euclidean_between"] == pytest.approx(d.mean()) and one["median_euclidean_between"] == pytest.approx(np.median(d))
    assert one["mean_manhattan_within_a"] == pytest.approx(w.mean()) and one["median_manhattan_within_a"] == pytest.approx(np.median(w))
    assert (one["min_observations"], one["max_observations"]) == (5, 5) and len(one["selected_features"]) == 2 and len([c for c in one.asDict() if c.startswith(("mean_", "median_"))]) == 36
    ids = {r["trail"]: r["m"] for r in df.groupBy("trail").agg(F.avg("proba_0").alias("m")).collect()}
    assert one["avg_proba_A_0"] == pytest.approx(ids[one["trail_a_id"]]) and one["avg_proba_A_1"] == pytest.approx(1 - ids[one["trail_a_id"]])
    rest = [v for t, v in ids.items() if t not in (one["trail_a_id"], one["trail_b_id"])]
    assert one["avg_proba_R_0"] == pytest.approx(np.mean(rest))
    short = {(r["trail_a_id"], r["trail_b_id"]): r for r in PL.project_pairs(pairs, df, cols, config, proba=["proba_0", "proba_1"], full=False).collect()}
    assert "coords_a" not in short[one["trail_a_id"], one["trail_b_id"]].asDict()
    for r in rows:
        assert short[r["trail_a_id"], r["trail_b_id"]]["dist_euclidean"] == pytest.approx(r["dist_euclidean"], rel=1e-6)
    with pytest.raises(ValueError):
        PL.project_pairs(pairs, df, cols, PL.PairConfig(selection="lasso"), full=False)


@pytest.mark.parametrize("selection", ["forward", "univariate", "variance", "lasso", "random_forest", "none"])
def test_selection_of_a_pair_finds_what_parts_it(spark, selection):
    from spoorlens.plans import pipelines as PL

    df, cols = vectors(spark), ["a", "b", "c", "d"]
    pairs = PR.trail_pairs(PR.trail_table(df)).filter("trail_a_id = 'i0_t0' and trail_b_id = 'i1_t0'").select("trail_a_id", "trail_b_id")
    r = PL.project_pairs(pairs, df, cols, PL.PairConfig(k_features=2, selection=selection)).first()
    assert len(r["selected_features"]) == (4 if selection == "none" else 2)
    # trails of the first and second individual differ in their first and second measurement
    if selection in ("univariate", "variance", "random_forest"):
        assert set(r["selected_features"]) == {"a", "b"}
    assert r["selected_features"][0] in ("a", "b")


def test_kernels_of_few_rows():
    from spoorlens.operators.kernels import forest_importances, lasso_cv

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    y = 2 * x[:, 3] - x[:, 6] + rng.normal(0, 0.1, 60)
    w = lasso_cv(x, y)
    assert set(np.argsort(-np.abs(w))[:2]) == {3, 6} and abs(w[3] - 2) < 0.1
    assert not lasso_cv(np.zeros((9, 2)), y[:9]).any()
    imp = forest_importances(x, (x[:, 1] > 0).astype(int), trees=20)
    assert imp.argmax() == 1 and imp.sum() == pytest.approx(1)
    assert not forest_importances(x, np.zeros(60, int), trees=3).any()


def test_forward_selection_on_moments_agrees_with_rows(spark):
    from spoorlens.operators.kernels import forward_moments

    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 5))
    g = np.repeat([0, 1, 2], 20)
    x[:, 2] += 3 * g
    x[:, 4] -= g
    x -= x.mean(axis=0)
    within = sum((x[g == k] - x[g == k].mean(axis=0)).T @ (x[g == k] - x[g == k].mean(axis=0)) for k in range(3))
    a = [i for i, _ in forward_moments(within, x.T @ x, 60, 3, 3)]
    b = [i for i, _ in P.forward_order(x, g, 3)]
    assert a == b


def test_classification_pipelines(spark):
    from spoorlens.plans import pipelines as PL

    df, cols = vectors(spark), ["a", "b", "c", "d"]
    f = df.withColumn("fold", F.col("id").cast("int") % 2)
    pred = PL.fold_predictions(f, cols, "sex")
    assert pred.count() == 40 and PL.classification_report(pred, "sex").first()["accuracy"] > 0.8
    pipe = PL.FeaturePipeline(cols, "sex", k=3, impute="mean", outliers="clip", scale="standard", select="variance", reduce="pca", classify="lda")
    assert "pred_sex" in pipe.fit(df).apply(df).columns
    with pytest.raises(ValueError):
        PL.FeaturePipeline(cols, "sex", scale="odd")
    with pytest.raises(ValueError):
        PL.FeaturePipeline(cols, "sex", odd="scale")


def test_sequential_holdout(spark):
    from spoorlens.plans import pipelines as PL

    table, summary = PL.sequential_holdout(vectors(spark), ["a", "b", "c", "d"], (2, 3), 2, PL.PairConfig(k_features=3))
    rows = table.collect()
    assert len(rows) == 4 and all(0 <= r["bcr"] <= 1 and r["true_count"] == r["n_val"] for r in rows)
    assert summary.first()["erd"] is not None


def test_forest_imputation(spark):
    df = spark.createDataFrame([(k, float(k % 10), None if k % 13 == 0 else 2.0 * (k % 10)) for k in range(120)], "id long, x double, y double")
    out = P.iterative_impute(df, ["x", "y"], "id", trees=5, rounds=2)
    err = out.filter("id % 13 = 0").agg(F.max(F.abs(F.col("y") - 2 * F.col("x")))).first()[0]
    assert out.columns == df.columns and out.filter("y is null").count() == 0 and err < 4
