"""Readers of sheets and images, written splits, leftovers, fitted pipelines and searches."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorlens.operators import cleaning as C
from spoorlens.operators import evaluation as E
from spoorlens.operators import pairs as PR
from spoorlens.operators import preprocess as P
from spoorlens.operators import splits as S
from spoorlens.operators.quantiles import column_quantiles
from spoorlens.plans import pipelines as PL
from spoorlens.sources import sinks
from spoorlens.sources.readers import exif_texts, read_excel, read_images
from spoorlens.sources.stages import Stages


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Prints" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>trail</t></si><si><r><t>eo </t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>v1</t></is></c><c r="C1" t="str"><v>n</v></c><c r="D1" t="str"><v>ok</v></c><c r="E1" t="str"><v>mixed</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2"><v>3</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>7</v></c></row><row r="3"><c r="C3"><v>4</v></c><c r="E3" t="str"><v>x</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")


def test_sheets(spark, tmp_path):
    at = tmp_path / "prints.xlsx"
    workbook(at)
    df = read_excel(spark, f"file://{at}")
    assert dict(df.dtypes) == {"trail": "string", "v1": "double", "n": "bigint", "ok": "boolean", "mixed": "string"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("eo 1", 1.5, 3, True, "7"), (None, None, 4, None, "x")]
    assert read_excel(spark, f"file://{at}", "Other").count() == 0
    with pytest.raises(ValueError, match="Prints"):
        read_excel(spark, f"file://{at}", "none")


def jpeg(order):
    texts = {272: b"TrailCam 9\0", 306: b"2021:05:06 07:08:09\0"}
    at, body, entries = 8 + 2 + 12 * len(texts) + 4, b"", b""
    for tag, t in texts.items():
        entries += struct.pack(f"{order}HHII", tag, 2, len(t), at + len(body))
        body += t
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(texts)) + entries + struct.pack(f"{order}I", 0) + body
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def test_images(spark, tmp_path):
    folder = tmp_path / "cheetah" / "f" / "c1" / "c1_t1"
    folder.mkdir(parents=True)
    (folder / "a.jpg").write_bytes(jpeg("<"))
    (folder / "b.jpg").write_bytes(jpeg(">"))
    (folder / "c.jpg").write_bytes(b"no image")
    rows = {r["path"][-5:]: r for r in read_images(spark, f"file://{folder}/*.jpg").collect()}
    assert {r["individual_id"] for r in rows.values()} == {"c1"} and rows["c.jpg"]["taken_at"] is None
    for n in ("a.jpg", "b.jpg"):
        assert rows[n]["model"] == "TrailCam 9" and str(rows[n]["taken_at"]) == "2021-05-06 07:08:09"
    assert exif_texts(b"") == exif_texts(b"Exif\0\0II") == exif_texts(b"Exif\0\0xx" + bytes(40)) == {}


def test_flags_for_export(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert sorted(r[0] for r in df.select(sinks.export_tri_state("b")).collect()) == ["False", "True", "unknown"]


def prints(spark, n=60):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(n):
        i = k % 6
        sex = "fm"[i % 2]
        rows.append((k, f"i{i}", f"i{i}_t{k // 6 % 2}", sex, k % 3, *map(float, rng.normal(0, 1, 3) + (2 if sex == "m" else 0)), float(rng.normal())))
    return spark.createDataFrame(rows, "id long, individual_id string, trail string, sex string, fold int, a double, b double, c double, noise double")


FEATURES = ["a", "b", "c", "noise"]


def test_density_filter(spark):
    df = prints(spark)
    flagged = P.density_flags(df, "individual_id", "a", "b", percentile=0.2)
    assert flagged.count() == 60 and 0 < flagged.filter("outlier").count() <= 18
    out = P.iterative_density_filter(df, "individual_id", "a", "b")
    assert out.columns == df.columns and 0 < out.count() < 60
    one = spark.createDataFrame([(None, 1.0, 1.0), (None, 1.0, 1.0)], "g string, x double, y double")
    assert P.density_flags(one, "g", "x", "y").filter("not outlier").count() == 2


def test_leftovers_get_a_trail_of_their_individual(spark):
    rows = [(k, "a", f"a_t{k % 2}") for k in range(6)] + [(10 + k, "a", [None, "unknown", "Unknown "][k % 3]) for k in range(30)] + [(50, "b", None), (51, None, "x_t1"), (52, "unknown", None)]
    out = {r["id"]: r["trail"] for r in S.assigned_leftovers(spark.createDataFrame(rows, "id long, individual_id string, trail string")).collect()}
    assert len(out) == 39 and {out[10 + k] for k in range(30)} == {"a_t0", "a_t1"}
    assert out[50] is None and out[51] == "x_t1" and out[52] is None


def test_written_splits(spark, tmp_path):
    df = prints(spark).withColumn("species", F.lit("cheetah"))
    PL.write_splits(df, f"file://{tmp_path}/s")
    own = spark.read.parquet(f"file://{tmp_path}/s").groupBy("individual_id").agg(F.countDistinct("split").alias("n")).collect()
    assert len(own) == 6 and all(r["n"] == 1 for r in own)


@pytest.mark.parametrize("options", [dict(impute="mean", outliers="clip", scale="robust", reduce_pre="pca", select="variance", classify="lda"), dict(impute="median", scale="standard", select="forward", classify="logistic"), dict(scale="standard", select="lasso", reduce="lda", classify="lda_svd")])
def test_saved_pipelines_predict_the_same(spark, tmp_path, options):
    df = prints(spark)
    p = PL.FeaturePipeline(FEATURES, "sex", k=2, n_components=3, **options).fit(df)
    if options.get("select") == "forward":
        assert len(p.selected) == 2 and "noise" not in p.selected
    p.save(spark, f"file://{tmp_path}/p")
    again = PL.FeaturePipeline.load(spark, f"file://{tmp_path}/p")
    a, b = (x.apply(df).select("id", F.col("pred_sex").alias(n)) for x, n in ((p, "a"), (again, "b")))
    both = a.join(b, "id").collect()
    assert len(both) == 60 and all(r["a"] == r["b"] for r in both) and again.selected == p.selected


def test_steps_of_ones_own(spark):
    PL.register_step("scale", "halved", lambda pipe, df, cols: ([("halve", {"columns": list(cols)})], cols), "halve", lambda df, m: df.withColumns({c: F.col(c) / 2 for c in m["columns"]}))
    p = PL.FeaturePipeline(FEATURES, "sex", scale="halved").fit(prints(spark))
    a, b = prints(spark).agg(F.sum("a")).first()[0], p.apply(prints(spark)).agg(F.sum("a")).first()[0]
    assert b == pytest.approx(a / 2)
    with pytest.raises(ValueError):
        PL.register_step("odd", "x", None)


def test_searches(spark):
    assert len(PL.sampled_candidates({"a": [1, 2, 3], "b": [4, 5]}, 4)) == 4 and PL.sampled_candidates({"a": [1, 2], "b": [4]}, 9) == [{"a": 1, "b": 4}, {"a": 2, "b": 4}]
    assert PL.sampled_candidates({"a": range(50)}, 5, 1) == PL.sampled_candidates({"a": range(50)}, 5, 1)
    table, best = PL.classification_search(prints(spark), FEATURES, "sex", {"rank": ["univariate"], "k": [1, 3]}, ("lda_svd",), 5)
    rows = table.collect()
    assert len(rows) == 2 and all(0.6 < r["mean_accuracy"] <= 1 and r["mean_neg_log_loss"] < 0 for r in rows)
    got = {r["best_metric"]: r for r in best.collect()}
    assert set(got) == {*PL.SEARCH_SCORES, "mean_rank"}
    by = {r["candidate"]: r for r in rows}
    for m in PL.SEARCH_SCORES:
        assert got[m]["score"] == max(r[f"mean_{m}"] for r in rows) == by[got[m]["candidate"]][f"mean_{m}"]
    pairs = PL.pair_search(prints(spark), FEATURES, {"k_features": [2, 3], "reducer": ["lda"]}, 4).collect()
    assert [r["rank_no"] for r in pairs] == [1, 2] and pairs[0]["separation"] >= pairs[1]["separation"]


def test_predictions_of_all_splits(spark):
    df = prints(spark)
    out = PL.predict_all(df.filter("id < 45"), df.filter("id >= 45").withColumn("split", F.lit("test")), FEATURES, "sex")
    n = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("pred_sex").alias("n")).collect()}
    assert n == {"train": 45, "test": 15} and out.filter("proba_sex between 0 and 1").count() == 60


def test_left_out_prints(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4):
        for t in range(2):
            for _ in range(6):
                rows.append((len(rows), f"i{i}", f"i{i}_t{t}", *map(float, rng.normal(0, 1, 4) + 5 * np.eye(4)[i])))
    # one print of the first trail lies with another individual
    rows[0] = (0, "i0", "i0_t0", *map(float, 5 * np.eye(4)[2]))
    df = spark.createDataFrame(rows, "id long, individual_id string, trail string, a double, b double, c double, d double")
    out = PL.left_out_effect(df, ["a", "b", "c", "d"], "i0_t0", PL.PairConfig(k_features=3)).collect()
    assert len(out) == 6 and {r["footprint_id"] for r in out} == {str(k) for k in range(6)}
    assert all(0 <= r["bcr"] <= 1 for r in out) and [r["delta_bcr"] for r in out] == sorted([r["delta_bcr"] for r in out], reverse=True)
    alone = PL.left_out_effect(df.filter("trail = 'i0_t0' or individual_id <> 'i0'"), ["a", "b", "c", "d"], "i0_t0", PL.PairConfig(k_features=3)).collect()
    assert all(r["bcr"] is None for r in alone)


def test_sums_and_means_without_windows(spark):
    rows = [("x", float(k % 50), 1) for k in range(500)] + [("y", 2.0, 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "g string, o double, v int")
    by = df.filter("o is not null").groupBy("g", "o").agg(F.sum("v").alias("v"))
    got = {(r["g"], r["o"]): r["s"] for r in E.running_before(by, ["g"], "o", "v", "s", bins=7).collect()}
    assert got["y", 2.0] == 0 and all(got["x", float(k)] == 10 * k for k in range(50))
    means = {(r["g"], r["m"]) for r in C.with_group_mean(df, "v", ["g"], "m").collect()}
    assert means == {("x", 1.0), ("y", 3.0), (None, 4.0)}


def test_correlations_leave_out_what_is_missing(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1000, 1, (200, 3))
    x[:, 1] += x[:, 0]
    x[::7, 0] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 14 == 0 else float(v) for v in r) + (5.0,) for k, r in enumerate(x)], "a double, b double, c double, k double")
    got = {(r["a"], r["b"]): r["r"] for r in E.correlations(df, ["a", "b", "c", "k"]).collect()}
    ok = ~np.isnan(x[:, 0])
    assert got["a", "b"] == pytest.approx(np.corrcoef(x[ok, 0], x[ok, 1])[0, 1], abs=1e-6) and got["b", "c"] == pytest.approx(np.corrcoef(x[:, 1], x[:, 2])[0, 1], abs=1e-6)
    assert got["a", "k"] is None and E.correlations(df.limit(0), ["a", "b"]).collect() == []


def test_nearest_values_and_pairs_in_blocks(spark):
    t = spark.createDataFrame([("g", 1.0, 7), ("g", 3.0, 8), ("g", 3.0, 6), ("h", None, 1)], "k string, v double, w int")
    want = spark.createDataFrame([("g", 2.0, "t"), ("g", 0.0, "t"), ("g", 9.0, "t"), ("g", None, "t"), ("h", 1.0, "t"), ("g", 2.0, "t")], "k string, v double, w string")
    got = sorted(((r["k"], r["v"], r["nearest_v"], r["nearest_w"]) for r in PR.nearest_value(want, t, "v", ["k"]).collect()), key=str)
    assert got == sorted([("g", 2.0, 1.0, 7), ("g", 2.0, 1.0, 7), ("g", 0.0, 1.0, 7), ("g", 9.0, 3.0, 6), ("g", None, None, None), ("h", 1.0, None, None)], key=str)
    trails = PR.trail_table(prints(spark))
    many, few = (PR.trail_pairs(trails, blocks=b, samples=True) for b in (1, 5))
    assert many.count() == few.count() == 66 and "samples_a" in few.columns and "samples_a" not in PR.trail_pairs(trails).columns
    assert "CartesianProduct" not in few._jdf.queryExecution().executedPlan().toString()


def test_quantiles_in_passes(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=3001), np.round(rng.normal(size=3001) * 3), np.full(3001, 7.0), rng.exponential(size=3001) ** 6])
    x[::9, 0] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) + (None,) for k, r in enumerate(x)], "a double, b double, c double, d double, e double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    for few, bins in ((10**6, 16), (0, 16), (0, 1024)):
        got = column_quantiles(df, list("abcde"), probs, few, bins)
        for k, c in enumerate("abcd"):
            np.testing.assert_allclose(got[c], np.nanquantile(x[:, k], probs), rtol=1e-12)
        assert got["e"] == [None] * 6
    assert column_quantiles(df.limit(0), ["a"], [0.5], 0) == {"a": [None]}


def test_mean_ranks_codes_and_base_frame(spark):
    df = spark.createDataFrame([(1, "x", 3.0), (2, "x", 3.0), (3, "x", 1.0), (4, "x", None), (5, "y", None), (6, "y", 2.0), (7, None, 1.0)], "id int, g string, v double")
    up = {r["id"]: r["r"] for r in E.with_mean_rank(df, "v", ["g"], "r").collect()}
    down = {r["id"]: r["r"] for r in E.with_mean_rank(df, "v", ["g"], "r", ascending=False).collect()}
    assert up == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0, 5: 2.0, 6: 1.0, 7: None} and down == {1: 1.5, 2: 1.5, 3: 3.0, 4: 4.0, 5: 2.0, 6: 1.0, 7: None}
    assert {r["id"]: r["r"] for r in E.with_mean_rank(df.filter("g = 'x'"), "v", [], "r").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0}
    seen = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "id int, s string")
    out = C.with_codes(C.with_codes(seen, "s", "code"), "s", "seen", "id").collect()
    assert {r["id"]: (r["code"], r["seen"]) for r in out} == {1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (-1, -1)}
    hot = C.one_hot(seen, "s", ("a", "b")).orderBy("id").collect()
    assert [(r["s_a"], r["s_b"]) for r in hot] == [(0, 1), (1, 0), (0, 1), (0, 0)]
    base = C.base_frame(spark.createDataFrame([(1, "1,5", "k"), (2, "x", "k")], "id int, v1 string, o string"), ["v1"])
    assert dict(base.dtypes) == {"id": "string", "v1": "double", "o": "string"} and [r["v1"] for r in base.orderBy("id").collect()] == [1.5, None]
    with pytest.raises(ValueError):
        C.base_frame(spark.createDataFrame([(1, "1"), (1, "2")], "id int, v1 string"), ["v1"])


def test_coordinates_from_distances(spark):
    from spoorlens.operators import population as PO

    at = {f"t{k}": (float(k % 3), 2.0 * (k // 3)) for k in range(9)}
    rows = [(a, b, float(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]))) for a in at for b in at if a < b]
    s = PO.square_distances(spark.createDataFrame(rows, "a string, b string, d double"), [], "a", "b", "d")
    got = {r["trail"]: (r["x1"], r["x2"]) for r in PO.mds_points(s, []).collect()}
    assert all(np.hypot(got[a][0] - got[b][0], got[a][1] - got[b][1]) == pytest.approx(d) for a, b, d in rows)
    assert PO.isomap_points(s, [], neighbours=4).count() == 9


def test_stages_are_removed(spark):
    import os

    s = Stages(spark, "t")
    s.write(spark.range(3), "x")
    at = s.root.removeprefix("file://")
    assert os.listdir(at)
    s.close()
    assert not os.path.exists(at)
