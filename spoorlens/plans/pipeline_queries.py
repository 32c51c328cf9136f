"""Queries of composed pipelines, projections, rankings and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.distances import METRICS
from ..functions.labels import label_form
from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import pairs as PR
from ..operators import population as PO
from ..operators import preprocess as P
from ..operators import reduction as R
from ..operators import splits as S
from ..sources.readers import image_paths
from ..sources.stages import Stages
from ..streaming.incremental import pair_counts, sessions, tumbling
from . import pipelines as PL
from .registry import query, table
from .relational_queries import fp, mp, r6
from .sqltext import EMB, FP, MP, base_sql, label_sql
from .statistics_queries import CONF, DEC, decisions, emb

MEASURES = list(C.MEASURES)
DIMS = [f"f{k}" for k in range(64)]


def known_sex(spark, d):
    """Prints of known sex and individual, with folds dealt to individuals."""
    f = fp(spark, d).filter("sex in ('f', 'm') and individual_id not in ('unknown', '')").drop("fold", "split")
    own = S.individuals(f)
    folds = S.stratified_folds(own.withColumnRenamed("sex", "stratum"), "individual_id", "stratum").select("individual_id", "fold")
    return f.drop("sex").join(own, "individual_id").join(folds, "individual_id")


def flat_emb(spark, d):
    """The vectors with a column for each dimension."""
    return emb(spark, d).select("id", "individual_id", "trail", "sex", "fold", *[F.col("vec")[k].alias(c) for k, c in enumerate(DIMS)])


# ------------------------------------------------------------------ reports
@query("ag03_split_counts", f"WITH {FP} SELECT split, sex, count(*) AS n_rows, count(DISTINCT individual_id) AS n_individuals, count(DISTINCT trail) AS n_trails FROM fp GROUP BY ALL")
def ag03(spark, d):
    return fp(spark, d).groupBy("split", "sex").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("individual_id").alias("n_individuals"), F.countDistinct("trail").alias("n_trails"))


@query("ag11_trail_stats", f"WITH {FP}, t AS (SELECT species, trail, count(*) AS n, count(v1) AS held FROM fp WHERE trail <> 'unknown' GROUP BY ALL) SELECT species, sum(n)::BIGINT AS n_prints, sum(held)::BIGINT AS n_held, round(avg(n), 6) AS mean_prints FROM t GROUP BY species")
def ag11(spark, d):
    t = C.known_trails(fp(spark, d)).groupBy("species", "trail").agg(F.count(F.lit(1)).alias("n"), F.count("v1").alias("held"))
    return t.groupBy("species").agg(F.sum("n").alias("n_prints"), F.sum("held").alias("n_held"), r6(F.avg("n"), "mean_prints"))


@query("ag15_experiment_means", f"WITH {DEC}, c AS (SELECT pipeline, tag, {CONF} FROM dec GROUP BY ALL) SELECT pipeline, round(avg((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp_, 0)) / 2), 6) AS bcr, count(*) AS n_tags FROM c GROUP BY pipeline")
def ag15(spark, d):
    c = E.confusion(decisions(spark, d), "t", "p", ["pipeline", "tag"])
    return c.groupBy("pipeline").agg(r6(F.avg("bcr"), "bcr"), F.count(F.lit(1)).alias("n_tags"))


@query("ag23_filter_report", f"WITH {FP}, b AS (SELECT count(*) AS n_before FROM fp), p AS (SELECT individual_id, count(*) AS n FROM fp WHERE area1 > 4000 GROUP BY ALL) SELECT n_before, sum(n)::BIGINT AS n_after, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, count(*) FILTER (n < 3) AS n_small, (n_before - sum(n))::BIGINT AS n_removed FROM b, p GROUP BY n_before")
def ag23(spark, d):
    f = fp(spark, d)
    r = P.filter_report(f, f.filter("area1 > 4000"), "individual_id")
    return r.select("n_before", "n_after", "least", "most", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "n_small", "n_removed")


@query("ag26_ordered_means", f"WITH {FP}, m AS (SELECT individual_id, sex, round(avg(area1), 6) AS mean_area FROM fp WHERE sex <> 'unknown' AND area1 IS NOT NULL GROUP BY ALL) SELECT individual_id, sex, mean_area, row_number() OVER (ORDER BY sex, CASE WHEN sex = 'f' THEN -mean_area ELSE mean_area END, individual_id) AS place FROM m")
def ag26(spark, d):
    m = fp(spark, d).filter("sex <> 'unknown' and area1 is not null").groupBy("individual_id", "sex").agg(r6(F.avg("area1"), "mean_area"))
    m = m.withColumn("k", F.when(F.col("sex") == "f", -F.col("mean_area")).otherwise(F.col("mean_area")))
    return C.running_id(m, ["sex", "k", "individual_id"], "place", 1).drop("k")


@query("ag27_mean_probability", f"WITH {FP} SELECT individual_id, round(avg(area1 / 10000), 6) AS mean_proba, min_by(sex, id) FILTER (sex <> 'unknown') AS first_sex FROM fp WHERE area1 IS NOT NULL GROUP BY individual_id")
def ag27(spark, d):
    f = fp(spark, d).filter("area1 is not null")
    first = F.min_by("sex", F.when(F.col("sex") != "unknown", F.col("id")))
    out = f.groupBy("individual_id").agg(r6(F.avg(F.col("area1") / 10000), "mean_proba"), first.alias("first_sex"))
    return out.withColumn("first_sex", F.when(F.col("first_sex") != "unknown", F.col("first_sex")))


@query("ag31_inference_counts", f"WITH {FP} SELECT dataorigin, regexp_extract(trail, '(\\d+)$', 1) AS trail_no, count(*) FILTER (sex = 'f') AS f, count(*) FILTER (sex = 'm') AS m FROM fp WHERE split = 'inference' GROUP BY ALL")
def ag31(spark, d):
    f = fp(spark, d).filter("split = 'inference'").groupBy("dataorigin", F.regexp_extract("trail", r"(\d+)$", 1).alias("trail_no"))
    return f.agg(F.count_if(F.col("sex") == "f").alias("f"), F.count_if(F.col("sex") == "m").alias("m"))


@query(
    "ag33_print_quality",
    f"""WITH {DEC}, q AS (SELECT t, (t = p)::INT AS correct, CASE WHEN exp(-euclidean / 9) > 0.9 THEN 'High' WHEN exp(-euclidean / 9) > 0.7 THEN 'Moderate' ELSE 'Low' END AS quality FROM dec),
    g AS (SELECT * FROM (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(correct), (VALUES ('High'), ('Moderate'), ('Low')) c(quality)) SELECT g.t, g.correct, g.quality, count(q.t) AS n FROM g LEFT JOIN q ON g.t = q.t AND g.correct = q.correct AND g.quality = q.quality GROUP BY ALL""",
)
def ag33(spark, d):
    pr = F.exp(-F.col("euclidean") / 9)
    q = F.when(pr > 0.9, "High").when(pr > 0.7, "Moderate").otherwise("Low")
    n = decisions(spark, d).groupBy("t", (F.col("t") == F.col("p")).cast("int").alias("correct"), q.alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    grid = PR.parameter_grid(spark, t=[0, 1], correct=[0, 1], quality=["High", "Moderate", "Low"])
    g = grid.select(F.col("t").cast("int").alias("t"), F.col("correct").cast("int").alias("correct"), "quality")
    return g.join(n, ["t", "correct", "quality"], "left").fillna(0, ["n"])


@query("ag37_scale_bars", f"WITH {FP}, b AS (SELECT id, unnest([dist1, dist2, dist3]) AS x FROM fp) SELECT id, round(avg(x), 6) AS pixels, round(CASE WHEN count(x) >= 2 THEN stddev_samp(x) END, 6) AS pixels_sd FROM b WHERE x IS NOT NULL GROUP BY id")
def ag37(spark, d):
    b = fp(spark, d).select("id", F.explode(F.array("dist1", "dist2", "dist3")).alias("x")).filter("x is not null")
    return b.groupBy("id").agg(r6(F.avg("x"), "pixels"), r6(F.when(F.count("x") >= 2, F.stddev_samp("x")), "pixels_sd"))


@query("pf17_path_parts", f"SELECT file_id, split_part(file_name, '.', 2) AS ending, {label_sql('file_format', 'NULL')} AS file_format FROM import_files")
def pf17(spark, d):
    f = C.with_case(table(spark, d, "import_files").withColumnRenamed("file_name", "FILE_NAME"), "file_name")
    return f.select("file_id", F.split_part("file_name", F.lit("."), F.lit(2)).alias("ending"), label_form("file_format", None).alias("file_format"))


@query("io10_image_paths", f"WITH {FP} SELECT id, species, sex, individual_id, trail FROM fp WHERE species <> '' AND individual_id <> '' AND trail <> ''")
def io10(spark, d):
    f = fp(spark, d).filter("species <> '' and individual_id <> '' and trail <> ''")
    paths = f.select("id", F.concat_ws("/", F.lit("/images"), "species", "sex", "individual_id", "trail", F.concat("id", F.lit(".jpg"))).alias("path"))
    return image_paths(paths).select("id", "species", "sex", "individual_id", "trail")


# ------------------------------------------------------------------ geometry of chains
@query("fn12_affine_chain", f"WITH {FP} SELECT id, round(-(v2 + 3), 6) AS x, round(v1 - 2, 6) AS y, round(v1, 6) AS back_x, round(v2, 6) AS back_y FROM fp WHERE v1 IS NOT NULL AND v2 IS NOT NULL")
def fn12(spark, d):
    f = fp(spark, d).filter("v1 is not null and v2 is not null")
    lit = lambda m: F.array(*[F.lit(float(x)) for x in m])
    chain = F.array(lit(G.translation_matrix(-2, 3)), lit(G.rotation_matrix(90)))
    f = f.select("id", chain.alias("t"), G.point(F.col("v1"), F.col("v2")).alias("p")).withColumn("q", G.apply_chain(F.col("t"), F.col("p")))
    f = f.withColumn("b", G.apply_chain(G.invert_chain(F.col("t")), F.col("q")))
    return f.select("id", r6(F.col("q.x"), "x"), r6(F.col("q.y"), "y"), r6(F.col("b.x"), "back_x"), r6(F.col("b.y"), "back_y"))


@query("fn11_measurements", f"WITH {FP} SELECT id, round(sqrt((v1 - v3) ** 2 + (v2 - v4) ** 2), 6) AS span FROM fp WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL")
def fn11(spark, d):
    f = fp(spark, d).na.drop(subset=["v1", "v2", "v3", "v4"]).select("id", F.array(G.point(F.col("v1"), F.col("v2")), G.point(F.col("v3"), F.col("v4"))).alias("landmarks"))
    m = G.measurement_columns(F.col("landmarks"), {"span": ("distance", (1, 2)), "none": ("distance", (1, 9))})
    return f.select("id", *m).filter("none is null").select("id", r6(F.col("span"), "span"))


@query("fn15_decimal_degrees", "SELECT s_suppkey, round(CASE WHEN s_nationkey % 2 = 1 THEN -1 ELSE 1 END * (s_nationkey + s_suppkey % 60 / 60.0), 6) AS degrees FROM supplier")
def fn15(spark, d):
    ref = F.when(F.col("s_nationkey") % 2 == 1, "s").otherwise("N")
    return table(spark, d, "supplier").select("s_suppkey", r6(G.decimal_degrees(F.col("s_nationkey"), F.col("s_suppkey") % 60, F.lit(0.0), ref), "degrees"))


@query("fn29_combined_score", "SELECT record_id, round(0.5 * (1 - abs(mean_cv_f1 - mean_cv_accuracy) / mean_cv_accuracy) + 0.5 * mean_cv_roc_auc, 6) AS score FROM best_models WHERE mean_cv_accuracy > 0 AND NOT isnan(mean_cv_accuracy) AND NOT isnan(mean_cv_f1) AND NOT isnan(mean_cv_roc_auc)")
def fn29(spark, d):
    b = table(spark, d, "best_models").filter("mean_cv_accuracy > 0 and not isnan(mean_cv_accuracy) and not isnan(mean_cv_f1) and not isnan(mean_cv_roc_auc)")
    return b.select("record_id", r6(0.5 * (1 - E.relative_difference("mean_cv_f1", "mean_cv_accuracy")) + 0.5 * F.col("mean_cv_roc_auc"), "score"))


# ------------------------------------------------------------------ rankings and projections
@query("ml10_forward_selection")
def ml10(spark, d):
    long = P.forward_selection(fp(spark, d).filter("species <> 'unknown'"), MEASURES, "sex", 4, ["species"])
    return long.select("species", "rank_no", "feature", F.round("score", 4).alias("score"))


@query("ml11_forest_ranking")
def ml11(spark, d):
    return P.rank_forest(fp(spark, d).filter("species <> 'unknown'"), MEASURES, "species")


@query("ml13_lasso_ranking")
def ml13(spark, d):
    f = fp(spark, d).filter("sex <> 'unknown'").withColumn("y", (F.col("sex") == "m").cast("int"))
    return P.rank_lasso(f, MEASURES, "y")


@query("ml14_pca")
def ml14(spark, d):
    f = flat_emb(spark, d)
    out = R.project(f, R.fit_pca(f, DIMS, 2))
    return out.select("id", r6(F.col("PCA1"), "PCA1"), r6(F.col("PCA2"), "PCA2"))


@query("ml15_lda")
def ml15(spark, d):
    f = flat_emb(spark, d)
    out = R.project(f, R.fit_lda(f, DIMS, "individual_id", 2))
    return out.select("id", r6(F.col("LDA1"), "LDA1"), r6(F.col("LDA2"), "LDA2"))


@query("ml08_forest_imputation")
def ml08(spark, d):
    f = fp(spark, d).filter(F.coalesce(*MEASURES).isNotNull()).select("id", *MEASURES)
    return P.iterative_impute(f, MEASURES, "id", rounds=2)


# ------------------------------------------------------------------ pipelines
@query("pl01_projected_pairs")
def pl01(spark, d):
    f = flat_emb(spark, d)
    pairs = PR.trail_pairs(PR.trail_table(f)).select("trail_a_id", "trail_b_id", "same_individual")
    flat = PL.prepared(f, DIMS, f, PL.PairConfig())
    out = PL.project_pairs(pairs, flat, DIMS)
    stats = [c for c, t in out.dtypes if t == "double"]
    return out.select("trail_a_id", "trail_b_id", "same_individual", "min_observations", "max_observations", F.size("selected_features").alias("k"), *[r6(F.col(c), c) for c in stats])


@query("pl01_sums_only", "SELECT true AS same, 0 AS n_missing")
def pl01_sums(spark, d):
    """Whether pairs that are formed from sums of trails have the centre distances of those formed from their rows."""
    f = flat_emb(spark, d)
    pairs = PR.trail_pairs(PR.trail_table(f)).select("trail_a_id", "trail_b_id")
    flat = PL.prepared(f, DIMS, f, PL.PairConfig())
    a, b = (PL.project_pairs(pairs, flat, DIMS, PL.PairConfig(k_features=6), full=x).select("trail_a_id", "trail_b_id", F.col("dist_euclidean").alias(f"d{int(x)}")) for x in (False, True))
    j = a.join(b, ["trail_a_id", "trail_b_id"], "full")
    return j.agg(F.coalesce(F.max(F.abs(F.col("d0") - F.col("d1")) / F.greatest("d1", F.lit(1e-9))) < 1e-6, F.lit(True)).alias("same"), F.count_if(F.col("d0").isNull() | F.col("d1").isNull()).cast("int").alias("n_missing"))


@query("pl01_selections")
def pl01_selections(spark, d):
    """The pairs of one individual's trails by each way of selection."""
    f = flat_emb(spark, d)
    pairs = PR.trail_pairs(PR.trail_table(f)).filter("same_individual").select("trail_a_id", "trail_b_id")
    flat = PL.prepared(f, DIMS, f, PL.PairConfig())
    parts = [PL.project_pairs(pairs, flat, DIMS, PL.PairConfig(k_features=4, selection=x)).select(F.lit(x).alias("selection"), "trail_a_id", "trail_b_id", "selected_features", r6(F.col("dist_euclidean"), "dist_euclidean")) for x in ("univariate", "variance", "lasso", "random_forest")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("pl01_sex_model")
def pl01_sex_model(spark, d):
    """Projected pairs with the probabilities of a model of the individual's parity as features."""
    f = flat_emb(spark, d).drop("sex").withColumn("sex", F.when(F.substring("individual_id", 2, 1).cast("int") % 2 == 0, "f").otherwise("m")).withColumn("fold", (F.col("id") % 3).cast("int"))
    q = PL.fold_predictions(f, DIMS, "sex").select("id", F.col("proba_sex").alias("proba_1"), (1 - F.col("proba_sex")).alias("proba_0"))
    flat = Stages(spark, "sex").write(PL.prepared(f, DIMS, f, PL.PairConfig()).join(q, "id"), "points")
    pairs = PR.trail_pairs(PR.trail_table(f)).select("trail_a_id", "trail_b_id", "same_individual")
    out = PL.project_pairs(pairs, flat, DIMS, PL.PairConfig(k_features=6), proba=["proba_0", "proba_1"], full=False)
    return out.select("trail_a_id", "trail_b_id", "same_individual", r6(F.col("dist_euclidean"), "dist_euclidean"), *[F.round(f"avg_proba_{g}_{j}", 4).alias(f"avg_proba_{g}_{j}") for g in "ABR" for j in (0, 1)])


@query("pl03_sequential_holdout")
def pl03(spark, d):
    table_, _ = PL.sequential_holdout(flat_emb(spark, d), DIMS, (4, 6), 2)
    return table_


@query("pl09_left_out_print")
def pl09(spark, d):
    """What the BCR of the largest trail's pairs loses without each of its prints."""
    f = flat_emb(spark, d)
    largest = f.groupBy("trail").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "trail").first()["trail"]
    out = PL.left_out_effect(f, DIMS, largest, PL.PairConfig(k_features=6))
    return out.select("footprint_id", r6(F.col("bcr"), "bcr"), r6(F.col("delta_bcr"), "delta_bcr"))


@query("pl10_search")
def pl10(spark, d):
    """Three drawn candidates of each of two model keys."""
    spaces = {"rank": ["variance", "univariate", None], "k": [4, 6, 8, 10]}
    table_, _ = PL.classification_search(known_sex(spark, d), MEASURES, "sex", spaces, ("lda_svd", "logistic"), 3)
    return table_.select("model", "candidate", "options", *[r6(F.col(f"mean_{c}"), f"mean_{c}") for c in PL.SEARCH_SCORES], "mean_rank")


@query("pl10_best_of_search")
def pl10_best(spark, d):
    _, best = PL.classification_search(known_sex(spark, d), MEASURES, "sex", {"rank": ["variance", "univariate"], "k": [4, 8]}, ("lda_svd",), 2)
    return best.select("model", "best_metric", "candidate", r6(F.col("score"), "score"))


@query("pl11_search")
def pl11_search(spark, d):
    f = flat_emb(spark, d).withColumn("fold", F.substring("individual_id", 2, 2).cast("int") % 3)
    out = PL.pair_search(f, DIMS, {"k_features": [2, 4, 8], "reducer": ["lda", "pca"], "scaler": ["standard", "robust"]}, 4)
    return out.select("candidate", "k_features", "reducer", "scaler", r6(F.col("separation"), "separation"), "rank_no")


@query("pl13_oof_and_retrained", f"WITH {FP} SELECT split, count(*) AS n, count(*) AS n_predicted FROM fp WHERE sex IN ('f', 'm') AND individual_id NOT IN ('unknown', '') AND split IN ('train', 'test', 'inference') GROUP BY split")
def pl13(spark, d):
    """Rows of each split, and how many have a prediction: train out of fold, the others by a model of all train rows."""
    f = fp(spark, d).filter("sex in ('f', 'm') and individual_id not in ('unknown', '')")
    out = PL.predict_all(f.filter("split = 'train'"), f.filter("split in ('test', 'inference')"), MEASURES, "sex")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("pred_sex").alias("n_predicted"))


@query("cl09_cutoff_sweep")
def cl09(spark, d):
    """Best of 38 cutoffs for each of 18 distances, raw and scaled, by its mean over the folds, and what it gives on held-out individuals."""
    f = flat_emb(spark, d)
    held = F.col("individual_id").isin("l0", "l1", "l2", "l3")
    config = PL.PairConfig(k_features=6)
    train = f.filter(~held).withColumn("fold", F.substring("individual_id", 2, 2).cast("int") % 2)
    distances = [f"dist_{m}" for m in METRICS] + [f"{s}_{m}_between" for m in METRICS for s in ("mean", "median")]
    keep = ["trail_a_id", "trail_b_id", "ind_a", "ind_b", "origin", "fold", *distances]
    cv = PL.cross_validated_pairs(train, DIMS, config).select(*keep)
    test = PL.baseline_pairs(train, f.filter(held), DIMS, config).withColumn("fold", F.lit(None).cast("int")).select(*keep)
    best = PO.sweep_benchmark(PO.sweep_curves(cv.unionByName(test), ["origin", "fold"], distances), [])
    return best.select("dist", "prep", "cutoff", *[r6(F.col(c), c) for c in ("cv_erd", "cv_v", "cv_score", "test_erd", "test_v")], "test_pred_count", "test_true_count")


@query("pl12_classification")
def pl12(spark, d):
    pred = PL.fold_predictions(known_sex(spark, d), MEASURES, "sex")
    out = PL.classification_report(pred, "sex")
    return out.select("tp", "fn", "fp", "tn", *[r6(F.col(c), c) for c in ("accuracy", "balanced_accuracy", "f1", "balanced", "pct_right")])


def by_pipeline(pairs, fit):
    """``fit`` of each pipeline's pairs by themselves, as each measures on a scale of its own; with the column ``pipeline``."""
    pairs = pairs.withColumn("pipeline", F.coalesce("pipeline", F.lit("unknown")))
    names = sorted(r[0] for r in pairs.select("pipeline").distinct().collect())
    parts = [fit(pairs.filter(F.col("pipeline") == n)).withColumn("pipeline", F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("pl14_distance_benchmark")
def pl14(spark, d):
    out = by_pipeline(mp(spark, d), lambda m: PL.distance_benchmark(m, ["euclidean", "manhattan", "chebyshev", "canberra"], "same", ["tag"], 0.98))
    return out.select("pipeline", "tag", "tp", "fn", "fp", "tn", r6(F.col("bcr"), "bcr"))


@query("pl15_best_of", f"""WITH b AS (SELECT {label_sql('species')} AS species, {label_sql('model_key')} AS model_key, record_id, mean_cv_f1 AS f1 FROM best_models WHERE NOT isnan(mean_cv_f1)),
  r AS (SELECT *, row_number() OVER (PARTITION BY species, model_key ORDER BY f1 DESC, record_id) AS k FROM b), {FP}, n AS (SELECT species, count(*) AS n_prints FROM fp GROUP BY species)
  SELECT r.species, model_key, record_id, n_prints FROM r LEFT JOIN n USING (species) WHERE k = 1""")
def pl15(spark, d):
    b = table(spark, d, "best_models").filter("not isnan(mean_cv_f1)").select(label_form("species").alias("species"), label_form("model_key").alias("model_key"), "record_id", F.col("mean_cv_f1").alias("f1"))
    w = Window.partitionBy("species", "model_key").orderBy(F.col("f1").desc(), "record_id")
    best = b.withColumn("k", F.row_number().over(w)).filter("k = 1").select("species", "model_key", "record_id")
    return PR.validated_join(best, fp(spark, d).groupBy("species").agg(F.count(F.lit(1)).alias("n_prints")), ["species"])


@query("pl11_search_score", f"WITH {MP} SELECT pipeline, tag, round(avg(euclidean) FILTER (same = 0) - avg(euclidean) FILTER (same = 1), 6) AS separation FROM mp GROUP BY ALL")
def pl11(spark, d):
    m = mp(spark, d).select("pipeline", "tag", F.col("same").alias("same_individual"), F.col("euclidean").alias("dist_euclidean"))
    return PL.search_score(m, ["pipeline", "tag"]).select("pipeline", "tag", r6(F.col("separation"), "separation"))


# ------------------------------------------------------------------ sampling kernels
@query("sp12_triplets")
def sp12(spark, d):
    return S.triplets(emb(spark, d), "individual_id", "id")


@query("sp13_random_pairs")
def sp13(spark, d):
    return S.random_pairs(emb(spark, d), "id", 10_000)


# ------------------------------------------------------------------ extensions: windows over events
@query("st01_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st01(spark, d):
    return tumbling(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st02_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def st02(spark, d):
    s = sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("st03_pair_counts", f"WITH p AS (SELECT {base_sql('trail_a_id')} AS a, {base_sql('trail_b_id')} AS b, coalesce(lower(trim(same_individual)) = 'true', false) AS s FROM master_pairs) SELECT least(a, b) AS trail_lo, greatest(a, b) AS trail_hi, count(*) AS n_runs, count(*) FILTER (s) AS n_same FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL")
def st03(spark, d):
    return pair_counts(table(spark, d, "master_pairs"))


# ------------------------------------------------------------------ more pipelines
@query("pl02_fold_pairs")
def pl02(spark, d):
    f = flat_emb(spark, d).withColumn("fold", F.substring("individual_id", 2, 2).cast("int") % 3)
    out = PL.cross_validated_pairs(f, DIMS, PL.PairConfig(k_features=6))
    return out.select("trail_a_id", "trail_b_id", "fold", "same_individual", r6(F.col("dist_euclidean"), "dist_euclidean"))


@query("pl04_baseline_pairs")
def pl04(spark, d):
    f = flat_emb(spark, d)
    own = F.col("individual_id").isin("l0", "l1", "l2")
    out = PL.baseline_pairs(f.filter(~own), f.filter(own), DIMS, PL.PairConfig(k_features=6))
    return out.select("trail_a_id", "trail_b_id", "origin", "same_individual", r6(F.col("dist_euclidean"), "dist_euclidean"))


@query("pl05_embedding_pairs")
def pl05(spark, d):
    f = flat_emb(spark, d)
    own = F.col("individual_id").isin("l0", "l1", "l2")
    _, out = PL.embedding_pairs(f.filter(~own), f.filter(own), DIMS)
    return out.select("trail_a_id", "trail_b_id", "same_individual", "pred_same", r6(F.col("proba"), "proba"))


@query("pl07_experiments")
def pl07(spark, d):
    f = flat_emb(spark, d).withColumn("fold", F.substring("individual_id", 2, 2).cast("int") % 2)
    out = PL.experiments(f, DIMS, [PL.PairConfig(k_features=4), PL.PairConfig(k_features=4, reducer="pca", selection="variance")])
    return out.select("k_features", "selection", "reducer", "fold", "tp", "fn", "fp", "tn", r6(F.col("bcr"), "bcr"))


@query(
    "pl16_feature_shape",
    f"""WITH {FP}, known AS (SELECT * FROM fp WHERE sex IN ('f', 'm') AND individual_id NOT IN ('unknown', '')),
    own AS (SELECT individual_id, min_by(sex, id) AS own_sex FROM known GROUP BY individual_id),
    l AS (UNPIVOT (SELECT individual_id, own_sex, {', '.join(MEASURES)} FROM known JOIN own USING (individual_id)) ON {', '.join(MEASURES)} INTO NAME feature VALUE x),
    g AS (SELECT feature, own_sex, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL),
    s AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw FROM g GROUP BY feature),
    best AS (SELECT feature FROM g JOIN s USING (feature) GROUP BY feature ORDER BY sum(g.n * (g.m - s.mean) ** 2) / (any_value(s.k) - 1) / (any_value(s.ssw) / (any_value(s.n) - any_value(s.k))) DESC LIMIT 1)
    SELECT feature, individual_id, own_sex AS sex, round(avg(x), 6) AS mean FROM l JOIN best USING (feature) GROUP BY ALL""",
)
def pl16(spark, d):
    out = PL.feature_shape(known_sex(spark, d), MEASURES)
    return out.select("feature", "individual_id", "sex", r6(F.col("mean"), "mean"))


@query("pl20_distance_weights")
def pl20(spark, d):
    return by_pipeline(mp(spark, d), lambda m: PL.distance_weights(m, ["euclidean", "manhattan", "chebyshev", "canberra"], "same"))


@query("io18_saved_pipeline", "SELECT true AS same")
def io18(spark, d):
    """Whether a fitted pipeline that was written and read again predicts the same."""
    f = known_sex(spark, d)
    p = PL.FeaturePipeline(MEASURES, "sex", impute="mean", outliers="clip_98", scale="robust", reduce_pre="pca", select="variance", classify="lda", n_components=4).fit(f)
    at = Stages(spark, "saved").path("pipeline")
    p.save(spark, at)
    a, b = (x.apply(f).select("id", F.col("pred_sex").alias(n)) for x, n in ((p, "a"), (PL.FeaturePipeline.load(spark, at), "b")))
    return a.join(b, "id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@query("ml20_other_steps")
def ml20_other(spark, d):
    """A pipeline that reduces before it selects and ends in a logistic model."""
    f = known_sex(spark, d)
    p = PL.FeaturePipeline(MEASURES, "sex", k=3, n_components=6, impute="median", scale="standard", reduce_pre="pca", select="mutual_information", classify="logistic").fit(f)
    return p.apply(f).groupBy("sex", "pred_sex").agg(F.count(F.lit(1)).alias("n"))


@query("sp08_split_write", f"WITH {FP}, i AS (SELECT species, count(DISTINCT individual_id) AS n FROM fp WHERE sex IN ('f', 'm') AND individual_id NOT IN ('unknown', '') AND species <> 'unknown' GROUP BY species) SELECT species, n AS n_individuals, true AS whole FROM i")
def sp08(spark, d):
    """Splits as written and read again: individuals of each species, and whether each lies in one split."""
    f = fp(spark, d).filter("sex in ('f', 'm') and individual_id not in ('unknown', '') and species <> 'unknown'")
    at = Stages(spark, "splits").path("written")
    PL.write_splits(f.drop("sex").join(S.individuals(f), "individual_id"), at)
    own = spark.read.parquet(at).groupBy("species", "individual_id").agg(F.countDistinct("split").alias("n"))
    return own.groupBy("species").agg(F.count(F.lit(1)).alias("n_individuals"), (F.max("n") == 1).alias("whole"))


@query("sp11_leftovers", f"WITH {FP}, t AS (SELECT DISTINCT individual_id FROM fp WHERE trail NOT IN ('unknown', '') AND individual_id NOT IN ('unknown', '')) SELECT count(*) AS n, count(*) FILTER (trail NOT IN ('unknown', '') OR individual_id IN (SELECT individual_id FROM t)) AS n_with_trail FROM fp")
def sp11_leftovers(spark, d):
    """Rows that have a trail after those without one were given one of their individual's."""
    out = S.assigned_leftovers(fp(spark, d))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("trail").isin("unknown", "")).alias("n_with_trail"))


@query("ml20_feature_pipeline")
def ml20(spark, d):
    f = known_sex(spark, d)
    p = PL.FeaturePipeline(MEASURES, "sex", impute="median", outliers="clip_98", scale="standard", select="univariate", reduce="none", classify="lda_svd").fit(f)
    return p.apply(f).select("id", "sex", "pred_sex")
