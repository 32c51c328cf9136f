"""Queries of aggregates, splits, preprocessing, distances, overlap tests and population estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.distances import METRICS
from ..functions.overlap import circle_overlap, cloud_moments, ellipse_overlap, pooled_overlap, region_shape, rhombus_overlap
from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import pairs as PR
from ..operators import population as PO
from ..operators import preprocess as P
from ..operators import splits as S
from .registry import query, table
from .relational_queries import fp, mp, r6
from .sqltext import EMB, FP, MP

MEASURES = list(C.MEASURES)
M_LIST = ", ".join(MEASURES)


def emb(spark, d):
    """Vectors as rows of trails: ten individuals with up to six trails each."""
    e = table(spark, d, "embeddings")
    ind = F.concat(F.lit("l"), "label")
    return e.select(F.col("vec_id").alias("id"), ind.alias("individual_id"), F.concat(ind, F.lit("_t"), F.floor(F.col("vec_id") / 10) % 6).alias("trail"), F.lit("unknown").alias("sex"), F.lit(0).alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def emb_pairs(spark, d):
    e = emb(spark, d)
    pairs = PR.trail_pairs(PR.trail_table(e))
    return PR.centroid_distances(pairs, PR.centroids(e, ["trail"]), "trail")


# ------------------------------------------------------------------ distances of pairs
@query("pair_distances", f"WITH {EMB} SELECT trail_a_id, trail_b_id, same_individual, {', '.join(f'round({m}, 6) AS dist_{m}' for m in METRICS)} FROM dist")
def pair_distances(spark, d):
    return emb_pairs(spark, d).select("trail_a_id", "trail_b_id", "same_individual", *[r6(F.col(f"dist_{m}"), f"dist_{m}") for m in METRICS])


@query(
    "jn02_pair_records",
    f"""WITH {EMB}, t AS (SELECT trail, any_value(individual_id) AS ind, min(id) AS ord, count(*) AS n FROM e GROUP BY trail)
    SELECT a.trail AS trail_a_id, b.trail AS trail_b_id, a.ind AS ind_a, b.ind AS ind_b, a.n AS n_a, b.n AS n_b, a.ind = b.ind AS same_individual FROM t a JOIN t b ON a.ord < b.ord""",
)
def jn02(spark, d):
    return PR.trail_pairs(PR.trail_table(emb(spark, d)), ["fold"]).select("trail_a_id", "trail_b_id", "ind_a", "ind_b", "n_a", "n_b", "same_individual")


@query(
    "fn20_between",
    f"""WITH {EMB}, one AS (SELECT DISTINCT id, trail, individual_id FROM long), t AS (SELECT trail, min(id) AS ord FROM e GROUP BY trail),
    pt AS (SELECT a.id AS i, b.id AS j, a.trail AS trail_a_id, b.trail AS trail_b_id, sqrt(sum((a.x - b.x) ** 2)) AS d, sum(abs(a.x - b.x)) AS l1 FROM long a JOIN long b ON a.i = b.i AND a.individual_id = b.individual_id AND a.trail <> b.trail JOIN t ta ON ta.trail = a.trail JOIN t tb ON tb.trail = b.trail WHERE ta.ord < tb.ord GROUP BY ALL)
    SELECT trail_a_id, trail_b_id, round(avg(d), 6) AS mean_euclidean_between, round(quantile_cont(d, 0.5), 6) AS median_euclidean_between, round(avg(l1), 6) AS mean_manhattan_between, round(quantile_cont(l1, 0.5), 6) AS median_manhattan_between FROM pt GROUP BY ALL""",
)
def fn20_between(spark, d):
    e = emb(spark, d)
    own = PR.trail_pairs(PR.trail_table(e)).filter("same_individual")
    out = PR.between_stats(own, e, "trail", metrics=("euclidean", "manhattan"))
    return out.select("trail_a_id", "trail_b_id", *[r6(F.col(c), c) for c in out.columns[2:]])


@query(
    "fn20_within",
    f"""WITH {EMB}, pt AS (SELECT a.trail, a.id AS i, b.id AS j, sqrt(sum((a.x - b.x) ** 2)) AS d, max(abs(a.x - b.x)) AS c FROM long a JOIN long b ON a.i = b.i AND a.trail = b.trail AND a.id < b.id GROUP BY ALL)
    SELECT trail, round(avg(d), 6) AS mean_euclidean_within, round(quantile_cont(d, 0.5), 6) AS median_euclidean_within, round(avg(c), 6) AS mean_chebyshev_within, round(quantile_cont(c, 0.5), 6) AS median_chebyshev_within FROM pt GROUP BY trail""",
)
def fn20_within(spark, d):
    out = PR.within_stats(emb(spark, d), "trail", "id", metrics=("euclidean", "chebyshev"))
    return out.select("trail", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(
    "jn08_complement",
    f"""WITH {EMB}, t AS (SELECT trail, min(id) AS ord, any_value(individual_id) AS ind FROM e GROUP BY trail), p AS (SELECT a.trail AS trail_a_id, b.trail AS trail_b_id FROM t a JOIN t b ON a.ord < b.ord AND a.ind = b.ind)
    SELECT trail_a_id, trail_b_id, count(*) AS n_rest, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean_f1 FROM p JOIN e ON e.trail <> trail_a_id AND e.trail <> trail_b_id GROUP BY ALL HAVING count(*) >= 2""",
)
def jn08(spark, d):
    e = emb(spark, d).withColumn("f1", F.col("vec")[0])
    own = PR.trail_pairs(PR.trail_table(e)).filter("same_individual")
    return PR.complement_moments(e, own, "trail", ["f1"]).select("trail_a_id", "trail_b_id", "n_rest", r6(F.col("mean_f1"), "mean_f1"))


@query("jn10_gather", f"WITH {EMB} SELECT trail, list(round(CAST(embedding[1] AS DOUBLE), 6) ORDER BY id::VARCHAR) AS firsts FROM e GROUP BY trail")
def jn10(spark, d):
    e = emb(spark, d)
    lists = PR.trail_table(e).select("trail_id", "samples")
    g = PR.gathered(lists, e, "trail_id", "samples", "id", "vec")
    return g.select(F.col("trail_id").alias("trail"), F.transform("vectors", lambda v: F.round(v[0], 6)).alias("firsts"))


@query("jn22_resolved", "WITH s AS (SELECT s_suppkey::VARCHAR AS id, (row_number() OVER (ORDER BY s_suppkey) - 1)::VARCHAR AS pos FROM supplier), w AS (SELECT id AS ref FROM s UNION SELECT '0') SELECT ref, coalesce(a.id, b.id) AS resolved FROM w LEFT JOIN s a ON a.id = ref LEFT JOIN s b ON b.pos = ref")
def jn22(spark, d):
    s = table(spark, d, "supplier")
    w = s.select(F.col("s_suppkey").cast("string").alias("ref")).union(spark.createDataFrame([("0",)], "ref string")).distinct()
    return PR.resolved_ids(w, s, "ref", "s_suppkey").select("ref", "resolved")


# ------------------------------------------------------------------ summaries
@query("ag01_overview", f"WITH {FP} SELECT species, count(*) AS n_rows, count(DISTINCT individual_id) AS n_individuals, count(DISTINCT trail) AS n_trails, 12 AS n_features FROM fp GROUP BY species")
def ag01(spark, d):
    f = fp(spark, d)
    n = len(C.feature_columns(f.drop("trail")))
    return f.groupBy("species").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("individual_id").alias("n_individuals"), F.countDistinct("trail").alias("n_trails"), F.lit(n).alias("n_features"))


@query(
    "ag02_split_summary",
    f"""WITH {FP}, s AS (SELECT * FROM (VALUES ('f'), ('m'), ('unknown')) v(sex)), g AS (SELECT DISTINCT split FROM fp),
    i AS (SELECT split, sex, individual_id, count(*) AS n, count(DISTINCT trail) AS t FROM fp GROUP BY ALL),
    a AS (SELECT split, sex, sum(n) AS n_prints, count(*) AS n_individuals, avg(n) AS mp, stddev_pop(n) AS sp, avg(t) AS mt, stddev_pop(t) AS st FROM i GROUP BY ALL)
    SELECT split, sex, coalesce(n_prints, 0)::BIGINT AS n_prints, coalesce(n_individuals, 0) AS n_individuals, round(coalesce(mp, 0), 6) AS mean_prints, round(coalesce(sp, 0), 6) AS sd_prints, round(coalesce(mt, 0), 6) AS mean_trails, round(coalesce(st, 0), 6) AS sd_trails FROM g CROSS JOIN s LEFT JOIN a USING (split, sex)""",
)
def ag02(spark, d):
    f = fp(spark, d)
    own = f.groupBy("split", "sex", "individual_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trail").alias("t"))
    a = own.groupBy("split", "sex").agg(F.sum("n").alias("n_prints"), F.count(F.lit(1)).alias("n_individuals"), F.avg("n").alias("mp"), F.stddev_pop("n").alias("sp"), F.avg("t").alias("mt"), F.stddev_pop("t").alias("st"))
    all_ = f.select("split").distinct().select("split", F.explode(F.array(*map(F.lit, ("f", "m", "unknown")))).alias("sex"))
    out = all_.join(a, ["split", "sex"], "left").fillna(0)
    return out.select("split", "sex", "n_prints", "n_individuals", r6(F.col("mp"), "mean_prints"), r6(F.col("sp"), "sd_prints"), r6(F.col("mt"), "mean_trails"), r6(F.col("st"), "sd_trails"))


@query("ag04_split_shares", f"WITH {FP} SELECT species, round(count(*) FILTER (split = 'train') / count(*), 6) AS train, round(count(*) FILTER (split = 'test') / count(*), 6) AS test, round(count(*) FILTER (split = 'inference') / count(*), 6) AS inference FROM fp WHERE split IN ('train', 'test', 'inference') GROUP BY species")
def ag04(spark, d):
    names = ["train", "test", "inference"]
    p = fp(spark, d).filter(F.col("split").isin(*names)).groupBy("species").pivot("split", names).count().fillna(0)
    whole = sum((F.col(n) for n in names), F.lit(0))
    return p.select("species", *[r6(F.col(n) / whole, n) for n in names])


@query("ag05_first_known", f"WITH {FP} SELECT species, trail, min_by(individual_id, id) FILTER (individual_id <> 'unknown') AS individual_id, min_by(sex, id) FILTER (sex <> 'unknown') AS sex FROM fp WHERE trail <> 'unknown' GROUP BY species, trail")
def ag05(spark, d):
    f = C.known_trails(fp(spark, d))
    first = lambda c: F.min_by(c, F.when(F.col(c) != "unknown", F.col("id"))).alias(c)
    out = f.groupBy("species", "trail").agg(first("individual_id"), first("sex"))
    return out.select("species", "trail", *[F.when(F.col(c) != "unknown", F.col(c)).alias(c) for c in ("individual_id", "sex")])


@query("ag06_mode", f"WITH {FP}, n AS (SELECT trail, substrate, count(*) AS c FROM fp WHERE substrate <> 'unknown' GROUP BY ALL) SELECT trail, substrate FROM (SELECT *, row_number() OVER (PARTITION BY trail ORDER BY c DESC, substrate) AS k FROM n) WHERE k = 1")
def ag06(spark, d):
    f = fp(spark, d).filter("substrate <> 'unknown'")
    return f.groupBy("trail").agg(F.expr("mode() WITHIN GROUP (ORDER BY substrate)").alias("substrate"))


CONF = "count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 1) AS fp_, count(*) FILTER (t = 0 AND p = 0) AS tn"
DEC = f"{MP}, dec AS (SELECT *, same AS t, (euclidean < CASE pipeline WHEN 'rcv_lda' THEN 1.1 WHEN 'siamese' THEN 0.25 ELSE 4.5 END)::INT AS p FROM mp WHERE euclidean IS NOT NULL AND same IS NOT NULL)"


def decisions(spark, d):
    limit = F.when(F.col("pipeline") == "rcv_lda", 1.1).when(F.col("pipeline") == "siamese", 0.25).otherwise(4.5)
    return mp(spark, d).filter("euclidean is not null and same is not null").withColumns({"t": F.col("same"), "p": (F.col("euclidean") < limit).cast("int")})


@query("ag07_confusion_bcr", f"WITH {DEC}, c AS (SELECT pipeline, origin, {CONF} FROM dec GROUP BY ALL) SELECT pipeline, origin, tp, fn, fp_ AS fp, tn, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp_, 0), 6) AS tnr, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp_, 0)) / 2, 6) AS bcr FROM c")
def ag07(spark, d):
    c = E.confusion(decisions(spark, d), "t", "p", ["pipeline", "origin"])
    return c.select("pipeline", "origin", "tp", "fn", "fp", "tn", *[r6(F.col(x), x) for x in ("tpr", "tnr", "bcr")])


@query(
    "ag09_bcr_by_size",
    f"WITH {DEC}, z AS (SELECT *, least(TRY_CAST(nullif(regexp_extract(trail_a_id, '_sub(\\d+)_', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(trail_b_id, '_sub(\\d+)_', 1), '') AS INT)) AS size FROM dec), c AS (SELECT size, count(*) AS n, {CONF} FROM z GROUP BY size) SELECT size, n, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp_, 0), 6) AS tnr, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp_, 0)) / 2, 6) AS bcr FROM c",
)
def ag09(spark, d):
    b = E.bcr_by_size(decisions(spark, d), "trail_a_id", "trail_b_id", "t", "p")
    return b.select("size", "n", *[r6(F.col(x), x) for x in ("tpr", "tnr", "bcr")])


@query("ag10_separation", f"WITH {MP} SELECT pipeline, round(avg(euclidean) FILTER (same = 0) - avg(euclidean) FILTER (same = 1), 6) AS separation FROM mp GROUP BY pipeline")
def ag10(spark, d):
    return mp(spark, d).groupBy("pipeline").agg(r6(E.separation("same", "euclidean"), "separation"))


@query("ag12_individual_accuracy", f"WITH {DEC}, i AS (SELECT pipeline, a, avg((t = p)::INT) AS acc, max((t = 0)::INT) AS f, max((t = 1)::INT) AS m FROM dec GROUP BY ALL) SELECT pipeline, round(avg(acc) FILTER (f = 1), 6) AS acc_0, round(avg(acc) FILTER (m = 1), 6) AS acc_1, round((avg(acc) FILTER (f = 1) + avg(acc) FILTER (m = 1)) / 2, 6) AS balanced, count(*) FILTER (acc > 0.5) AS n_right, count(*) FILTER (acc <= 0.5) AS n_wrong FROM i GROUP BY pipeline")
def ag12(spark, d):
    dec = decisions(spark, d)
    a = E.individual_accuracies(dec, "a", "t", "p", ["pipeline"]).join(E.majority_stats(dec, "a", "t", "p", ["pipeline"]), "pipeline")
    return a.select("pipeline", *[r6(F.col(x), x) for x in ("acc_0", "acc_1", "balanced")], "n_right", "n_wrong")


@query(
    "ag14_scores",
    f"""WITH {DEC}, c AS (SELECT origin, {CONF} FROM dec GROUP BY origin), n AS (SELECT origin, -euclidean AS s, count(*) FILTER (t = 1) AS pos, count(*) FILTER (t = 0) AS neg FROM dec WHERE pipeline = 'rcv_lda' GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY origin ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n), u AS (SELECT origin, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY origin)
    SELECT origin, round((tp + tn) / (tp + fn + fp_ + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp_, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp_ + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc FROM c JOIN u USING (origin)""",
)
def ag14(spark, d):
    dec = decisions(spark, d)
    c = E.classification_scores(dec, "t", "p", ["origin"])
    u = E.roc_auc(dec.filter("pipeline = 'rcv_lda'").withColumn("s", -F.col("euclidean")), "t", "s", ["origin"])
    return c.join(u, "origin").select("origin", *[r6(F.col(x), x) for x in ("accuracy", "precision", "recall", "f1", "auc")])


@query(
    "ag14_auc_by_pipeline",
    f"""WITH {DEC}, n AS (SELECT pipeline, origin, -euclidean AS s, count(*) FILTER (t = 1) AS pos, count(*) FILTER (t = 0) AS neg FROM dec GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY pipeline, origin ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
    SELECT pipeline, origin, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY pipeline, origin""",
)
def ag14_auc(spark, d):
    u = E.roc_auc(decisions(spark, d).withColumn("s", -F.col("euclidean")), "t", "s", ["pipeline", "origin"])
    return u.select("pipeline", "origin", r6(F.col("auc"), "auc"))


@query("ag14_log_loss", f"WITH {DEC}, q AS (SELECT origin, t, exp(-euclidean / 2) AS p FROM dec) SELECT origin, round(-avg(CASE WHEN t = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 6) AS log_loss FROM q GROUP BY origin")
def ag14_log_loss(spark, d):
    return decisions(spark, d).groupBy("origin").agg(r6(E.log_loss("t", F.exp(-F.col("euclidean") / 2)), "log_loss"))


@query("ag16_concordance", f"WITH {MP} SELECT pipeline, round(2 * covar_samp(euclidean, manhattan) / (var_samp(euclidean) + var_samp(manhattan) + (avg(euclidean) - avg(manhattan)) ** 2), 6) AS ccc FROM mp WHERE euclidean IS NOT NULL AND manhattan IS NOT NULL GROUP BY pipeline")
def ag16(spark, d):
    return mp(spark, d).groupBy("pipeline").agg(r6(E.concordance("euclidean", "manhattan"), "ccc"))


@query("ag17_count_error", f"WITH {FP} SELECT species, round(abs(count(DISTINCT trail) - count(DISTINCT individual_id)) / count(DISTINCT individual_id), 6) AS erd FROM fp GROUP BY species")
def ag17(spark, d):
    n = fp(spark, d).groupBy("species").agg(F.countDistinct("trail").alias("p"), F.countDistinct("individual_id").alias("t"))
    return n.select("species", r6(E.relative_difference("p", "t"), "erd"))


@query("ag18_cutoff_stats", f"WITH {MP} SELECT pipeline, tag, round(avg(euclidean), 6) AS mean_cutoff, round(quantile_cont(euclidean, 0.5), 6) AS median_cutoff FROM mp WHERE euclidean IS NOT NULL GROUP BY ALL")
def ag18(spark, d):
    from .pipelines import global_cutoff

    m = mp(spark, d).filter("euclidean is not null").select("pipeline", "tag", *[F.col("euclidean").alias(c) for c in ("cutoff", "low", "high")])
    return global_cutoff(m, ["pipeline", "tag"]).select("pipeline", "tag", r6(F.col("mean_cutoff"), "mean_cutoff"), r6(F.col("median_cutoff"), "median_cutoff"))


@query("ag19_curve", "SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_samp(l_quantity), 6) AS sd_quantity FROM lineitem GROUP BY ALL")
def ag19(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(r6(F.avg("l_quantity"), "mean_quantity"), r6(F.stddev_samp("l_quantity"), "sd_quantity"))


@query("ag20_correlations", f"WITH {FP}, l AS (UNPIVOT (SELECT id, {M_LIST} FROM fp) ON {M_LIST} INTO NAME f VALUE x) SELECT a.f AS a, b.f AS b, round(corr(a.x, b.x), 6) AS r FROM l a JOIN l b ON a.id = b.id AND list_position([{', '.join(repr(m) for m in MEASURES)}], a.f) < list_position([{', '.join(repr(m) for m in MEASURES)}], b.f) GROUP BY ALL")
def ag20(spark, d):
    return E.correlations(fp(spark, d), MEASURES).select("a", "b", r6(F.col("r"), "r"))


ANOVA = f"""l AS (UNPIVOT (SELECT id, species, {M_LIST} FROM fp WHERE species <> 'unknown') ON {M_LIST} INTO NAME feature VALUE x),
  g AS (SELECT feature, species, count(x) AS n, avg(x) AS m, coalesce(var_pop(x), 0) AS v FROM l GROUP BY ALL),
  s AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw FROM g GROUP BY feature),
  f AS (SELECT s.feature, (sum(g.n * (g.m - s.mean) ** 2) / (any_value(s.k) - 1)) / (any_value(s.ssw) / (any_value(s.n) - any_value(s.k))) AS f FROM g JOIN s USING (feature) GROUP BY s.feature)"""


@query("ag21_anova", f"WITH {FP}, {ANOVA} SELECT feature, round(f, 3) AS f FROM f")
def ag21(spark, d):
    long = C.long_features(fp(spark, d).filter("species <> 'unknown'"), ["species"], MEASURES)
    return E.anova(long, "species").select("feature", F.round("f", 3).alias("f"))


@query("ag22_variance", f"WITH {FP}, l AS (UNPIVOT (SELECT {M_LIST} FROM fp) ON {M_LIST} INTO NAME feature VALUE x) SELECT feature, round(var_pop(x), 4) AS score FROM l GROUP BY feature")
def ag22(spark, d):
    return P.rank_variance(fp(spark, d), MEASURES).select("feature", F.round("score", 4).alias("score"))


@query("ag24_histogram", f"WITH {FP}, e AS (SELECT min(area1) AS lo, (max(area1) - min(area1)) / 30 AS w FROM fp), b AS (SELECT least(floor((area1 - lo) / w), 29)::INT AS bin, w FROM fp, e WHERE area1 IS NOT NULL) SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * any_value(w)), 9) AS density FROM b GROUP BY bin")
def ag24(spark, d):
    return E.histogram(fp(spark, d), "area1").select("bin", "n", F.round("density", 9).alias("density"))


@query("ag25_box", f"WITH {FP} SELECT species, sex, count(area1) AS n, round(quantile_cont(area1, 0.25), 6) AS q1, round(quantile_cont(area1, 0.5), 6) AS median, round(quantile_cont(area1, 0.75), 6) AS q3, min(area1) AS lo, max(area1) AS hi FROM fp GROUP BY ALL")
def ag25(spark, d):
    b = E.box_stats(fp(spark, d), "area1", ["species", "sex"])
    return b.select("species", "sex", "n", *[r6(F.col(x), x) for x in ("q1", "median", "q3")], "lo", "hi")


@query("ag28_unpivot_means", "SELECT 'discount' AS step, round(avg(l_discount), 6) AS mean FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax), 6) FROM lineitem")
def ag28(spark, d):
    m = table(spark, d, "lineitem").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return m.unpivot([], ["discount", "tax"], "step", "mean").select("step", r6(F.col("mean"), "mean"))


@query("ag29_pivot_mean", "SELECT select__method, round(avg(mean_cv_f1) FILTER (reduce_pre__method = 'pca'), 6) AS pca, round(avg(mean_cv_f1) FILTER (reduce_pre__method = 'umap'), 6) AS umap FROM best_models WHERE NOT isnan(mean_cv_f1) GROUP BY select__method")
def ag29(spark, d):
    p = table(spark, d, "best_models").filter("not isnan(mean_cv_f1)").groupBy("select__method").pivot("reduce_pre__method", ["pca", "umap"]).agg(F.avg("mean_cv_f1"))
    return p.select("select__method", r6(F.col("pca"), "pca"), r6(F.col("umap"), "umap"))


@query("ag30_pivot_counts", f"WITH {FP} SELECT individual_id, count(*) FILTER (sex = 'f') AS f, count(*) FILTER (sex = 'm') AS m, round(count(*) FILTER (sex = 'f') / count(*), 6) AS share_f FROM fp WHERE sex <> 'unknown' GROUP BY individual_id")
def ag30(spark, d):
    p = fp(spark, d).filter("sex <> 'unknown'").groupBy("individual_id").pivot("sex", ["f", "m"]).count().fillna(0)
    return p.select("individual_id", "f", "m", r6(F.col("f") / (F.col("f") + F.col("m")), "share_f"))


@query("ag32_quality", f"WITH {DEC}, i AS (SELECT a, origin, avg((t = p)::INT) AS r FROM dec GROUP BY ALL), q AS (SELECT origin, CASE WHEN r >= 0.9 THEN 'High' WHEN r >= 0.7 THEN 'Moderate' WHEN r >= 0.5 THEN 'Low' ELSE 'Misclassified' END AS quality FROM i), n AS (SELECT origin, quality, count(*) AS n FROM q GROUP BY origin, quality) SELECT origin, quality, n, round(100.0 * n / sum(n) OVER (PARTITION BY origin), 6) AS pct FROM n")
def ag32(spark, d):
    i = decisions(spark, d).groupBy("a", "origin").agg(F.avg((F.col("t") == F.col("p")).cast("int")).alias("r"))
    n = i.groupBy("origin", E.quality_class(F.col("r")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("origin", "quality", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("origin")), "pct"))


@query("ag34_confusion_pct", f"WITH {DEC} SELECT t, p, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS pct FROM dec GROUP BY t, p")
def ag34(spark, d):
    n = decisions(spark, d).groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    return n.select("t", "p", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("t")), "pct"))


@query("ag35_melt", "UNPIVOT (SELECT record_id, mean_cv_f1, mean_cv_roc_auc FROM best_models) ON mean_cv_f1, mean_cv_roc_auc INTO NAME metric VALUE score")
def ag35(spark, d):
    m = table(spark, d, "best_models").unpivot(["record_id"], ["mean_cv_f1", "mean_cv_roc_auc"], "metric", "score")
    return m.filter("score is not null")


@query("ag36_value_counts", f"WITH {FP} SELECT substrate, count(*) AS n, count(DISTINCT species) AS n_species FROM fp GROUP BY substrate")
def ag36(spark, d):
    return fp(spark, d).groupBy("substrate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("species").alias("n_species"))


@query("ag38_min_max", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER w) / nullif(max(l_extendedprice) OVER w - min(l_extendedprice) OVER w, 0), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def ag38(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", r6(P.min_max_by(line, "l_extendedprice", ["l_suppkey"]), "scaled"))


# ------------------------------------------------------------------ splits with a fixed order
OWN = "own AS (SELECT individual_id, min_by(sex, id) AS sex FROM fp WHERE individual_id NOT IN ('unknown', '') AND sex IN ('f', 'm') GROUP BY individual_id)"


def _len(c: str):
    # an order that both engines share: by length, then by name backwards
    return F.reverse(F.col(c))


@query("sp01_stratified_split", f"WITH {FP}, {OWN}, r AS (SELECT individual_id, row_number() OVER (PARTITION BY sex ORDER BY reverse(individual_id), individual_id) AS k, count(*) OVER (PARTITION BY sex) AS n FROM own) SELECT fp.id, CASE WHEN r.k IS NULL THEN 'inference' WHEN r.k <= ceil(r.n * 0.2) THEN 'test' ELSE 'train' END AS split FROM fp LEFT JOIN r USING (individual_id)")
def sp01(spark, d):
    return S.stratified_split(fp(spark, d).drop("split"), order=_len("individual_id")).select("id", "split")


@query("sp02_group_split", "WITH g AS (SELECT c_nationkey AS g, row_number() OVER (ORDER BY reverse(c_nationkey::VARCHAR), c_nationkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, CASE WHEN k <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM customer JOIN g ON g = c_nationkey")
def sp02(spark, d):
    return S.group_split(table(spark, d, "customer"), "c_nationkey", order=F.reverse(F.col("c_nationkey").cast("string"))).select("c_custkey", "split")


@query("sp03_folds", f"WITH {FP}, {OWN} SELECT individual_id, sex, ((row_number() OVER (PARTITION BY sex ORDER BY reverse(individual_id), individual_id) - 1) % (SELECT least(5, min(n)) FROM (SELECT count(*) AS n FROM own GROUP BY sex)))::INT AS fold FROM own")
def sp03(spark, d):
    return S.stratified_folds(S.individuals(fp(spark, d)), order=_len("individual_id"))


@query("sp05_fold_balance", f"WITH {FP} SELECT fold, count(DISTINCT CASE WHEN sex IN ('f', 'm') THEN sex END) = 2 AND bool_and(sex IN ('f', 'm')) AS valid FROM fp WHERE fold IS NOT NULL GROUP BY fold")
def sp05(spark, d):
    return S.fold_balance(fp(spark, d).filter("fold is not null"))


@query("sp06_sampled_individuals", f"WITH {FP}, i AS (SELECT DISTINCT individual_id FROM fp WHERE dataorigin = 'own_field_campaign' AND sex = 'f'), t AS (SELECT individual_id FROM i ORDER BY reverse(individual_id), individual_id LIMIT 3) SELECT id FROM fp WHERE dataorigin = 'own_field_campaign' AND sex = 'f' AND individual_id IN (SELECT individual_id FROM t)")
def sp06(spark, d):
    return S.sample_individuals(fp(spark, d), 3, where=(F.col("dataorigin") == "own_field_campaign") & (F.col("sex") == "f"), order=_len("individual_id")).select("id")


@query(
    "sp07_origin_split",
    f"""WITH {FP}, t AS (SELECT individual_id FROM fp WHERE dataorigin = 'valley_print_survey' UNION (SELECT individual_id FROM (SELECT DISTINCT individual_id FROM fp WHERE dataorigin = 'own_field_campaign' AND sex = 'm') ORDER BY reverse(individual_id), individual_id LIMIT 3))
    SELECT fp.id, CASE WHEN dataorigin = 'partner_collection_south' THEN 'inference' WHEN fp.individual_id IN (SELECT individual_id FROM t) THEN 'test' ELSE 'train' END AS split FROM fp""",
)
def sp07(spark, d):
    f = fp(spark, d).drop("split")
    return S.origin_split(f, ["partner_collection_south"], ["valley_print_survey"], [("own_field_campaign", "m", 3)], order=_len("individual_id")).select("id", "split")


@query("sp09_holdouts", f"WITH {FP}, i AS (SELECT DISTINCT individual_id FROM fp), g AS (SELECT * FROM (VALUES (0), (1)) a(iteration), (VALUES (2), (4)) b(n_val)), r AS (SELECT *, row_number() OVER (PARTITION BY iteration, n_val ORDER BY reverse(individual_id), individual_id) AS k FROM i, g) SELECT iteration, n_val, individual_id FROM r WHERE k <= n_val")
def sp09(spark, d):
    return S.sequential_holdouts(fp(spark, d), (2, 4), 2, order=_len("individual_id"))


@query("sp10_chunked_trails", f"WITH {FP}, r AS (SELECT id, individual_id, row_number() OVER (PARTITION BY individual_id ORDER BY id) AS k, count(*) OVER (PARTITION BY individual_id) AS n FROM fp) SELECT id, CASE WHEN (floor((k - 1) / 9) + 1) * 9 <= n THEN individual_id || '_9_' || (floor((k - 1) / 9) + 1)::INT END AS new_trail FROM r")
def sp10(spark, d):
    return S.chunk_trails(fp(spark, d), 9, order=F.col("id")).select("id", "new_trail")


@query("sp11_diverse_subsamples")
def sp11(spark, d):
    return S.diverse_subsamples(emb(spark, d), (2, 4), candidates=8).select("trail", "size", "sample", "sub_trail", "samples")


# ------------------------------------------------------------------ preprocessing
QS = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in ("area1", "dist1", "ang1"))


@query("ml01_clip", f"WITH {FP}, q AS (SELECT {QS} FROM fp WHERE split = 'train') SELECT id, {', '.join(f'round(least(greatest({c}, lo_{c}), hi_{c}), 6) AS {c}' for c in ('area1', 'dist1', 'ang1'))} FROM fp, q WHERE area1 IS NOT NULL AND dist1 IS NOT NULL AND ang1 IS NOT NULL")
def ml01(spark, d):
    cols = ["area1", "dist1", "ang1"]
    f = fp(spark, d)
    out = P.apply_clip(f, P.fit_clip(f.filter("split = 'train'"), cols)).na.drop(subset=cols)
    return out.select("id", *[r6(F.col(c), c) for c in cols])


@query("ml02_winsorise", f"WITH {FP}, q AS (SELECT avg(area1) - 3 * stddev_pop(area1) AS lo, avg(area1) + 3 * stddev_pop(area1) AS hi FROM fp WHERE split = 'train') SELECT id, round(least(greatest(area1, lo), hi), 6) AS area1 FROM fp, q WHERE area1 IS NOT NULL")
def ml02(spark, d):
    f = fp(spark, d)
    return P.apply_clip(f, P.fit_outliers(f.filter("split = 'train'"), ["area1"], "zscore")).filter("area1 is not null").select("id", r6(F.col("area1"), "area1"))


@query("ml03_density_outliers", f"WITH {FP}, c AS (SELECT id, species, exp(-((v1 - avg(v1) OVER w) ** 2 + (v2 - avg(v2) OVER w) ** 2) / 5000) / (5000 * pi()) AS density FROM fp WHERE v1 IS NOT NULL AND v2 IS NOT NULL WINDOW w AS (PARTITION BY species)), p AS (SELECT species, quantile_cont(density, 0.05) AS q FROM c GROUP BY species) SELECT id, density < q AS outlier FROM c JOIN p USING (species)")
def ml03(spark, d):
    f = fp(spark, d).na.drop(subset=["v1", "v2"])
    return P.density_flags(f, "species", "v1", "v2", bandwidth=50.0).select("id", "outlier")


@query("ml05_standard", f"WITH {FP}, q AS (SELECT avg(area1) AS m, stddev_pop(area1) AS s, avg(dist1) AS m2, stddev_pop(dist1) AS s2 FROM fp WHERE split = 'train') SELECT id, round((area1 - m) / s, 6) AS area1, round((dist1 - m2) / s2, 6) AS dist1 FROM fp, q")
def ml05(spark, d):
    f = fp(spark, d)
    out = P.apply_scale(f, P.fit_standard(f.filter("split = 'train'"), ["area1", "dist1"]))
    return out.select("id", r6(F.col("area1"), "area1"), r6(F.col("dist1"), "dist1"))


@query("ml06_robust", f"WITH {FP}, q AS (SELECT quantile_cont(area1, 0.5) AS m, quantile_cont(area1, 0.75) - quantile_cont(area1, 0.25) AS s FROM fp WHERE split = 'train') SELECT id, round((area1 - m) / s, 6) AS area1 FROM fp, q")
def ml06(spark, d):
    f = fp(spark, d)
    return P.apply_scale(f, P.fit_robust(f.filter("split = 'train'"), ["area1"])).select("id", r6(F.col("area1"), "area1"))


@query("ml09_mean_filled", f"WITH {FP} SELECT id, round(coalesce(t1, avg(t1) OVER ()), 6) AS t1 FROM fp")
def ml09(spark, d):
    f = fp(spark, d)
    return P.apply_fill(f, P.fit_mean(f, ["t1"])).select("id", r6(F.col("t1"), "t1"))


@query("ml12_univariate_top", f"WITH {FP}, {ANOVA} SELECT feature, row_number() OVER (ORDER BY f DESC) AS rank_no FROM f ORDER BY f DESC LIMIT 6")
def ml12(spark, d):
    return P.rank_univariate(fp(spark, d).filter("species <> 'unknown'"), MEASURES, "species").filter("rank_no <= 6").select("feature", "rank_no")


@query("ml22_mutual_information", f"""WITH {FP}, l AS (UNPIVOT (SELECT species, {M_LIST} FROM fp) ON {M_LIST} INTO NAME feature VALUE x), e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
  b AS (SELECT feature, species, least(floor((x - lo) / (hi - lo) * 10), 9) AS b, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL),
  w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, species) AS g, sum(n) OVER (PARTITION BY feature, b) AS m FROM b) SELECT feature, round(sum(n / t * ln(n * t / (g * m))), 6) AS score FROM w GROUP BY feature""")
def ml22(spark, d):
    return P.rank_mutual_information(fp(spark, d), MEASURES, "species").select("feature", r6(F.col("score"), "score"))


# ------------------------------------------------------------------ geometry and overlap
@query("fn07_geometry", f"WITH {FP} SELECT id, round(sqrt((v1 - v3) ** 2 + (v2 - v4) ** 2), 6) AS dist, round(abs((v3 - v1) * (area2 / 10 - v2) - (dist1 - v1) * (v4 - v2)) / 2, 4) AS tri FROM fp WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL AND dist1 IS NOT NULL AND area2 IS NOT NULL")
def fn07(spark, d):
    f = fp(spark, d).na.drop(subset=["v1", "v2", "v3", "v4", "dist1", "area2"])
    a, b, c = G.point(F.col("v1"), F.col("v2")), G.point(F.col("v3"), F.col("v4")), G.point(F.col("dist1"), F.col("area2") / 10)
    return f.select("id", r6(G.point_distance(a, b), "dist"), F.round(G.triangle_area(a, b, c), 4).alias("tri"))


@query("fn08_angles", f"WITH {FP}, p AS (SELECT id, v1 - v3 AS ux, v2 - v4 AS uy, dist1 - v3 AS vx, dist2 - v4 AS vy FROM fp) SELECT id, round(degrees(acos(least(1, greatest(-1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 5) AS angle FROM p WHERE ux IS NOT NULL AND uy IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND ux * ux + uy * uy > 0 AND vx * vx + vy * vy > 0")
def fn08(spark, d):
    f = fp(spark, d)
    a, b, c = G.point(F.col("v1"), F.col("v2")), G.point(F.col("v3"), F.col("v4")), G.point(F.col("dist1"), F.col("dist2"))
    return f.select("id", F.round(G.angle(a, b, c), 5).alias("angle")).filter("angle is not null")


CLOUD = f"""{FP}, c AS (SELECT species || '|' || substrate AS g, v1 AS x, v2 AS y FROM fp WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND substrate <> 'unknown'),
  r AS (SELECT *, x - avg(x) OVER (PARTITION BY g) AS dx, y - avg(y) OVER (PARTITION BY g) AS dy FROM c),
  m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy, stddev_samp(sqrt(dx * dx + dy * dy)) AS sr, stddev_samp(abs(dx) + abs(dy)) AS s1 FROM r GROUP BY g),
  ax AS (SELECT *, greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + cxy ** 2), 0) AS e0, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + cxy ** 2) AS e1, atan2(cxy, (vx - vy) / 2) / 2 AS th FROM m WHERE n >= 2),
  q AS (SELECT -2 * ln(0.5) AS q), j AS (SELECT a.g AS a, b.g AS b, a.mx - b.mx AS dx, a.my - b.my AS dy, a.e0 AS a0, a.e1 AS a1, a.th, b.e0 AS b0, b.e1 AS b1, a.sr AS sa, b.sr AS sb, a.s1 AS ta, b.s1 AS tb, q FROM ax a JOIN ax b ON a.g < b.g, q)"""


@query(
    "fn23_overlap",
    f"""WITH {CLOUD} SELECT a, b, abs(dx * cos(th) + dy * sin(th)) <= sqrt(q) * (sqrt(a1) + sqrt(b1)) AND abs(dy * cos(th) - dx * sin(th)) <= sqrt(q) * (sqrt(a0) + sqrt(b0)) AS ellipse,
    sqrt(dx * dx + dy * dy) <= sqrt(q) * (sa + sb) AS circle, sqrt(dx * dx + dy * dy) <= q * (ta + tb) AS rhombus, sqrt(dx * dx + dy * dy) <= 2 * sqrt(q) * sqrt((sa * sa + sb * sb) / 2) AS pooled FROM j""",
)
def fn23(spark, d):
    m = clouds(spark, d)
    a, b = m.select(F.col("g").alias("a"), F.col("moments").alias("ma")), m.select(F.col("g").alias("b"), F.col("moments").alias("mb"))
    p = a.join(b, F.col("a") < F.col("b"))  # a row a species and ground
    tests = {"ellipse": ellipse_overlap, "circle": circle_overlap, "rhombus": rhombus_overlap, "pooled": pooled_overlap}
    return p.select("a", "b", *[t(F.col("ma"), F.col("mb"), 0.5).alias(n) for n, t in tests.items()])


def clouds(spark, d):
    """Moments of v1 and v2 for each species and ground of at least two prints."""
    f = fp(spark, d).filter("v1 is not null and v2 is not null and substrate <> 'unknown'").select(F.concat_ws("|", "species", "substrate").alias("g"), F.col("v1").alias("x"), F.col("v2").alias("y"))
    return cloud_moments(f, ["g"]).filter("moments.n >= 2")


@query("fn27_regions", f"WITH {CLOUD} SELECT g, round(2 * sqrt(q * e1), 5) AS width, round(2 * sqrt(q * e0), 5) AS height, round(coalesce(sqrt(q) * sr, 0), 5) AS radius, round(coalesce(q * s1, 0), 5) AS half_diagonal FROM ax, q")
def fn27(spark, d):
    s = clouds(spark, d).withColumn("s", region_shape(F.col("moments"), 0.5))
    return s.select("g", *[F.round(f"s.{c}", 5).alias(c) for c in ("width", "height", "radius", "half_diagonal")])


@query("fn28_linear_fit", f"WITH {FP} SELECT species, round(regr_slope(dist1, v1), 6) AS slope, round(regr_intercept(dist1, v1), 4) AS intercept FROM fp WHERE v1 IS NOT NULL AND dist1 IS NOT NULL GROUP BY species HAVING count(*) >= 2")
def fn28(spark, d):
    f = fp(spark, d).na.drop(subset=["v1", "dist1"]).groupBy("species").agg(F.regr_slope("dist1", "v1").alias("s"), F.regr_intercept("dist1", "v1").alias("i"), F.count(F.lit(1)).alias("n"))
    return f.filter("n >= 2").select("species", r6(F.col("s"), "slope"), F.round("i", 4).alias("intercept"))


# ------------------------------------------------------------------ population
@query("cl01_square", f"WITH {EMB} SELECT trail_a_id AS i, trail_b_id AS j, round(euclidean, 6) AS d FROM dist UNION ALL SELECT trail_b_id, trail_a_id, round(euclidean, 6) FROM dist UNION ALL SELECT DISTINCT trail, trail, 0.0 FROM e")
def cl01(spark, d):
    return PO.square_distances(emb_pairs(spark, d), [], "trail_a_id", "trail_b_id", "dist_euclidean").select("i", "j", r6(F.col("d"), "d"))


@query("cl03_complete_trails", f"""WITH {EMB}, q AS (SELECT quantile_cont(euclidean, 0.995) AS q FROM dist), gone AS (SELECT trail_a_id AS t FROM dist, q WHERE euclidean >= q UNION SELECT trail_b_id FROM dist, q WHERE euclidean >= q)
  SELECT trail_a_id AS i, trail_b_id AS j, round(euclidean, 6) AS d FROM dist WHERE trail_a_id NOT IN (SELECT t FROM gone) AND trail_b_id NOT IN (SELECT t FROM gone)""")
def cl03(spark, d):
    """Trails without one of the largest distances, when the pairs that have these are missing."""
    p = emb_pairs(spark, d).select("trail_a_id", "trail_b_id", "dist_euclidean")
    q = p.agg(F.percentile("dist_euclidean", F.lit(0.995)).alias("q"))  # one row
    s = PO.complete_trails(PO.square_distances(p.join(F.broadcast(q)).filter("dist_euclidean < q"), [], "trail_a_id", "trail_b_id", "dist_euclidean"), [])
    return p.join(s.select(F.col("i").alias("trail_a_id"), F.col("j").alias("trail_b_id"), "d"), ["trail_a_id", "trail_b_id"]).select(F.col("trail_a_id").alias("i"), F.col("trail_b_id").alias("j"), r6(F.col("d"), "d"))


@query("cl04_population")
def cl04(spark, d):
    s = PO.square_distances(emb_pairs(spark, d), [], "trail_a_id", "trail_b_id", "dist_euclidean")
    link = PO.merge_heights(s, [])
    grid = link.select("*", F.explode(F.transform(F.sequence(F.lit(4), F.lit(41)), lambda k: k / 10.0)).alias("c"))
    return PO.counts_at(grid, F.col("c")).select("n", "cutoff", "pred_count")


@query("cl05_optimal_cutoff")
def cl05(spark, d):
    s = PO.square_distances(emb_pairs(spark, d), [], "trail_a_id", "trail_b_id", "dist_euclidean")
    c = PO.merge_heights(s, []).withColumn("c", PO.cutoff_range(F.col("heights"), F.col("n"), F.lit(10)))
    return c.select("n", r6(F.col("c.cutoff"), "cutoff"), r6(F.col("c.low"), "low"), r6(F.col("c.high"), "high"))


@query("cl08_v_measure", f"""WITH {FP}, x AS (SELECT species AS t, substrate AS p, count(*) AS n FROM fp GROUP BY ALL), s AS (SELECT sum(n) AS z, sum(n * ln(n)) AS j FROM x), a AS (SELECT sum(m * ln(m)) AS st FROM (SELECT sum(n) AS m FROM x GROUP BY t)), b AS (SELECT sum(m * ln(m)) AS sp FROM (SELECT sum(n) AS m FROM x GROUP BY p)),
  h AS (SELECT 1 - ((sp - j) / z) / (ln(z) - st / z) AS h, 1 - ((st - j) / z) / (ln(z) - sp / z) AS c FROM s, a, b) SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v FROM h""")
def cl08(spark, d):
    v = E.v_measure(fp(spark, d).select("species", "substrate"), "species", "substrate")
    return v.select(*[r6(F.col(c), c) for c in ("homogeneity", "completeness", "v")])


@query("ml17_mds")
def ml17_mds(spark, d):
    """Trails in two coordinates, by distances and by paths over near trails."""
    s = PO.square_distances(emb_pairs(spark, d), [], "trail_a_id", "trail_b_id", "dist_euclidean")
    parts = [x.select(F.lit(n).alias("method"), "trail", r6(F.col("x1"), "x1"), r6(F.col("x2"), "x2")) for n, x in (("mds", PO.mds_points(s, [])), ("isomap", PO.isomap_points(s, [])))]
    return parts[0].unionByName(parts[1])


@query("cl07_fixed_cutoff")
def cl07(spark, d):
    """Counts of each individual's neighbours' trails at one given cutoff."""
    p = emb_pairs(spark, d)
    own = F.explode(F.array("ind_a", "ind_b")).alias("without")
    names = p.select(own).distinct()
    part = names.join(p, (F.col("without") != F.col("ind_a")) & (F.col("without") != F.col("ind_b")))  # a row an individual
    link = PO.merge_heights(PO.square_distances(part, ["without"], "trail_a_id", "trail_b_id", "dist_euclidean"), ["without"])
    truth = part.select("without", F.explode(F.array("ind_a", "ind_b")).alias("i")).groupBy("without").agg(F.countDistinct("i").alias("true_count"))
    out = PO.reevaluated(link.join(truth, "without"), ["without"], 1.0)
    return out.select("without", F.col("true_count").cast("int").alias("true_count"), "pred_count", r6(F.col("erd"), "erd"))


@query(
    "cl10_overlap_sweep",
    f"""WITH {CLOUD}, ps AS (SELECT i, CASE WHEN i = 19 THEN 'inf'::DOUBLE ELSE -2 * ln(1 - (0.1 + i * 0.9 / 19)) END AS cq FROM range(20) t(i)),
    o AS (SELECT i, split_part(a, '|', 1) = split_part(b, '|', 1) AS same, abs(dx * cos(th) + dy * sin(th)) <= sqrt(cq) * (sqrt(a1) + sqrt(b1)) AND abs(dy * cos(th) - dx * sin(th)) <= sqrt(cq) * (sqrt(a0) + sqrt(b0)) AS hit FROM j, ps WHERE a0 + b0 > 0 AND a1 + b1 > 0)
    SELECT i::INT AS step, round((count(*) FILTER (same AND hit) / count(*) FILTER (same) + count(*) FILTER (NOT same AND NOT hit) / count(*) FILTER (NOT same)) / 2, 6) AS bcr FROM o GROUP BY i""",
)
def cl10(spark, d):
    m = clouds(spark, d)
    a, b = m.select(F.col("g").alias("a"), F.col("moments").alias("ma")), m.select(F.col("g").alias("b"), F.col("moments").alias("mb"))
    p = a.join(b, F.col("a") < F.col("b")).withColumn("same", (F.split("a", "[|]")[0] == F.split("b", "[|]")[0]).cast("int"))  # a row a species and ground
    steps = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("step"))
    pv = F.when(F.col("step") == 19, 1.0).otherwise(0.1 + F.col("step") * 0.9 / 19)
    hit = steps.withColumn("hit", ellipse_overlap(F.col("ma"), F.col("mb"), pv).cast("int"))
    return E.confusion(hit, "same", "hit", ["step"]).select("step", r6(F.col("bcr"), "bcr"))
