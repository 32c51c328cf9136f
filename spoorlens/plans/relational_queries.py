"""Queries of scans, projections, joins, windows, sorts and sets over the project's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import UNKNOWN, label_form
from ..functions.texts import short_label, standard_sex, subsample_size, trailing_number, truth_flag
from ..operators import cleaning as C
from ..operators import pairs as PR
from ..operators.evaluation import with_mean_rank
from ..sources import sinks
from ..sources.readers import flatten_results, load_trail_splits, merge_masters, read_csv
from ..sources.stages import Stages
from .registry import query, table
from .sqltext import FP, MP, SEX_SQL, base_sql, label_sql


def fp(spark, d):
    return C.footprint_table(table(spark, d, "footprints"))


def mp(spark, d):
    return C.pair_table(table(spark, d, "master_pairs"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ------------------------------------------------------------------ scans and sinks
@query("io01_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io01(spark, d):
    at = Stages(spark, "csv").path("nation")
    table(spark, d, "nation").write.option("header", True).csv(at)
    return read_csv(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("io04_running_id", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey, p_name FROM part")
def io04(spark, d):
    return C.running_id(table(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"]).select("id", "p_partkey", "p_name")


@query("io05_pruned_scan", "SELECT tag, count(*) AS n FROM master_pairs GROUP BY tag")
def io05(spark, d):
    return table(spark, d, "master_pairs").select("tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("io08_json_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def io08(spark, d):
    at = Stages(spark, "json").path("supplier")
    s = table(spark, d, "supplier")
    sinks.write_json_records(s, at)
    return spark.read.schema(s.schema).json(at)


@query("io13_trail_splits", f"WITH {FP} SELECT id, split, trail FROM fp WHERE split IN ('train', 'test') AND trail <> 'unknown'")
def io13(spark, d):
    f = fp(spark, d).withColumnRenamed("trail", "Trail")
    return load_trail_splits([f.filter("split = 'train'"), f.filter("split = 'test'")]).select("id", "split", "trail")


@query("io15_append_once", "SELECT record_id, species, model_key, mean_cv_f1 FROM best_models")
def io15(spark, d):
    b = table(spark, d, "best_models").select("record_id", "species", "model_key", "mean_cv_f1", "finished_at")
    old, new = b.filter("finished_at < timestamp_ntz'2022-01-01'"), b.filter("finished_at >= timestamp_ntz'2021-01-01' or finished_at is null")
    return sinks.merged(old, new, ["record_id"]).drop("finished_at")


@query("io16_merged_masters", "SELECT pipeline AS species, count(*) AS n, count(DISTINCT trail_a_id) AS n_trails FROM master_pairs WHERE origin = 'test' GROUP BY pipeline")
def io16(spark, d):
    m = table(spark, d, "master_pairs").drop("species")
    parts = {p: m.filter(F.col("pipeline") == p) for p in ("rcv_lda", "siamese", "umap_supervised")}
    return merge_masters(parts, "test").groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trail_a_id").alias("n_trails"))


@query("io20_flat_results", "SELECT record_id, model_key AS method, mean_cv_accuracy AS accuracy, mean_cv_f1 AS f1 FROM best_models WHERE model_key IS NOT NULL AND NOT isnan(mean_cv_accuracy) AND NOT isnan(mean_cv_f1)")
def io20(spark, d):
    b = table(spark, d, "best_models").filter("model_key is not null and not isnan(mean_cv_accuracy) and not isnan(mean_cv_f1) and mean_cv_accuracy is not null and mean_cv_f1 is not null")
    packed = b.select("record_id", F.to_json(F.create_map("model_key", F.create_map(F.lit("accuracy"), "mean_cv_accuracy", F.lit("f1"), "mean_cv_f1"))).alias("j"))
    return flatten_results(packed, "j").select("record_id", "method", F.col("cells")["accuracy"].alias("accuracy"), F.col("cells")["f1"].alias("f1"))


# ------------------------------------------------------------------ projections and filters
@query("pf03_majority_numeric", "SELECT c_custkey, c_acctbal AS bal, c_name FROM customer")
def pf03(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("bal"), "c_name")
    return C.majority_numeric(c)


@query("pf04_features_to_double", f"SELECT id, {', '.join(f'CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END AS {c}' for c in C.MEASURES)} FROM footprints")
def pf04(spark, d):
    f = table(spark, d, "footprints").select("id", *[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in C.MEASURES])
    return C.features_to_double(f)


@query("pf06_labels", f"SELECT id, {label_sql('species')} AS species, {label_sql('individual_id')} AS individual_id, {label_sql('trail')} AS trail, {label_sql('dataorigin')} AS dataorigin FROM footprints")
def pf06(spark, d):
    return C.with_clean_labels(table(spark, d, "footprints").select("id", "species", "individual_id", "trail", "dataorigin"), ["species", "individual_id", "trail", "dataorigin"])


@query("pf07_remap", f"SELECT species, count(*) AS n FROM (SELECT CASE {label_sql('species')} WHEN 'amur_tiger' THEN 'tiger' WHEN 'bengal_tiger' THEN 'tiger' ELSE {label_sql('species')} END AS species FROM footprints) GROUP BY species")
def pf07(spark, d):
    f = C.with_clean_labels(table(spark, d, "footprints").select("species"), ["species"], {"species": {"amur_tiger": "tiger", "bengal_tiger": "tiger"}})
    return f.groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@query("pf08_sex", f"SELECT id, CASE {SEX_SQL} WHEN 'f' THEN 'Female' WHEN 'm' THEN 'Male' ELSE 'Unknown' END AS sex FROM footprints")
def pf08(spark, d):
    return table(spark, d, "footprints").select("id", standard_sex("sex").alias("sex"))


@query("pf11_filters", f"WITH {FP} SELECT id FROM fp WHERE sex IN ('f', 'm') AND split = 'train' AND trail <> 'unknown' AND area1 > 4000")
def pf11(spark, d):
    return C.known_trails(fp(spark, d)).filter(F.col("sex").isin("f", "m") & (F.col("split") == "train") & (F.col("area1") > 4000)).select("id")


@query("pf12_complete_rows", f"WITH {FP} SELECT id FROM fp WHERE v1 IS NOT NULL AND area1 IS NOT NULL AND dist1 IS NOT NULL AND ang1 IS NOT NULL")
def pf12(spark, d):
    return fp(spark, d).na.drop(subset=["v1", "area1", "dist1", "ang1"]).select("id")


@query("pf18_truth", "SELECT CASE WHEN same_individual IS NULL THEN NULL WHEN lower(trim(same_individual)) IN ('true', '1', '1.0', 'yes', 'same') THEN 1 ELSE 0 END AS truth, count(*) AS n FROM master_pairs GROUP BY 1")
def pf18(spark, d):
    return table(spark, d, "master_pairs").groupBy(truth_flag("same_individual").alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query("pf19_one_hot", f"WITH {FP} SELECT id, (sex = 'f')::INT AS sex_f, (sex = 'm')::INT AS sex_m, (sex = 'unknown')::INT AS sex_unknown FROM fp")
def pf19(spark, d):
    return C.one_hot(fp(spark, d).select("id", "sex"), "sex", ("f", "m", "unknown")).drop("sex")


@query("pf20_codes", f"WITH {FP}, s AS (SELECT species, dense_rank() OVER (ORDER BY species) - 1 AS code, dense_rank() OVER (ORDER BY p) - 1 AS seen FROM (SELECT species, min(id) AS p FROM fp GROUP BY species)) SELECT id, code, seen FROM fp JOIN s USING (species)")
def pf20(spark, d):
    f = C.with_codes(fp(spark, d).select("id", "species"), "species", "code")
    return C.with_codes(f, "species", "seen", first_seen="id").select("id", "code", "seen")


@query(
    "pf21_display",
    f"""WITH {FP}, i AS (SELECT individual_id, row_number() OVER (ORDER BY min(id), individual_id) AS i FROM fp GROUP BY individual_id),
    t AS (SELECT individual_id, trail, row_number() OVER (PARTITION BY individual_id ORDER BY min(id), trail) AS j FROM fp GROUP BY individual_id, trail)
    SELECT individual_id, trail, 'Ind_' || i AS display_individual, 'Ind_' || i || '_trail_orig_' || j AS display_trail FROM t JOIN i USING (individual_id)""",
)
def pf21(spark, d):
    return C.display_labels(fp(spark, d))


@query("pf24_gaps", "SELECT count(*) AS n_rows, 3 AS n_columns, count(*) FILTER (v1 IS NULL OR isnan(v1)) + count(*) FILTER (area1 IS NULL OR isnan(area1)) AS n_null, count(*) FILTER (isinf(v1)) + count(*) FILTER (isinf(area1)) AS n_inf FROM footprints")
def pf24(spark, d):
    return C.report_gaps(table(spark, d, "footprints").select("id", "v1", "area1"), ["v1", "area1"])


@query("pf25_short_labels", f"SELECT DISTINCT t AS trail, CASE WHEN len(p) > 1 THEN p[len(p) - 1] || '_' || p[len(p)] WHEN len(p) = 1 THEN p[1] ELSE '' END AS short FROM (SELECT {label_sql('trail')} AS t, list_filter(string_split({label_sql('trail')}, '_'), lambda x: x <> 'eo') AS p FROM footprints)")
def pf25(spark, d):
    t = table(spark, d, "footprints").select(label_form("trail").alias("trail")).distinct()
    return t.select("trail", short_label("trail", ["eo"]).alias("short"))


@query("fn03_sub_size", f"SELECT comparison_id, TRY_CAST(nullif(regexp_extract({label_sql('trail_a_id')}, '_sub(\\d+)_', 1), '') AS INT) AS size_a, regexp_extract({label_sql('trail_b_id')}, '(\\d+)$', 1) AS end_b FROM master_pairs")
def fn03(spark, d):
    m = table(spark, d, "master_pairs")
    return m.select("comparison_id", subsample_size(label_form("trail_a_id")).alias("size_a"), trailing_number(label_form("trail_b_id")).alias("end_b"))


@query("fn04_base_trails", f"SELECT comparison_id, {base_sql('trail_a_id')} AS a, {base_sql('trail_b_id')} AS b FROM master_pairs")
def fn04(spark, d):
    return mp(spark, d).select("comparison_id", "a", "b")


@query("fn06_tags", "SELECT record_id, model_key || '|' || select__method || '|' || select__k AS tag FROM best_models WHERE model_key IS NOT NULL AND select__method IS NOT NULL AND select__k IS NOT NULL")
def fn06(spark, d):
    b = table(spark, d, "best_models").na.drop(subset=["model_key", "select__method", "select__k"])
    return b.select("record_id", F.concat_ws("|", "model_key", "select__method", "select__k").alias("tag"))


# ------------------------------------------------------------------ joins
@query("jn03_merged_predictions", f"WITH {FP} SELECT f.id, f.split, (o.v1 > 150)::INT AS pred_large FROM fp f LEFT JOIN (SELECT id, v1 FROM fp WHERE v1 IS NOT NULL) o USING (id)")
def jn03(spark, d):
    f = fp(spark, d)
    preds = f.filter("v1 is not null").select("id", (F.col("v1") > 150).cast("int").alias("pred_large"), "sex")
    return PR.merged_predictions(f.select("id", "split").withColumn("pred_large", F.lit(None).cast("int")), preds)


@query("jn04_trail_mean", f"WITH {FP} SELECT id, trail, round(avg(area1) OVER (PARTITION BY species, trail), 6) AS trail_mean FROM fp WHERE area1 IS NOT NULL")
def jn04(spark, d):
    f = fp(spark, d).filter("area1 is not null")
    return C.with_group_mean(f, "area1", ["species", "trail"], "m").select("id", "trail", r6(F.col("m"), "trail_mean"))


@query("jn05_many_to_one", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn05(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return PR.validated_join(o, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"]).drop("c_custkey")


@query("jn06_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def jn06(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(n, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("jn07_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 200000)")
def jn07(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("jn09_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def jn09(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("jn14_fold_from_trails", f"WITH {FP}, {MP}, t AS (SELECT nullif(nullif(split_part(trail, '_sub', 1), 'unknown'), '') AS t, max(fold) AS f FROM fp WHERE split = 'train' GROUP BY 1) SELECT comparison_id, coalesce(mp.fold, x.f, y.f) AS fold FROM mp LEFT JOIN t x ON x.t = mp.a LEFT JOIN t y ON y.t = mp.b")
def jn14(spark, d):
    f = fp(spark, d).filter("split = 'train'").select(F.substring_index("trail", "_sub", 1).alias("t"), "fold").filter(f"t <> '{UNKNOWN}' and t <> ''").groupBy("t").agg(F.max("fold").alias("f"))
    m = mp(spark, d).select("comparison_id", "a", "b", "fold")
    m = m.join(f.select(F.col("t").alias("a"), F.col("f").alias("fa")), "a", "left").join(f.select(F.col("t").alias("b"), F.col("f").alias("fb")), "b", "left")
    return m.select("comparison_id", F.coalesce("fold", "fa", "fb").alias("fold"))


@query(
    "jn15_nearest",
    """WITH g AS (SELECT p_brand, avg(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand)
    SELECT g.p_brand, min_by(p.p_partkey, (round(abs(p.p_retailprice - g.p_retailprice), 9), p.p_retailprice, p.p_partkey)) AS nearest_p_partkey FROM g JOIN part p USING (p_brand) GROUP BY g.p_brand""",
)
def jn15(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_retailprice", "p_partkey")
    one = p.groupBy("p_brand", "p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    g = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("p_retailprice"))
    return PR.nearest_value(g, one, "p_retailprice", ["p_brand"]).select("p_brand", "nearest_p_partkey")


@query("jn16_grid", "SELECT k, method, scaler FROM (VALUES (4), (8), (16)) a(k), (VALUES ('anova'), ('lasso')) b(method), (VALUES ('standard'), ('robust')) c(scaler)")
def jn16(spark, d):
    return PR.parameter_grid(spark, k=[4, 8, 16], method=["anova", "lasso"], scaler=["standard", "robust"]).select(F.col("k").cast("int").alias("k"), "method", "scaler")


# ------------------------------------------------------------------ windows, sorts, limits
@query("wn03_mean_rank", f"SELECT record_id, (r1 + r2) / 2 AS mean_rank FROM (SELECT record_id, rank() OVER (PARTITION BY model_key ORDER BY a DESC) + (count(*) OVER (PARTITION BY model_key, a) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY model_key ORDER BY f DESC) + (count(*) OVER (PARTITION BY model_key, f) - 1) / 2.0 AS r2 FROM (SELECT record_id, {label_sql('model_key')} AS model_key, mean_cv_accuracy AS a, mean_cv_f1 AS f FROM best_models WHERE NOT isnan(mean_cv_accuracy) AND NOT isnan(mean_cv_f1)))")
def wn03(spark, d):
    b = table(spark, d, "best_models").filter("not isnan(mean_cv_accuracy) and not isnan(mean_cv_f1)").select("record_id", label_form("model_key").alias("model_key"), F.col("mean_cv_accuracy").alias("a"), F.col("mean_cv_f1").alias("f"))
    for c, r in (("a", "r1"), ("f", "r2")):
        b = with_mean_rank(b, c, ["model_key"], r, ascending=False)
    return b.select("record_id", ((F.col("r1") + F.col("r2")) / 2).alias("mean_rank"))


@query("wn05_best_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def wn05(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("wn06_extreme_row", "SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -l_orderkey, -l_linenumber)) AS top_line, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_suppkey")
def wn06(spark, d):
    line = table(spark, d, "lineitem")
    return line.groupBy("l_suppkey").agg(F.max_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("top_line"), F.max("l_extendedprice").alias("top_price"))


@query("so02_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def so02(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20)


@query("so05_first_of_class", f"WITH {MP} SELECT same, pred, min(comparison_id) AS comparison_id FROM (SELECT *, (euclidean < 1)::INT AS pred FROM mp WHERE euclidean IS NOT NULL AND same IS NOT NULL) GROUP BY same, pred")
def so05(spark, d):
    m = mp(spark, d).filter("euclidean is not null and same is not null").withColumn("pred", (F.col("euclidean") < 1).cast("int"))
    return m.groupBy("same", "pred").agg(F.min("comparison_id").alias("comparison_id"))


@query("so06_best_metric", f"SELECT species, max_by(record_id, (s, -record_id)) AS record_id, max(s) AS score FROM (SELECT {label_sql('species')} AS species, record_id, mean_cv_balanced_accuracy AS s FROM best_models WHERE mean_cv_balanced_accuracy BETWEEN 0 AND 1 AND NOT isnan(mean_cv_balanced_accuracy)) GROUP BY species")
def so06(spark, d):
    b = table(spark, d, "best_models")
    s = C.present(b, ["mean_cv_balanced_accuracy", "mean_cv_accuracy"])
    b = b.select(label_form("species").alias("species"), "record_id", F.col(s).alias("s")).filter("s between 0 and 1 and not isnan(s)")
    return b.groupBy("species").agg(F.max_by("record_id", F.struct("s", -F.col("record_id"))).alias("record_id"), F.max("s").alias("score"))


# ------------------------------------------------------------------ sets
@query("se01_union_ragged", "SELECT s_name AS name, s_acctbal AS bal, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def se01(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("se02_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def se02(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("se03_dedupe", "SELECT DISTINCT species, model_key, pipeline_id FROM best_models")
def se03(spark, d):
    return table(spark, d, "best_models").select("species", "model_key", "pipeline_id").dropDuplicates()


@query("se04_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45")
def se04(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity >= 45").select("l_partkey"))


@query("se05_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def se05(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("se06_both_sides", f"WITH {MP} SELECT a AS trail FROM mp WHERE a IS NOT NULL UNION SELECT b FROM mp WHERE b IS NOT NULL")
def se06(spark, d):
    return mp(spark, d).select(F.explode(F.array("a", "b")).alias("trail")).filter("trail is not null").distinct()


@query("se07_jaccard", "WITH p AS (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem GROUP BY ALL), n AS (SELECT s, count(*) AS n FROM p GROUP BY s), x AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM p a JOIN p b ON a.p = b.p AND b.s = a.s + 1 GROUP BY ALL) SELECT a, b, round(c / (u.n + v.n - c), 6) AS jaccard FROM x JOIN n u ON u.s = a JOIN n v ON v.s = b")
def se07(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.collect_set("l_partkey").alias("pa"))
    n = s.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("pa").alias("pb"))
    j = F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb"))
    return s.join(n, "a").select("a", "b", r6(j, "jaccard")).filter("jaccard > 0")
