"""Composed pipelines: projection of pairs, cross-validation, sequential holdout, classification, search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import METRICS
from ..functions.overlap import cloud_moments, ellipse_overlap
from ..operators import kernels as K
from ..operators import preprocess as P
from ..operators import reduction as R
from ..operators.evaluation import classification_scores, concordance, confusion, individual_accuracies, majority_stats, relative_difference, separation
from ..operators.pairs import trail_pairs, trail_table
from ..operators.population import counts_at, cutoff_range, merge_heights, square_distances
from ..operators.splits import sequential_holdouts
from ..sources.stages import Stages


#: The options of the pair pipeline.
SELECTIONS = ("none", "forward", "univariate", "variance", "lasso", "random_forest")
REDUCERS = ("lda", "pca", None, "none")
SCALERS = ("standard", "robust", None, "none")


@dataclass(frozen=True)
class PairConfig:
    """Fixed defaults of the pair pipeline; unknown names are an error."""

    k_features: int = 16
    selection: str = "forward"
    reducer: str | None = "lda"
    n_components: int = 2
    outliers: str | None = None
    scaler: str | None = "standard"

    def __post_init__(self):
        for name, value, known in (("selection", self.selection, SELECTIONS), ("reducer", self.reducer, REDUCERS), ("scaler", self.scaler, SCALERS)):
            if value not in known:
                raise ValueError(f"{name} {value!r} isn't available; use one of {', '.join(str(x) for x in known)}")


def prepared(df: DataFrame, features: Sequence[str], fit_on: DataFrame, config: PairConfig) -> DataFrame:
    """Outliers clipped and features scaled with parameters of ``fit_on``."""
    fit = fit_on
    if config.outliers:
        p = P.fit_outliers(fit, features, config.outliers)
        df, fit = P.apply_clip(df, p), P.apply_clip(fit, p)
    if config.scaler not in (None, "none"):
        p = P.fit_standard(fit, features) if config.scaler == "standard" else P.fit_robust(fit, features)
        df = P.apply_scale(df, p)
    return df


def _cross(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all points of ``a`` to all of ``b``; NaN where a distance has no value."""
    x, y = a[:, None, :], b[None, :, :]
    if metric == "cosine":
        norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return np.where(norm > 0, 1 - (a @ b.T) / np.where(norm > 0, norm, 1), np.nan)
    d = np.abs(x - y)
    if metric == "euclidean":
        return np.sqrt((d**2).sum(axis=-1))
    if metric == "manhattan":
        return d.sum(axis=-1)
    if metric == "chebyshev":
        return d.max(axis=-1)
    if metric == "canberra":
        s = np.abs(x) + np.abs(y)
        return np.where(s > 0, d / np.where(s > 0, s, 1), 0).sum(axis=-1)
    whole = np.abs(x + y).sum(axis=-1)
    return np.where(whole > 0, d.sum(axis=-1) / np.where(whole > 0, whole, 1), np.nan)


def _spread(a: np.ndarray, b: np.ndarray | None, metric: str, block: int = 2000) -> tuple[float | None, float | None]:
    """Mean and median distance of two sets of points, or of the pairs of points of one; points go in blocks."""
    parts = []
    for lo in range(0, len(a), block):
        if b is None:
            d = _cross(a[lo : lo + block], a[lo:], metric)
            parts.append(d[np.triu_indices(len(d), 1, d.shape[1])])
        else:
            parts.append(_cross(a[lo : lo + block], b, metric).ravel())
    flat = np.concatenate(parts) if parts else np.zeros(0)
    flat = flat[~np.isnan(flat)]
    return (float(flat.mean()), float(np.median(flat))) if len(flat) else (None, None)


def _ranked_pair(a: np.ndarray, b: np.ndarray, selection: str, k: int) -> list[tuple[int, float]]:
    """The ``k`` best columns, by their scores, to tell the rows of ``a`` from those of ``b``; ties in the order of columns."""
    x, y = np.vstack([a, b]), np.repeat([0, 1], [len(a), len(b)])
    if selection == "none":
        return [(i, 1.0) for i in range(x.shape[1])]
    if selection == "variance":
        score = np.minimum(x.var(axis=0), np.ptp(x, axis=0))
    elif selection == "univariate":
        within = a.var(axis=0) * len(a) + b.var(axis=0) * len(b)
        between = x.var(axis=0) * len(x) - within
        score = between / np.maximum(within / max(len(x) - 2, 1), 1e-300)
    elif selection == "lasso":
        score = np.abs(K.lasso_cv(x, y.astype(float)))
    else:
        score = K.forest_importances(x, y)
    order = np.argsort(-score, kind="stable")[:k]
    return [(int(i), float(score[i])) for i in order]


_STATS = [f"{s}_{m}_{w}" for m in METRICS for w in ("between", "within_a", "within_b") for s in ("mean", "median")]


def project_pairs(pairs: DataFrame, points: DataFrame, features: Sequence[str], config: PairConfig = PairConfig(), trail: str = "trail", key: str = "id", keys: Sequence[str] = (), rest: DataFrame | None = None, proba: Sequence[str] = (), full: bool = True, inside: str | None = None) -> DataFrame:
    """Each pair in its own projection: features that tell A from B, then LDA of A, B and the rest, or PCA.

    Returns the pair with numbers of observations, centres, selected features and scores and the six
    distances of the centres; if ``full``, also the coordinates of both trails and mean and median of each
    distance between their points and within each (null for a lone point, and where the centres have no
    distance).

    The rest of a pair is all other points, or the points of ``rest`` less those trails of the pair that
    ``inside`` names (a, b, ab or none, which is the default there); it enters through sums, so no task
    holds more than the rows of two trails.  If not ``full``, not even these: trails enter through their
    sums, too, and a trail may have any number of rows; selection is then forward, or none.  ``proba``
    names columns of the points (probabilities of a sex model) that join the selected features; their means
    over A, B and the rest are ``avg_proba_A_0`` and so on.

    Rows with a missing feature take no part.  Pairs whose rest has fewer than two rows, or a trail of
    theirs no complete row, are left out.
    """
    import pyarrow as pa

    features, keys, proba = list(features), list(keys), list(proba)
    p, width = len(features), len(features) + len(proba)
    if not full and config.selection not in ("none", "forward"):
        raise ValueError(f"selection {config.selection!r} needs the trails' rows")
    value = [F.col(c).cast("double") for c in features + proba]
    total = {tuple(r[c] for c in keys): (r["n"], np.array(r["s"]), R.square(r["q"], width)) for r in R.moments(points if rest is None else rest, features + proba, keys).collect()}  # a row a key
    if full:
        pts = points.select(*keys, trail, F.col(key).cast("string").alias("_id"), F.array(*value).alias("_v")).filter(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x)))
        rows = pts.groupBy(*keys, trail).agg(F.sort_array(F.collect_list(F.struct("_id", "_v"))).alias("_r"))
        own = rows.select(*keys, trail, F.flatten(F.transform("_r", lambda x: x["_v"])).alias("_r"))
    else:
        own = R.moments(points, features + proba, [*keys, trail]).select(*keys, trail, F.concat(F.array(F.col("n").cast("double")), "s", "q").alias("_r"))
    side = lambda c, s: own.select(*keys, F.col(trail).alias(c), F.col("_r").alias(f"_r{s}"))
    joined = pairs.join(side("trail_a_id", "a"), [*keys, "trail_a_id"]).join(side("trail_b_id", "b"), [*keys, "trail_b_id"])
    # a pair costs time, not bytes: partitions of a given number aren't merged by size
    joined = joined.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trail_a_id", "trail_b_id")
    types = dict(joined.dtypes)
    carry = [c for c in joined.columns if c not in ("_ra", "_rb")]
    k_f, k_c, reducer, selection = min(config.k_features, p), config.n_components, config.reducer, config.selection
    inside = ("ab" if rest is None else "") if inside is None else inside
    numbers = [(f"avg_proba_{g}_{j}", "double") for g in ("A", "B", "R") for j in range(len(proba))]
    lists = [("center_a", "array<double>"), ("center_b", "array<double>"), ("center_r", "array<double>"), ("selected_features", "array<string>"), ("selected_scores", "array<double>")]
    extra = [("min_observations", "int"), ("max_observations", "int"), *[(f"dist_{m}", "double") for m in METRICS], *numbers, *lists]
    if full:
        extra += [("coords_a", "array<array<double>>"), ("coords_b", "array<array<double>>"), *[(c, "double") for c in _STATS]]
    arrow = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}

    def sums(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if full:
            x = flat.reshape(-1, width)
            return len(x), x.sum(axis=0), x.T @ x
        return flat[0], flat[1 : width + 1], R.square(flat[width + 1 :], width)

    def projected(a: tuple, b: tuple, all_: tuple, chosen: list[tuple[int, float]], ra: np.ndarray, rb: np.ndarray) -> dict | None:
        r = tuple(x - ("a" in inside) * y - ("b" in inside) * z for x, y, z in zip(all_, a, b))
        n, s, q = (x + y + z for x, y, z in zip(r, a, b))
        at = [i for i, _ in chosen] + list(range(p, width))
        mean, parts = s / n, (a, b, r)
        means = [x[1] / x[0] for x in parts]
        if reducer == "lda":
            pick = np.ix_(at, at)
            within = sum(x[2][pick] - np.outer(x[1][at], x[1][at]) / x[0] for x in parts) / max(n - 3, 1)
            between = sum(x[0] * np.outer(m[at] - mean[at], m[at] - mean[at]) for x, m in zip(parts, means)) / 2
            axes = R.lda_axes(within, between, min(k_c, 2, len(at)))
        elif reducer == "pca":
            axes, _ = R.pca_axes((q - n * np.outer(mean, mean))[np.ix_(at, at)] / max(n - 1, 1), min(k_c, len(at)))
        else:
            axes = np.eye(len(at))
        centre = [(m[at] - mean[at]) @ axes for m in means]
        dist = {m: float(_cross(centre[0][None], centre[1][None], m)[0, 0]) for m in METRICS}
        out = {"min_observations": int(min(a[0], b[0])), "max_observations": int(max(a[0], b[0]))}
        out |= {f"dist_{m}": d for m, d in dist.items()} | {f"center_{g}": c.tolist() for g, c in zip("abr", centre)}
        out |= {f"avg_proba_{g}_{j}": float(m[p + j]) for g, m in zip("ABR", means) for j in range(len(proba))}
        out |= {"selected_features": [features[i] for i, _ in chosen], "selected_scores": [x for _, x in chosen]}
        if full:
            ca, cb = (ra[:, at] - mean[at]) @ axes, (rb[:, at] - mean[at]) @ axes
            out |= {"coords_a": ca.tolist(), "coords_b": cb.tolist()}
            for m in METRICS:
                for where, (x, y) in (("between", (ca, cb)), ("within_a", (ca, None)), ("within_b", (cb, None))):
                    got = (None, None) if np.isnan(dist[m]) or (y is None and len(x) < 2) else _spread(x, y, m)
                    out[f"mean_{m}_{where}"], out[f"median_{m}_{where}"] = got
        return out

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                index = {c: k for k, c in enumerate(part.schema.names)}
                raw = [[x.values.to_numpy(zero_copy_only=False) for x in part.column(index[c])] for c in ("_ra", "_rb")]
                of = list(zip(*[part.column(index[c]).to_pylist() for c in keys])) if keys else [()] * part.num_rows
                both = [(sums(x), sums(y)) for x, y in zip(*raw)]
                good = [k for k in range(part.num_rows) if of[k] in total and total[of[k]][0] - sum(both[k][j][0] for j, x in enumerate("ab") if x in inside) >= 2]
                if not good:
                    continue
                shaped = [[x.reshape(-1, width) if full else None for x in raw[j]] for j in (0, 1)]
                if selection == "forward":
                    n = np.array([both[k][0][0] + both[k][1][0] for k in good])
                    sab, qab = (np.array([both[k][0][j] + both[k][1][j] for k in good]) for j in (1, 2))
                    scatter = qab[:, :p, :p] - sab[:, :p, None] * sab[:, None, :p] / n[:, None, None]
                    within = np.array([sum(x[2][:p, :p] - np.outer(x[1][:p], x[1][:p]) / x[0] for x in both[k]) for k in good])
                    taken, score = K.forward_batch(within, scatter, n, 2, k_f)
                    chosen = [[(int(i), float(f)) for i, f in zip(t, c)] for t, c in zip(taken, score)]
                elif full:
                    chosen = [_ranked_pair(shaped[0][k][:, :p], shaped[1][k][:, :p], selection, k_f) for k in good]
                else:
                    chosen = [[(i, 1.0) for i in range(p)]] * len(good)
                made = [projected(*both[k], total[of[k]], c, shaped[0][k], shaped[1][k]) for k, c in zip(good, chosen)]
                kept = part.take(pa.array(good))
                columns = [kept.column(index[c]) for c in carry] + [pa.array([m[c] for m in made], arrow[t]) for c, t in extra]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *[c for c, _ in extra]])

    schema = [f"`{c}` {types[c]}" for c in carry] + [f"{c} {t}" for c, t in extra]
    return joined.mapInArrow(run, ", ".join(schema))


def overlap_predictions(projected: DataFrame, p: float = 0.95) -> DataFrame:
    """``projected`` with ``pred_same``: do the ellipses of the first two coordinates overlap?"""
    keyed = projected.withColumn("_k", F.xxhash64("trail_a_id", "trail_b_id", *[c for c in ("iteration", "n_val", "fold") if c in projected.columns]))
    side = lambda s: cloud_moments(keyed.select("_k", F.explode(f"coords_{s}").alias("c")).select("_k", F.col("c")[0].alias("x"), F.coalesce(F.get("c", F.lit(1)), F.lit(0.0)).alias("y")), ["_k"]).withColumnRenamed("moments", f"m{s}")
    d = keyed.join(side("a"), "_k").join(side("b"), "_k")
    return d.withColumn("pred_same", ellipse_overlap(F.col("ma"), F.col("mb"), p).cast("int")).drop("_k", "ma", "mb")


def sequential_holdout(df: DataFrame, features: Sequence[str], sizes: Sequence[int] = (2, 4, 6, 8), iterations: int = 3, config: PairConfig = PairConfig(), p: float = 0.95, seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """Split table and summary: for each draw of individuals, decisions of their trail pairs and a population estimate.

    The split table has confusion, BCR, optimal cutoff and, at the draw's own optimal cutoff, predicted
    and true counts with ERD; the summary has the mean rates, the global cutoff and the concordance of
    counts predicted at it.  A draw is a key, not a loop.
    """
    ids = sequential_holdouts(df, sizes, iterations, seed=seed)
    key = ["iteration", "n_val"]
    points = df.join(ids, "individual_id")
    per = points.select(*key, "trail").distinct()
    trails = trail_table(df).join(per.withColumnRenamed("trail", "trail_id"), "trail_id")
    pairs = trail_pairs(trails, key)
    stages = Stages(df.sparkSession, "holdout")
    flat = stages.write(prepared(points, features, df, config), "points")
    projected = stages.write(project_pairs(stages.write(pairs, "pairs"), flat, features, config, keys=key), "projected")
    res = stages.write(overlap_predictions(projected, p).withColumn("true_same", F.col("same_individual").cast("int")), "decided")
    conf = confusion(res, "true_same", "pred_same", key)
    link = merge_heights(square_distances(res, key, "trail_a_id", "trail_b_id", "dist_euclidean"), key)
    truth = points.groupBy(*key).agg(F.countDistinct("individual_id").alias("true_count"))
    cut = link.join(truth, key).filter("true_count <= n").withColumn("c", cutoff_range(F.col("heights"), F.col("n"), F.col("true_count")))
    mid = cut.agg(F.percentile("c.cutoff", F.lit(0.5)).alias("global_cutoff"))  # one row
    est = counts_at(cut.crossJoin(mid), F.col("global_cutoff")).withColumn("erd", relative_difference("pred_count", "true_count"))
    conf, est = stages.write(conf, "confusion"), stages.write(est.drop("heights"), "estimates")
    table = conf.join(est.select(*key, "true_count", "pred_count", "erd", F.col("c.cutoff").alias("cutoff"), F.col("c.low").alias("low"), F.col("c.high").alias("high"), "global_cutoff"), key)
    scores = table.agg(F.avg("bcr").alias("bcr"), F.avg("erd").alias("erd"), concordance("pred_count", "true_count").alias("ccc"))
    summary = scores.crossJoin(global_cutoff(table))  # one row each
    return table, summary


def global_cutoff(splits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean and median of the splits' cutoffs, and the means of their ranges)."""
    return splits.groupBy(*keys).agg(F.avg("cutoff").alias("mean_cutoff"), F.percentile("cutoff", F.lit(0.5)).alias("median_cutoff"), F.avg("low").alias("mean_low"), F.avg("high").alias("mean_high"))


def fold_predictions(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", rank: str | None = None, k: int = 8, model: str = "lda_svd") -> DataFrame:
    """``df`` with out-of-fold ``pred_<target>``: each fold's rows by a model of the other folds; rows of no fold by all folds.

    A fold's scaler, ranking and model are fitted on the others.  Models: lda_svd (also lda), logistic,
    forest, gbt.  Of a target with two classes ``proba_<target>`` is the probability of the later one.
    """
    stages = Stages(df.sparkSession, "folds")
    df = stages.write(df, "rows")
    folds = [r[0] for r in df.select(fold).filter(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]  # a row a fold
    out = None
    for f in [*folds, None]:
        fit = df.filter(F.col(fold).isNotNull() & (F.col(fold) != f)) if f is not None else df.filter(F.col(fold).isNotNull())
        use = df.filter(F.col(fold) == f) if f is not None else df.filter(F.col(fold).isNull())
        part = _fit_predict(fit, use, features, target, rank, k, model)
        out = part if out is None else out.unionByName(part)
    return out


def _fit_predict(fit: DataFrame, use: DataFrame, features: Sequence[str], target: str, rank: str | None, k: int, model: str) -> DataFrame:
    fill = P.fit_mean(fit, features)
    fit, use = P.apply_fill(fit, fill), P.apply_fill(use.withColumns({f"_keep_{c}": F.col(c) for c in features}), fill)
    scale = P.fit_standard(fit, features)
    fit, use = P.apply_scale(fit, scale), P.apply_scale(use, scale)
    if rank:
        ranking = {"variance": P.rank_variance, "univariate": lambda d, f: P.rank_univariate(d, f, target), "forest": lambda d, f: P.rank_forest(d, f, target)}[rank](fit, features)
        used = [r["feature"] for r in ranking.orderBy("rank_no").limit(k).collect()]
    else:
        used = list(features)
    name = f"pred_{target}"
    if model in ("lda", "lda_svd"):
        got = R.lda_predict(use, R.fit_lda(fit, used, target), name)
        if f"{name}_proba" in got.columns:
            got = got.withColumnRenamed(f"{name}_proba", f"proba_{target}")
    else:
        from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
        from pyspark.ml.functions import vector_to_array

        made = {"logistic": LogisticRegression(maxIter=200), "forest": RandomForestClassifier(numTrees=100, seed=99), "gbt": GBTClassifier(maxIter=50, seed=99)}[model]
        made = made.setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("_p")
        index = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(fit.filter(F.col(target).isNotNull()))
        asm = VectorAssembler(inputCols=used, outputCol="_x")
        m = made.fit(asm.transform(index.transform(fit.filter(F.col(target).isNotNull()))))
        got = IndexToString(inputCol="_p", outputCol=name, labels=index.labels).transform(m.transform(asm.transform(use)))
        if len(index.labels) == 2:
            got = got.withColumn(f"proba_{target}", vector_to_array("probability")[1])
        got = got.drop("_x", "_p", "rawPrediction", "probability")
    cols = [c for c in got.columns if not c.startswith("_keep_") and c not in features]
    return got.select(*cols, *[F.col(f"_keep_{c}").alias(c) for c in features])


def predict_all(train: DataFrame, others: DataFrame, features: Sequence[str], target: str, fold: str = "fold", split: str = "split", **how) -> DataFrame:
    """All rows with predictions and their split: train rows out of fold, others by a model of all train rows.

    Train rows without a fold are predicted by the model of all folds, too.
    """
    rows = train.withColumn(split, F.lit("train")).unionByName(others.withColumn(fold, F.lit(None).cast(train.schema[fold].dataType)), allowMissingColumns=True)
    return fold_predictions(rows, features, target, fold, **how)


#: The scores of a search, all to be maximised.
SEARCH_SCORES = ("accuracy", "balanced_accuracy", "f1", "precision", "recall", "roc_auc", "neg_log_loss")


def sampled_candidates(spaces: dict[str, Sequence], n: int, seed: int = 99) -> list[dict]:
    """``n`` different combinations of the options, drawn by a seed; all of them in order, if there are no more."""
    names, sizes = list(spaces), [len(v) for v in spaces.values()]
    whole = int(np.prod(sizes))
    at = range(whole) if whole <= n else np.random.default_rng(seed).choice(whole, n, replace=False)
    return [{k: spaces[k][int(i)] for k, i in zip(names, np.unravel_index(int(x), sizes))} for x in at]


def classification_search(df: DataFrame, features: Sequence[str], target: str, spaces: dict[str, Sequence], models: Sequence[str] = ("lda_svd", "gbt"), n: int = 50, fold: str = "fold", one: str = "m", seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """All candidates and the best of each model key by each score.

    (model, candidate, options, mean_ and std_ of each score over the folds, mean_rank) and (model, best_metric,
    candidate, score).  Candidates are drawn by a seed for each model key, as many as ``n`` or as there are;
    each is fitted on all folds but one.  mean_rank is the mean of the ranks by each score, ties sharing
    theirs; it is a best_metric, too, the smallest being best.  Of equal ones the earlier candidate is taken.
    """
    from ..operators.evaluation import log_loss, roc_auc

    stages = Stages(df.sparkSession, "search")
    df = stages.write(df.filter(F.col(fold).isNotNull() & F.col(target).isNotNull()), "rows")
    parts, options = [], []
    for model in models:
        for c, how in enumerate(sampled_candidates(spaces, n, seed)):
            pred = fold_predictions(df, features, target, fold, model=model, **how)
            parts.append(pred.select(F.lit(model).alias("model"), F.lit(c).alias("candidate"), fold, (F.col(target) == one).cast("int").alias("t"), (F.col(f"pred_{target}") == one).cast("int").alias("p"), F.col(f"proba_{target}").alias("q")))
            options.append((model, c, {k: str(v) for k, v in how.items()}))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows, key = stages.write(rows, "predictions"), ["model", "candidate", fold]
    by = classification_scores(rows, "t", "p", key).join(roc_auc(rows, "t", "q", key).withColumnRenamed("auc", "roc_auc"), key, "left").join(rows.groupBy(*key).agg((-log_loss("t", "q")).alias("neg_log_loss")), key, "left")
    scores = by.groupBy("model", "candidate").agg(*[f(x).alias(f"{n}_{x}") for x in SEARCH_SCORES for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    ranks = [F.rank().over(Window.partitionBy("model").orderBy(F.col(f"mean_{x}").desc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy("model", f"mean_{x}")) - 1) / 2 for x in SEARCH_SCORES]  # a row a candidate
    scores = scores.withColumn("mean_rank", sum(ranks[1:], ranks[0]) / len(ranks))
    table = stages.write(scores.join(df.sparkSession.createDataFrame(options, "model string, candidate int, options map<string,string>"), ["model", "candidate"]), "scores")
    long = table.select("model", "candidate", F.explode(F.array(*[F.struct(F.lit(x).alias("best_metric"), F.col(f"mean_{x}").alias("score")) for x in SEARCH_SCORES], F.struct(F.lit("mean_rank").alias("best_metric"), (-F.col("mean_rank")).alias("score")))).alias("e")).select("model", "candidate", "e.*")
    best = long.groupBy("model", "best_metric").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("candidate"))).alias("b"))
    return table, best.select("model", "best_metric", "b.candidate", F.when(F.col("best_metric") == "mean_rank", -F.col("b.score")).otherwise(F.col("b.score")).alias("score"))


def pair_search(df: DataFrame, features: Sequence[str], spaces: dict[str, Sequence], n: int = 10, fold: str = "fold", seed: int = 99) -> DataFrame:
    """(candidate, options of a pair configuration, separation, rank_no): configurations drawn by a seed, by the mean separation of their folds."""
    from ..operators.evaluation import separation

    out, names = None, list(spaces)
    for c, how in enumerate(sampled_candidates(spaces, n, seed)):
        res = cross_validated_pairs(df, features, PairConfig(**how), fold, full=False)
        part = res.groupBy(fold).agg(separation(F.col("same_individual").cast("int"), "dist_euclidean").alias("s")).agg(F.avg("s").alias("separation"))
        part = part.select(F.lit(c).alias("candidate"), *[F.lit(None if how[k] is None else str(how[k])).cast("string").alias(k) for k in names], "separation")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank_no", F.row_number().over(Window.orderBy(F.col("separation").desc_nulls_last(), "candidate")))  # a row a candidate


def left_out_effect(df: DataFrame, features: Sequence[str], focal: str, config: PairConfig = PairConfig(), p: float = 0.95, trail: str = "trail", key: str = "id", individual: str = "individual_id") -> DataFrame:
    """(footprint_id, bcr, delta_bcr): what the BCR of one trail's pairs with all other trails loses without each of its prints.

    Rows are ordered by delta_bcr, largest first.  Each print left out makes a trail of the remaining ones,
    which is projected against every other trail, the rest being all rows that are in neither.  A trail of
    the same individual is needed for a BCR, else it is null; so it is for a trail of one print.
    """
    stages = Stages(df.sparkSession, "left_out")
    flat = stages.write(prepared(df.filter(F.col(trail).isNotNull()), features, df, config), "points")
    own, others = flat.filter(F.col(trail) == focal), flat.filter(F.col(trail) != focal)
    outs = own.select(F.col(trail), F.col(key).cast("string").alias("_out")).unionByName(own.select(trail, F.lit("").alias("_out")).limit(1))
    name = F.concat_ws("\x1f", F.col(trail), F.col("_out"))
    points = own.join(outs, trail).filter(F.col(key).cast("string") != F.col("_out")).withColumn(trail, name).drop("_out").unionByName(others)
    side = lambda d, x: d.groupBy(trail).agg(F.min(individual).alias(f"ind_{x}"))
    a = side(own, "a").join(outs, trail).select(F.lit(1).alias("_k"), "_out", "ind_a", name.alias("trail_a_id"))
    b = side(others, "b").select(F.lit(1).alias("_k"), "ind_b", F.col(trail).alias("trail_b_id"))
    pairs = stages.write(a.join(b, "_k").select("_out", "trail_a_id", "trail_b_id", (F.col("ind_a") == F.col("ind_b")).alias("same_individual")), "pairs")
    got = project_pairs(pairs, points, features, config, trail, key, rest=others, inside="b")
    res = overlap_predictions(stages.write(got.select("_out", "trail_a_id", "trail_b_id", "same_individual", "coords_a", "coords_b"), "projected"), p)
    bcr = stages.write(confusion(res.withColumn("true_same", F.col("same_individual").cast("int")), "true_same", "pred_same", ["_out"]).select("_out", "bcr"), "bcr")
    whole = bcr.filter("_out = ''").select(F.col("bcr").alias("full"))  # one row
    each = outs.filter("_out <> ''").join(bcr, "_out", "left").join(F.broadcast(whole), how="left")
    return each.select(F.col("_out").alias("footprint_id"), "bcr", (F.col("full") - F.col("bcr")).alias("delta_bcr")).orderBy(F.col("delta_bcr").desc_nulls_last(), "footprint_id")


def classification_report(pred: DataFrame, target: str, individual: str = "individual_id", one: str = "m") -> DataFrame:
    """One row: scores by print, individual accuracies and majority votes of predictions of a two-class target."""
    d = pred.filter(F.col(target).isNotNull()).withColumns({"_t": (F.col(target) == one).cast("int"), "_p": (F.col(f"pred_{target}") == one).cast("int")})
    return classification_scores(d, "_t", "_p").crossJoin(individual_accuracies(d, individual, "_t", "_p")).crossJoin(majority_stats(d, individual, "_t", "_p"))  # one row each


def distance_benchmark(pairs: DataFrame, distances: Sequence[str], truth: str, keys: Sequence[str] = (), variance: float | None = None) -> DataFrame:
    """Resubstitution decisions of an LDA on distance columns, whole or on the axes that hold ``variance``: (keys, confusion, rates)."""
    d = pairs.filter(F.col(truth).isNotNull()).na.drop(subset=list(distances))
    d = P.apply_scale(d, P.fit_standard(d, distances))
    cols = list(distances)
    if variance:
        model = R.fit_pca(d, cols, None, variance)
        d = R.project(d, model)
        cols = [f"PCA{k + 1}" for k in range(model["axes"].shape[1])]
    d = R.lda_predict(d, R.fit_lda(d, cols, truth, 1), "pred")
    return confusion(d, truth, "pred", keys)


def search_score(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, separation): the score by which pair configurations are compared."""
    return results.groupBy(*keys).agg(separation(F.col("same_individual").cast("int"), "dist_euclidean").alias("separation"))


def cross_validated_pairs(df: DataFrame, features: Sequence[str], config: PairConfig = PairConfig(), fold: str = "fold", full: bool = True) -> DataFrame:
    """Projected pairs of each fold's trails, parameters fitted on that fold's points; the fold is a key, not a loop."""
    stages = Stages(df.sparkSession, "cv")
    points = df.filter(F.col(fold).isNotNull())
    pairs = trail_pairs(trail_table(points, fold=fold), ["fold"]).drop("fold").withColumn(fold, F.col("fold_a"))
    keep = ["trail_a_id", "trail_b_id", "ind_a", "ind_b", "same_individual", fold]
    flat = stages.write(prepared(points, features, points, config), "points")
    return project_pairs(stages.write(pairs.select(*keep), "pairs"), flat, features, config, keys=[fold], full=full).withColumn("origin", F.lit("cv"))


def baseline_pairs(train: DataFrame, other: DataFrame, features: Sequence[str], config: PairConfig = PairConfig(), origin: str = "test") -> DataFrame:
    """Projected pairs of another split's trails, all train rows being the rest of each pair."""
    stages = Stages(train.sparkSession, "baseline")
    rest = train.withColumns({"trail": F.lit("_rest"), "_of": F.lit("train")})
    both = prepared(other.withColumn("_of", F.lit(origin)).unionByName(rest, allowMissingColumns=True), features, train, config)
    flat = stages.write(both, "points")
    pairs = trail_pairs(trail_table(other)).select("trail_a_id", "trail_b_id", "ind_a", "ind_b", "same_individual")
    own, rest = flat.filter(F.col("_of") == origin), flat.filter(F.col("_of") == "train")
    return project_pairs(stages.write(pairs, "pairs"), own, features, config, rest=rest).withColumn("origin", F.lit(origin))


def embedding_pairs(train: DataFrame, use: DataFrame, features: Sequence[str], individual: str = "individual_id", k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs of trails by the distances of their centroids in a supervised embedding, and a logistic decision.

    The embedding is an LDA of individuals and the decision is fitted on the train pairs; returned are
    the train pairs (resubstitution) and those of ``use`` (held out), with ``pred_same`` and ``proba``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ..operators.pairs import centroid_distances, centroids

    stages = Stages(train.sparkSession, "embedding")
    model = R.fit_lda(train, features, individual, k)
    axes = [f"LDA{i + 1}" for i in range(model["axes"].shape[1])]
    asm = VectorAssembler(inputCols=[f"dist_{m}" for m in METRICS], outputCol="_x", handleInvalid="skip")

    def pairs_of(df: DataFrame, name: str) -> DataFrame:
        p = R.project(df, model).withColumn("vec", F.array(*axes)).filter(F.col(axes[0]).isNotNull())
        c = centroids(p, ["trail"])
        out = centroid_distances(trail_pairs(trail_table(df)).select("trail_a_id", "trail_b_id", "same_individual"), c, "trail")
        return stages.write(asm.transform(out.fillna(0.0, [f"dist_{m}" for m in METRICS])).withColumn("_y", F.col("same_individual").cast("double")), name)

    a, b = pairs_of(train, "train"), pairs_of(use, "use")
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=200).fit(a.filter("_y is not null"))
    from pyspark.ml.functions import vector_to_array

    done = lambda d: fit.transform(d).withColumns({"proba": vector_to_array("probability")[1], "pred_same": F.col("prediction").cast("int")}).drop("_x", "_y", "rawPrediction", "probability", "prediction")
    return done(a), done(b)


def experiments(df: DataFrame, features: Sequence[str], configs: Sequence[PairConfig], fold: str = "fold", p: float = 0.95) -> DataFrame:
    """(k_features, selection, reducer, fold, confusion, rates): cross-validated decisions of each configuration."""
    out = None
    for c in configs:
        stages = Stages(df.sparkSession, "experiment")
        res = overlap_predictions(stages.write(cross_validated_pairs(df, features, c, fold), "pairs"), p).withColumn("true_same", F.col("same_individual").cast("int"))
        part = confusion(res, "true_same", "pred_same", [fold]).select(F.lit(c.k_features).alias("k_features"), F.lit(c.selection).alias("selection"), F.lit(c.reducer).alias("reducer"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ feature pipelines
#: How a fitted stage is applied: its kind to a function of table and parameters.
APPLY = {
    "fill": P.apply_fill,
    "clip": P.apply_clip,
    "scale": P.apply_scale,
    "project": R.project,
    "predict": lambda df, m: R.lda_predict(df, m, m["name"]),
    "model": lambda df, m: m["model"].transform(df).drop("_x", "_y", "_p", "rawPrediction", "probability"),
}


def _rank(name: str):
    how = {"variance": lambda d, f, t: P.rank_variance(d, f), "univariate": P.rank_univariate, "forest": P.rank_forest, "mutual_information": P.rank_mutual_information}

    def fit(pipe: FeaturePipeline, df: DataFrame, cols: list[str]):
        if name == "lasso":
            ends = df.agg(F.min(pipe.target).alias("a"), F.max(pipe.target).alias("b")).first()
            ranking = P.rank_lasso(df.withColumn("_t", F.when(F.col(pipe.target) == ends["b"], 1).when(F.col(pipe.target) == ends["a"], 0)), cols, "_t")
        elif name == "forward":
            ranking = P.forward_selection(df, cols, pipe.target, pipe.k)
        else:
            ranking = how[name](df, cols, pipe.target)
        return [], [r["feature"] for r in ranking.orderBy("rank_no").limit(pipe.k).collect()]  # a row a feature

    return fit


def _reduced(name: str):
    def fit(pipe: FeaturePipeline, df: DataFrame, cols: list[str]):
        red = R.fit_reducer(df, cols, name, pipe.target, pipe.n)
        return [("project", red)], [f"{red['prefix']}{i + 1}" for i in range(red["axes"].shape[1])]

    return fit


def _classified(name: str):
    def fit(pipe: FeaturePipeline, df: DataFrame, cols: list[str]):
        out = f"pred_{pipe.target}"
        if name in ("lda", "lda_svd"):
            return [("predict", R.fit_lda(df, cols, pipe.target) | {"name": out})], cols
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

        known = df.filter(F.col(pipe.target).isNotNull())
        index = StringIndexer(inputCol=pipe.target, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(known)
        made = {"logistic": LogisticRegression(maxIter=200), "forest": RandomForestClassifier(numTrees=100, seed=99), "gbt": GBTClassifier(maxIter=50, seed=99)}[name].setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("_p")
        steps = [VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip"), made, IndexToString(inputCol="_p", outputCol=out, labels=index.labels)]
        return [("model", {"model": Pipeline(stages=steps).fit(index.transform(known))})], cols

    return fit


def _parameters(kind: str, fit):
    return lambda pipe, df, cols: ([(kind, P.parameter_rows(fit(df, cols)))], cols)


#: The steps in their order, and the fits of their options.  A fit takes the pipeline, the rows and the feature columns,
#: and returns the stages to add and the columns after them.
STEPS = {
    "impute": {"mean": _parameters("fill", P.fit_mean), "median": _parameters("fill", P.fit_median)},
    "outliers": {m: _parameters("clip", lambda d, c, m=m: P.fit_outliers(d, c, m)) for m in ("clip", "zscore", *P.CLIP_PRESETS)},
    "scale": {"standard": _parameters("scale", P.fit_standard), "robust": _parameters("scale", P.fit_robust)},
    "reduce_pre": {m: _reduced(m) for m in ("pca", "lda")},
    "select": {m: _rank(m) for m in ("variance", "univariate", "forest", "lasso", "forward", "mutual_information")},
    "reduce": {m: _reduced(m) for m in ("pca", "lda")},
    "classify": {m: _classified(m) for m in ("lda", "lda_svd", "logistic", "forest", "gbt")},
}


def register_step(step: str, name: str, fit, kind: str | None = None, apply=None) -> None:
    """Add an option of a step: ``fit`` as in ``STEPS``, and how stages of a new ``kind`` are applied."""
    if step not in STEPS:
        raise ValueError(f"step {step!r} is none of {', '.join(STEPS)}")
    STEPS[step][name] = fit
    if kind:
        APPLY[kind] = apply


class FeaturePipeline:
    """Ordered fit / apply stages; see ``STEPS``.  None and ``none`` leave a step out, unknown options are an error."""

    def __init__(self, features: Sequence[str], target: str, k: int = 8, n_components: int = 2, **options):
        for step, o in options.items():
            if step not in STEPS:
                raise ValueError(f"step {step!r} is none of {', '.join(STEPS)}")
            if o not in (None, "none") and o not in STEPS[step]:
                raise ValueError(f"{step}: {o!r} is none of {', '.join(STEPS[step])}")
        self.features, self.target, self.k, self.n, self.options = list(features), target, k, n_components, options
        self.stages: list[tuple[str, dict]] = []
        self.selected = list(features)

    def fit(self, df: DataFrame) -> FeaturePipeline:
        self.stages, cols = [], self.features
        for step, fits in STEPS.items():
            o = self.options.get(step)
            if o in (None, "none"):
                continue
            added, cols = fits[o](self, df, cols)
            for kind, params in added:
                df = APPLY[kind](df, params)
            self.stages += added
        self.selected = list(cols)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for kind, params in self.stages:
            df = APPLY[kind](df, params)
        return df

    def save(self, spark, path: str) -> None:
        """Write the fitted pipeline: parameters as one row of JSON, models of Spark in folders beside it."""
        import json

        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        rows = []
        for i, (kind, params) in enumerate(self.stages):
            if kind == "model":
                params["model"].write().overwrite().save(f"{path}/model-{i}")
            rows.append([kind, {} if kind == "model" else {k: plain(v) for k, v in params.items()}])
        head = {"features": self.features, "target": self.target, "k": self.k, "n": self.n, "options": self.options, "selected": self.selected, "stages": rows}
        spark.createDataFrame([(json.dumps(head),)], "pipeline string").coalesce(1).write.mode("overwrite").parquet(f"{path}/pipeline")

    @classmethod
    def load(cls, spark, path: str) -> FeaturePipeline:
        """A pipeline that ``save`` wrote."""
        import json

        from pyspark.ml import PipelineModel

        head = json.loads(spark.read.parquet(f"{path}/pipeline").first()[0])
        out = cls(head["features"], head["target"], head["k"], head["n"], **head["options"])
        arrays = {"mean", "axes", "variance", "class_means", "priors", "within"}
        for i, (kind, params) in enumerate(head["stages"]):
            params = {k: np.array(v) if k in arrays else v for k, v in params.items()}
            out.stages.append((kind, {"model": PipelineModel.load(f"{path}/model-{i}")} if kind == "model" else params))
        out.selected = head["selected"]
        return out


def feature_shape(df: DataFrame, features: Sequence[str], group: str = "sex", individual: str = "individual_id") -> DataFrame:
    """(feature, individual, group, mean): means of the feature that the groups explain best, one row an individual."""
    best = P.rank_univariate(df, features, group).orderBy("rank_no").first()["feature"]
    return df.filter(F.col(best).isNotNull()).groupBy(individual, group).agg(F.avg(best).alias("mean")).withColumn("feature", F.lit(best))


def distance_weights(pairs: DataFrame, distances: Sequence[str], truth: str, model: str = "logistic") -> DataFrame:
    """(distance, weight, rank_no): logistic coefficients by size, or importances of boosted trees, of a decision on distances."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = pairs.filter(F.col(truth).isNotNull()).na.drop(subset=list(distances))
    d = P.apply_scale(d, P.fit_standard(d, distances))
    d = VectorAssembler(inputCols=list(distances), outputCol="_x").transform(d).withColumn("_y", F.col(truth).cast("double"))
    if model == "logistic":
        w = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=200).fit(d).coefficients.toArray()
    else:
        w = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, seed=99).fit(d).featureImportances.toArray()
    rows = sorted(zip(distances, map(float, w)), key=lambda x: -abs(x[1]))
    return pairs.sparkSession.createDataFrame([(c, x, k) for k, (c, x) in enumerate(rows, 1)], "distance string, weight double, rank_no int")


def write_splits(df: DataFrame, path: str, by_origin: dict | None = None, dataset: str = "species") -> None:
    """Split each data set and write it, one folder a data set and split; by data origin where ``by_origin`` says how."""
    from ..operators.splits import origin_split, stratified_split

    out = origin_split(df.drop("split"), **by_origin) if by_origin else stratified_split(df.drop("split"))
    out.write.mode("overwrite").option("compression", "gzip").partitionBy(dataset, "split").parquet(path)
