"""Fit on training rows, apply anywhere: clipping, scaling, imputation and feature rankings.

A fit is a small table of parameters, one row a feature; ``apply`` turns it into literals of one
projection, so the fact table is read once and never joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import long_features
from .evaluation import anova
from .quantiles import column_quantiles

#: Named presets.
CLIP_PRESETS = {"clip_98": (0.01, 0.99), "clip_90": (0.05, 0.95)}
Z_LIMIT = 3.0


def _params(df: DataFrame, features: Sequence[str], **how) -> DataFrame:
    """(feature, parameters): one aggregate over all features at once, turned to rows."""
    aggs = [F.struct(F.lit(c).alias("feature"), *[f(F.col(c).cast("double")).alias(n) for n, f in how.items()]).alias(f"p{k}") for k, c in enumerate(features)]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"p{k}") for k in range(len(features))])).alias("p")).select("p.*")


def fit_clip(df: DataFrame, features: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(feature, lo, hi): exact quantiles with linear interpolation."""
    q = column_quantiles(df, features, [lo, hi])
    return df.sparkSession.createDataFrame([(c, *q[c]) for c in features], "feature string, lo double, hi double")


def fit_zscore(df: DataFrame, features: Sequence[str], z: float = Z_LIMIT) -> DataFrame:
    """(feature, lo, hi): mean less and plus z population deviations."""
    return _params(df, features, lo=lambda c: F.avg(c) - z * F.stddev_pop(c), hi=lambda c: F.avg(c) + z * F.stddev_pop(c))


def fit_outliers(df: DataFrame, features: Sequence[str], method: str = "clip_98") -> DataFrame:
    """The parameters of a named method: clip, a clip preset, or zscore."""
    if method == "zscore":
        return fit_zscore(df, features)
    if method != "clip" and method not in CLIP_PRESETS:
        raise ValueError(f"outlier method {method!r} is none of clip, zscore, {', '.join(CLIP_PRESETS)}")
    return fit_clip(df, features, *CLIP_PRESETS.get(method, (0.01, 0.99)))


def parameter_rows(params: DataFrame | dict) -> dict[str, dict]:
    """Fitted parameters by feature; they may have been fetched before."""
    return params if isinstance(params, dict) else {r["feature"]: r.asDict() for r in params.collect()}  # a row a feature


def apply_clip(df: DataFrame, params: DataFrame) -> DataFrame:
    """Values below lo become lo and above hi become hi; null stays null, and an unfitted feature as it is."""
    p = parameter_rows(params)
    lim = lambda c, r: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(r["lo"])), F.lit(r["hi"])))
    return df.withColumns({c: lim(c, r) for c, r in p.items() if r["lo"] is not None and c in df.columns})


def fit_standard(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, centre, scale): mean and population deviation, a deviation of 0 counting as 1."""
    return _params(df, features, centre=F.avg, scale=lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)))


def fit_robust(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, centre, scale): median and distance of the quartiles, 0 counting as 1."""
    q = column_quantiles(df, features, [0.25, 0.5, 0.75])
    rows = [(c, q[c][1], None if q[c][1] is None else (q[c][2] - q[c][0]) or 1.0) for c in features]
    return df.sparkSession.createDataFrame(rows, "feature string, centre double, scale double")


def apply_scale(df: DataFrame, params: DataFrame) -> DataFrame:
    """(value - centre) / scale of each fitted feature."""
    p = parameter_rows(params)
    return df.withColumns({c: (F.col(c) - F.lit(r["centre"])) / F.lit(r["scale"]) for c, r in p.items() if r["centre"] is not None and c in df.columns})


def fit_mean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, fill)."""
    return _params(df, features, fill=F.avg)


def fit_median(df: DataFrame, features: Sequence[str]) -> DataFrame:
    q = column_quantiles(df, features, [0.5])
    return df.sparkSession.createDataFrame([(c, q[c][0]) for c in features], "feature string, fill double")


def apply_fill(df: DataFrame, params: DataFrame) -> DataFrame:
    """Missing values (null, NaN) of each fitted feature filled."""
    p = parameter_rows(params)
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(r["fill"])) for c, r in p.items() if c in df.columns})


def iterative_impute(df: DataFrame, features: Sequence[str], key: str, trees: int = 10, rounds: int = 10, depth: int = 6, seed: int = 99) -> DataFrame:
    """Missing values from forests of the other features, feature by feature and round by round.

    Starts from medians; rounds end early when no value moves by more than 0.1 % of its feature's
    deviation.  Each round is written as a table.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from ..sources.stages import Stages

    stages = Stages(df.sparkSession, "impute")
    features = list(features)
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in features]).first()
    gaps = sorted([c for c in features if counts[c]], key=lambda c: counts[c])
    if not gaps:
        return df
    marked = df.withColumns({f"_gap_{c}": F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in gaps})
    now = stages.write(apply_fill(marked, fit_median(df, features)), "start")
    spread = parameter_rows(fit_standard(now, gaps))
    for k in range(rounds):
        before = now
        for c in gaps:
            rest = [x for x in features if x != c]
            asm = VectorAssembler(inputCols=rest, outputCol="_x", handleInvalid="keep")
            have = asm.transform(now.filter(~F.col(f"_gap_{c}")))
            if have.limit(1).count() == 0:
                continue
            model = RandomForestRegressor(featuresCol="_x", labelCol=c, predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed).fit(have)
            now = model.transform(asm.transform(now)).withColumn(c, F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
        now = stages.write(now, f"round{k}")
        moved = now.alias("a").join(before.alias("b"), key).agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in gaps]).first()
        if all((moved[c] or 0) <= 1e-3 * spread[c]["scale"] for c in gaps):
            break
    return now.drop(*[f"_gap_{c}" for c in gaps])


# ------------------------------------------------------------------ outlier rows
def density_flags(df: DataFrame, group: str, x: str, y: str, bandwidth: float = 1.0, percentile: float = 0.05) -> DataFrame:
    """``df`` with ``density`` of a round Gaussian around the group's mean, and ``outlier`` below the group's percentile.

    Means and percentiles, partial before their shuffles, are joined back, so no group's rows meet in one
    task; null groups are equal.
    """

    def joined(d: DataFrame, by: DataFrame) -> DataFrame:
        return d.join(by, d[group].eqNullSafe(by["_g"])).drop("_g")

    d = joined(df, df.groupBy(F.col(group).alias("_g")).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my")))
    r2 = (F.col(x) - F.col("_mx")) ** 2 + (F.col(y) - F.col("_my")) ** 2
    h2 = bandwidth * bandwidth
    d = d.withColumn("density", F.exp(-r2 / (2 * h2)) / (2 * np.pi * h2)).drop("_mx", "_my")
    d = joined(d, d.groupBy(F.col(group).alias("_g")).agg(F.percentile("density", F.lit(percentile)).alias("_cut")))
    return d.withColumn("outlier", F.col("density") < F.col("_cut")).drop("_cut")


def iterative_density_filter(df: DataFrame, group: str, x: str, y: str, percentiles: Sequence[float] = (0.20, 0.05, 0.01), bandwidth: float = 1.0) -> DataFrame:
    """Passes of ``density_flags`` that drop the outliers of each."""
    for p in percentiles:
        df = density_flags(df, group, x, y, bandwidth, p).filter(~F.col("outlier")).drop("density", "outlier")
    return df


def filter_report(before: DataFrame, after: DataFrame, individual: str) -> DataFrame:
    """Rows before, after and removed; least, greatest, mean and deviation of rows an individual keeps; individuals with fewer than three."""
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    per = after.groupBy(individual).agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_after"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count_if(F.col("n") < 3).alias("n_small"))
    return b.crossJoin(a).withColumn("n_removed", F.col("n_before") - F.col("n_after"))  # one row each


# ------------------------------------------------------------------ rankings
def _ranked(scores: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, score, rank_no): highest score first, ties in the order of the columns; null scores last."""
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    return scores.select("feature", "score", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), place)).alias("rank_no"))  # a row a feature


def rank_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return _ranked(_params(df, features, score=F.var_pop), features)


def rank_univariate(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """By one-way F."""
    return _ranked(anova(long_features(df, [group], features), group).select("feature", F.col("f").alias("score")), features)


def rank_none(df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = [(c, 1.0) for c in features]
    return _ranked(df.sparkSession.createDataFrame(rows, "feature string, score double"), features)


def rank_forest(df: DataFrame, features: Sequence[str], group: str, trees: int = 100, seed: int = 99) -> DataFrame:
    """By impurity importance in a random forest; rows with a missing feature are left out."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    d = df.select(group, *features).na.drop()
    d = StringIndexer(inputCol=group, outputCol="_y").fit(d).transform(d)
    d = VectorAssembler(inputCols=list(features), outputCol="_x").transform(d)
    imp = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed).fit(d).featureImportances.toArray()
    return _ranked(df.sparkSession.createDataFrame([(c, float(s)) for c, s in zip(features, imp)], "feature string, score double"), features)


def rank_lasso(df: DataFrame, features: Sequence[str], target: str, folds: int = 3, seed: int = 99) -> DataFrame:
    """By absolute coefficient of a cross-validated lasso on standardised, mean-filled features."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    d = apply_fill(df, fit_mean(df, features))
    d = apply_scale(d, fit_standard(d, features)).filter(F.col(target).isNotNull())
    d = VectorAssembler(inputCols=list(features), outputCol="_x").transform(d).select("_x", F.col(target).cast("double").alias("_y"))
    lr = LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, standardization=False)
    grid = ParamGridBuilder().addGrid(lr.regParam, [float(x) for x in np.logspace(-3, 0, 10)]).build()
    best = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="_y"), numFolds=folds, seed=seed).fit(d).bestModel
    return _ranked(df.sparkSession.createDataFrame([(c, abs(float(x))) for c, x in zip(features, best.coefficients)], "feature string, score double"), features)


def rank_mutual_information(df: DataFrame, features: Sequence[str], group: str, bins: int = 10) -> DataFrame:
    """By mutual information of the group and the feature in equal-width bins (a variant of the nearest-neighbour estimate)."""
    long = long_features(df.filter(F.col(group).isNotNull()), [group], features).filter("value is not null and not isnan(value)")
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row a feature
    b = long.join(F.broadcast(ends), "feature").withColumn("b", F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0)))
    n = b.groupBy("feature", group, "b").agg(F.count(F.lit(1)).alias("n"))
    w = lambda *k: Window.partitionBy("feature", *k)
    n = n.withColumns({"whole": F.sum("n").over(w()), "g": F.sum("n").over(w(group)), "m": F.sum("n").over(w("b"))})
    mi = F.sum(F.col("n") / F.col("whole") * F.log(F.col("n") * F.col("whole") / (F.col("g") * F.col("m"))))
    return _ranked(n.groupBy("feature").agg(mi.alias("score")), features)


def forward_order(x: np.ndarray, groups: np.ndarray, k: int, ridge: float = 1e-6) -> list[tuple[int, float]]:
    """(column, partial F) of greedy forward selection: each step takes the feature that the groups explain best beyond those taken.

    The F of a candidate compares the residuals of the candidate on the taken features with and without
    group indicators.  Ties go to the earlier column.
    """
    n, p = x.shape
    labels = np.unique(groups)
    dummies = (groups[:, None] == labels[None, 1:]).astype(float)
    taken: list[tuple[int, float]] = []
    for _ in range(min(k, p)):
        base = np.column_stack([np.ones(n), *[x[:, i] for i, _ in taken]])
        full = np.column_stack([base, dummies])
        df1, df2 = max(len(labels) - 1, 1), max(n - np.linalg.matrix_rank(full), 1)

        def rss(design: np.ndarray) -> np.ndarray:
            beta = np.linalg.pinv(design.T @ design + ridge * np.eye(design.shape[1])) @ design.T @ x
            return ((x - design @ beta) ** 2).sum(axis=0)

        r0, r1 = rss(base), rss(full)
        f = ((r0 - r1) / df1) / np.maximum(r1 / df2, 1e-12)
        f[[i for i, _ in taken]] = -np.inf
        best = int(np.argmax(f))
        taken.append((best, float(f[best])))
    return taken


def forward_selection(df: DataFrame, features: Sequence[str], group: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rank_no, feature, score): forward selection within each key; rows with a missing feature are left out.

    It needs the sums of each group only, so a task holds a row a group and no key's rows.  Keys with two
    rows or fewer have none.
    """
    import pandas as pd

    from .kernels import forward_moments
    from .reduction import moments, square

    features, keys = list(features), list(keys)
    m = moments(df.filter(F.col(group).isNotNull()), features, [*keys, group])
    types = dict(m.dtypes)
    if not keys:
        m = m.withColumn("_all", F.lit(0))  # a row a group

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].to_numpy(float), np.array(pdf["s"].tolist())
        q = np.array([square(x, len(features)) for x in pdf["q"]])
        within = (q - s[:, :, None] * s[:, None, :] / n[:, None, None]).sum(axis=0)
        total = q.sum(axis=0) - np.outer(s.sum(axis=0), s.sum(axis=0)) / n.sum()
        got = forward_moments(within, total, int(n.sum()), len(n), min(k, len(features))) if n.sum() > 2 else []
        out = pd.DataFrame([(i + 1, features[c], f) for i, (c, f) in enumerate(got)], columns=["rank_no", "feature", "score"])
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return m.groupBy(*(keys or ["_all"])).applyInPandas(one, ", ".join([f"`{c}` {types[c]}" for c in keys] + ["rank_no int", "feature string", "score double"]))


def select_features(df: DataFrame, ranking: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the ``k`` best ranked features, best first."""
    best = [r["feature"] for r in ranking.orderBy("rank_no").limit(k).collect()]  # a row a feature
    return df.select(*[c for c in keep if c in df.columns], *best)


def min_max_by(df: DataFrame, value: str, keys: Sequence[str]) -> Column:
    """Value scaled to 0..1 within the keys; 0 where they hold one value."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)), F.lit(0.0))
