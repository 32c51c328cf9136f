"""Metrics of decisions and scores as aggregates: confusion, rates, accuracies, agreement, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import subsample_size


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confusion_cells(true: str | Column, pred: str | Column) -> list[Column]:
    """tp, fn, fp, tn of two 0 / 1 columns; rows where either is null are left out."""
    t, p = _col(true), _col(pred)
    return [F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))]


def rates(tp: str = "tp", fn: str = "fn", fp: str = "fp", tn: str = "tn") -> dict[str, Column]:
    """tpr, tnr and bcr, their mean; null where a class is empty."""
    c = F.col
    tpr, tnr = F.try_divide(c(tp), c(tp) + c(fn)), F.try_divide(c(tn), c(tn) + c(fp))
    return {"tpr": tpr, "tnr": tnr, "bcr": (tpr + tnr) / 2}


def confusion(df: DataFrame, true: str | Column, pred: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tp, fn, fp, tn, tpr, tnr, bcr)."""
    return df.groupBy(*keys).agg(*confusion_cells(true, pred)).withColumns(rates())


def classification_scores(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 of the class 1; 0 where a denominator is 0."""
    c = df.groupBy(*keys).agg(*confusion_cells(true, pred))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.withColumns({"accuracy": z(tp + tn, tp + fn + fp + tn), "balanced_accuracy": (z(tp, tp + fn) + z(tn, tn + fp)) / 2, "precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "f1": z(2 * tp, 2 * tp + fp + fn)})


def log_loss(true: str | Column, proba: str | Column, eps: float = 1e-15) -> Column:
    """Mean negative log likelihood of probabilities of class 1."""
    t, p = _col(true), F.least(F.greatest(_col(proba), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(t == 1, F.log(p)).when(t == 0, F.log(1 - p)))


def running_before(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, bins: int = 1024) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of equal keys whose ``order``, a number, is smaller.

    Values of ``order`` lie in bins between the least and the greatest of their key; sums run over the bins
    and then within a bin, so a key's rows are never sorted in one task.  Rows of equal order get different
    sums: they should have been added up before.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    d = df.join(ends, keys) if keys else df.join(F.broadcast(ends))  # one row without keys
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(order) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)), F.lit(0))
    d = d.withColumn("_bin", at).drop("_lo", "_hi")
    up = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows a key
    sums = d.groupBy(*keys, "_bin").agg(F.sum(value).alias("_s")).select(*keys, "_bin", F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, [*keys, "_bin"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_bin", "_before", "_inner")


def roc_auc(df: DataFrame, true: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc): the area under the ROC curve as the rank sum of class 1, ties at their mean rank.

    Scores are counted by value first, so equal scores are one row in the running sum.
    """
    by = df.filter(F.col(true).isin(0, 1) & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(true) == 1).alias("_p"), F.count_if(F.col(true) == 0).alias("_n"))
    won = running_before(by, keys, "_s", "_n", "_b").withColumn("_w", F.col("_p") * (F.col("_b") + F.col("_n") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum("_n")).alias("auc"))


def with_mean_rank(df: DataFrame, value: str, keys: Sequence[str], name: str, ascending: bool = True) -> DataFrame:
    """``df`` with ``name``: the rank of a numeric ``value`` among the rows of equal keys, ties at their mean rank, nulls last.

    Rows are counted by value and the counts summed in two levels, so no key's rows are sorted in one task.
    Rows with a null key have no rank.
    """
    keys = list(keys)
    by = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    known = by.filter("_v is not null").withColumn("_o", F.col("_v").cast("double") * (1 if ascending else -1))
    ranked = running_before(known, keys, "_o", "_c", "_b").select(*keys, "_v", (F.col("_b") + (F.col("_c") + 1) / 2.0).alias(name))
    whole = known.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    last = by.filter("_v is null")
    last = (last.join(whole, keys, "left") if keys else last.join(F.broadcast(whole))).select(*keys, "_v", (F.coalesce("_n", F.lit(0)) + (F.col("_c") + 1) / 2.0).alias(name))
    r = ranked.unionByName(last).withColumnsRenamed({c: f"_k{j}" for j, c in enumerate(keys)})
    on = [df[c] == r[f"_k{j}"] for j, c in enumerate(keys)] + [df[value].eqNullSafe(r["_v"])]
    return df.join(r, on, "left").select(*df.columns, name)


def individual_accuracies(df: DataFrame, individual: str, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean accuracy of individuals with a row of class 0, with a row of class 1, and the mean of the two."""
    own = df.groupBy(*keys, individual).agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("acc"), F.max((F.col(true) == 0).cast("int")).alias("f"), F.max((F.col(true) == 1).cast("int")).alias("m"))
    both = own.groupBy(*keys).agg(F.avg(F.when(F.col("f") == 1, F.col("acc"))).alias("acc_0"), F.avg(F.when(F.col("m") == 1, F.col("acc"))).alias("acc_1"))
    return both.withColumn("balanced", (F.col("acc_0") + F.col("acc_1")) / 2)


def majority_stats(df: DataFrame, individual: str, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """How many individuals have more than half of their rows right, how many don't, and the percentage."""
    own = df.groupBy(*keys, individual).agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("acc"))
    n = own.groupBy(*keys).agg(F.count_if(F.col("acc") > 0.5).alias("n_right"), F.count_if(F.coalesce(F.col("acc"), F.lit(0.0)) <= 0.5).alias("n_wrong"))
    return n.withColumn("pct_right", F.try_divide(100.0 * F.col("n_right"), F.col("n_right") + F.col("n_wrong")))


def bcr_by_size(df: DataFrame, trail_a: str, trail_b: str, true: str, pred: str) -> DataFrame:
    """(size, n, tpr, tnr, bcr) by the smaller subsample size of a pair; pairs without one come last."""
    d = df.withColumn("size", F.least(subsample_size(trail_a), subsample_size(trail_b)))
    return d.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *confusion_cells(true, pred)).withColumns(rates()).select("size", "n", "tpr", "tnr", "bcr").orderBy(F.col("size").asc_nulls_last())


def separation(same: str | Column, dist: str | Column) -> Column:
    """Mean distance of different pairs less that of same pairs."""
    return F.avg(F.when(_col(same) == 0, _col(dist))) - F.avg(F.when(_col(same) == 1, _col(dist)))


def concordance(x: str | Column, y: str | Column) -> Column:
    """Lin's concordance with sample moments; null where the denominator is zero."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    gap = F.avg(x) - F.avg(y)
    return F.try_divide(2 * F.covar_samp(x, y), F.var_samp(x) + F.var_samp(y) + gap * gap)


def relative_difference(pred: str | Column, true: str | Column) -> Column:
    """|pred - true| / true; an error where true isn't positive."""
    p, t = _col(pred), _col(true)
    return F.when(t > 0, F.abs(p - t) / t).otherwise(F.raise_error(F.lit("true count must be positive")))


def v_measure(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, homogeneity, completeness, v) from the table of counts; an entropy of zero counts as 1."""
    n = df.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("n"))
    ent = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    tot = n.groupBy(*keys).agg(F.sum("n").alias("N"), ent("n").alias("joint"))
    side = lambda c, name: n.groupBy(*keys, c).agg(F.sum("n").alias("m")).groupBy(*keys).agg(ent("m").alias(name))
    t, p = side(true, "st"), side(pred, "sp")
    both = tot.join(t, list(keys)).join(p, list(keys)) if keys else tot.crossJoin(t).crossJoin(p)  # one row each
    N = F.col("N")
    ht, hp = F.log(N) - F.col("st") / N, F.log(N) - F.col("sp") / N
    ht_p, hp_t = (F.col("sp") - F.col("joint")) / N, (F.col("st") - F.col("joint")) / N
    tiny = 1e-12
    h, c = F.when(ht < tiny, 1.0).otherwise(1 - ht_p / ht), F.when(hp < tiny, 1.0).otherwise(1 - hp_t / hp)
    out = both.select(*keys, h.alias("homogeneity"), c.alias("completeness"))
    return out.withColumn("v", F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)))


def histogram(df: DataFrame, value: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, density): equal widths between the least and greatest value over all keys; null values left out."""
    d = df.filter(F.col(value).isNotNull())
    ends = d.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    d = d.join(F.broadcast(ends)).withColumn("bin", F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int"))
    n = d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("w"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    return n.select(*keys, "bin", "n", F.try_divide(F.col("n"), F.sum("n").over(w) * F.col("w")).alias("density"))


def box_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, q1, median, q3, lo, hi): exact quartiles with linear interpolation, and the range."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return d.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "lo", "hi")


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns over the rows that hold both, in one pass.

    Each task adds up matrix products of values and of marks of what is held; the sums, one array a task, are
    then added place by place.  r is null for fewer than two such rows or a column that doesn't vary there.
    """
    features, p = list(features), len(features)
    if p < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    at = [(i, j) for i in range(p) for j in range(i + 1, p)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for b in batches:
            x = np.column_stack([b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(p)])
            held = ~np.isnan(x)
            x = np.where(held, x, 0.0)
            m = held.astype(float)
            # products of values with values, values with marks, squares with marks, marks with marks
            add = np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
            total = add if total is None else total + add
        if total is not None:
            i, j = np.array(at).T
            rows = np.stack([total[3][i, j], total[1][i, j], total[1][j, i], total[0][i, j], total[2][i, j], total[2][j, i]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)), pa.int32()), *[pa.array(rows[:, k]) for k in range(6)]], ["k", "n", "sa", "sb", "ab", "aa", "bb"])

    sums = df.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(run, "k int, n double, sa double, sb double, ab double, aa double, bb double")
    s = sums.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "ab", "aa", "bb")])
    va, vb = (F.greatest(F.col(f"{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n"), F.lit(0.0)) for x in "ab")
    r = F.when((F.col("n") >= 2) & (va > 1e-12 * F.col("aa")) & (vb > 1e-12 * F.col("bb")), (F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    name = lambda e: F.element_at(F.array(*[F.lit(features[x[e]]) for x in at]), F.col("k") + 1)
    return s.filter("n > 0").select(name(0).alias("a"), name(1).alias("b"), r.alias("r"))


def anova(long: DataFrame, group: str, keys: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """(keys, f, n, n_groups): one-way F of each feature from counts, means and variances of its groups."""
    g = long.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    ssb = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    return s.select(*keys, F.try_divide(ssb / (F.col("n_groups") - 1), F.col("ssw") / (F.col("n") - F.col("n_groups"))).alias("f"), "n", "n_groups")


def quality_class(ratio: Column, strict: bool = False) -> Column:
    """High, Moderate, Low or Misclassified of a share of right predictions: from .9, .7 and .5, or above them if strict."""
    at = (lambda x: ratio > x) if strict else (lambda x: ratio >= x)
    return F.when(at(0.9), "High").when(at(0.7), "Moderate").when(at(0.5), "Low").otherwise("Misclassified")
