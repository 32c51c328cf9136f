"""Projections to few coordinates: PCA, LDA, classical MDS and Isomap, as NumPy kernels and DataFrame fits.

Second moments are sums, so a fit over any number of rows is one aggregate; only a matrix of
features x features reaches the driver.  Signs are fixed: the largest entry of an axis is positive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fixed_signs(axes: np.ndarray) -> np.ndarray:
    s = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return axes * np.where(s == 0, 1, s)


def moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, s, q): count, sums and upper triangle of products of the features over complete rows.

    Each task adds up its own rows by matrix products; the partial sums, one array a task and key, are
    then added place by place.
    """
    keys, p = list(keys), len(features)
    # incomplete rows are left out in the tasks: as a filter, the features' expressions would be written out again
    d = df.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    types = dict(d.dtypes)
    upper = np.triu_indices(p)

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        kinds = []
        for b in batches:
            x = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            good = np.flatnonzero(~np.isnan(x).any(axis=1))
            x, kinds = x[good], [b.schema.field(k).type for k in range(len(keys))]
            if not len(good):
                continue
            of = list(zip(*[b.column(k).take(pa.array(good)).to_pylist() for k in range(len(keys))])) if keys else None
            groups = [((), slice(None))]
            if of is not None:
                number: dict[tuple, int] = {}
                code = np.array([number.setdefault(o, len(number)) for o in of])
                order = np.argsort(code, kind="stable")
                groups = list(zip(number, np.split(order, np.flatnonzero(np.diff(code[order])) + 1)))
            for k, at in groups:
                y = x[at]
                add = np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y)[upper]])
                sums[k] = sums[k] + add if k in sums else add
        if sums:
            flat = pa.array(np.concatenate(list(sums.values())))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * (1 + p + len(upper[0])), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in sums], kinds[j]) for j in range(len(keys))], lists], [*keys, "_m"])

    parts = d.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keys] + ["_m array<double>"]))
    whole = parts.select(*keys, F.posexplode("_m").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    rows = whole.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_m"))
    return rows.select(*keys, F.col("_m")[0].cast("long").alias("n"), F.slice("_m", 2, p).alias("s"), F.slice("_m", p + 2, len(upper[0])).alias("q")).filter("n > 0")


def square(q: Sequence[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = q
    return m + np.triu(m, 1).T


def pca_axes(cov: np.ndarray, k: int | None = None, variance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) and variances of a covariance; as many as asked for, or as hold the share of variance."""
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1], v[:, ::-1]
    if variance is not None:
        k = int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), variance - 1e-12) + 1)
    k = max(1, min(k or len(w), len(w)))
    return _fixed_signs(v[:, :k]), w[:k]


def fit_pca(df: DataFrame, features: Sequence[str], k: int | None = 2, variance: float | None = None) -> dict:
    """Mean, axes and variances; the number of axes is held within rows and features."""
    r = moments(df, features).first()
    p = len(features)
    if r is None or r["n"] < 1:
        raise ValueError("PCA needs a complete row")
    mean = np.array(r["s"]) / r["n"]
    cov = (square(r["q"], p) - r["n"] * np.outer(mean, mean)) / max(r["n"] - 1, 1)
    axes, var = pca_axes(cov, min(k, r["n"], p) if k else None, variance)
    return {"features": list(features), "mean": mean, "axes": axes, "variance": var, "prefix": "PCA"}


def lda_axes(within: np.ndarray, between: np.ndarray, k: int, tol: float = 1e-4) -> np.ndarray:
    """Axes that part the classes: whiten the within-class scatter, then the main axes of the class means."""
    sd = np.sqrt(np.maximum(np.diag(within), 0))
    sd[sd == 0] = 1
    w, v = np.linalg.eigh(within / np.outer(sd, sd))
    keep = np.sqrt(np.maximum(w, 0)) > tol
    if not keep.any():
        return np.zeros((len(sd), k))
    white = (v[:, keep] / np.sqrt(w[keep])) / sd[:, None]
    _, u = np.linalg.eigh(white.T @ between @ white)
    return _fixed_signs(white @ u[:, ::-1][:, :k])


def fit_lda(df: DataFrame, features: Sequence[str], group: str, k: int = 2) -> dict:
    """Mean, axes, class means, priors and the pooled covariance; at most classes - 1 axes."""
    rows = moments(df.filter(F.col(group).isNotNull()), features, [group]).orderBy(group).collect()  # a row a class
    if len(rows) < 2:
        raise ValueError("LDA needs two classes")
    p, n = len(features), np.array([r["n"] for r in rows], float)
    means = np.array([np.array(r["s"]) / r["n"] for r in rows])
    within = sum(square(r["q"], p) - r["n"] * np.outer(m, m) for r, m in zip(rows, means)) / max(n.sum() - len(rows), 1)
    mean = (n[:, None] * means).sum(axis=0) / n.sum()
    d = means - mean
    between = (d * n[:, None]).T @ d / max(len(rows) - 1, 1)
    axes = lda_axes(within, between, max(1, min(k, len(rows) - 1)))
    return {"features": list(features), "mean": mean, "axes": axes, "classes": [r[group] for r in rows], "class_means": means, "priors": n / n.sum(), "within": within, "prefix": "LDA"}


def project(df: DataFrame, model: dict) -> DataFrame:
    """``df`` with PCA1.. or LDA1..: a sum of products of columns and literals; null where a feature is null."""
    f = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(model["features"], model["mean"])]
    axes = model["axes"]
    return df.withColumns({f"{model['prefix']}{k + 1}": sum((x * F.lit(float(a)) for x, a in zip(f, axes[:, k])), F.lit(0.0)) for k in range(axes.shape[1])})


def lda_predict(df: DataFrame, model: dict, name: str = "pred") -> DataFrame:
    """``df`` with the likeliest class, and for two classes the probability of the second."""
    inv = np.linalg.pinv(model["within"])
    coef, const = model["class_means"] @ inv, np.log(model["priors"]) - 0.5 * np.einsum("ij,jk,ik->i", model["class_means"], inv, model["class_means"])
    f = [F.col(c).cast("double") for c in model["features"]]
    scores = [sum((x * F.lit(float(a)) for x, a in zip(f, coef[k])), F.lit(float(const[k]))) for k in range(len(const))]
    best = F.greatest(*scores)
    label = F.when(best.isNull(), None)
    for s, c in zip(scores, model["classes"]):
        label = label.when(s == best, F.lit(c))
    out = df.withColumn(name, label)
    if len(scores) == 2:
        out = out.withColumn(f"{name}_proba", 1 / (1 + F.exp(scores[0] - scores[1])))
    return out


def fit_reducer(df: DataFrame, features: Sequence[str], method: str | None, group: str | None = None, k: int = 2) -> dict | None:
    """A fitted reducer by name: pca, lda or none.  Others have no counterpart here and are an error."""
    if method in (None, "none"):
        return None
    if method == "pca":
        return fit_pca(df, features, k)
    if method == "lda":
        return fit_lda(df, features, group, k)
    raise ValueError(f"reducer {method!r} isn't available; use lda, pca or none")


def classical_mds(d: np.ndarray, k: int = 2) -> np.ndarray:
    """Coordinates whose distances approach a symmetric matrix."""
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    w, v = w[::-1][:k], _fixed_signs(v[:, ::-1][:, :k])
    return v * np.sqrt(np.maximum(w, 0))


def path_lengths(d: np.ndarray, neighbours: int = 5) -> np.ndarray:
    """Lengths of the shortest paths over nearest neighbours; parts that aren't joined lie at the longest path."""
    g = np.full_like(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : neighbours + 1]
    rows = np.arange(len(d))[:, None]
    g[rows, near] = d[rows, near]
    g = np.minimum(g, g.T)
    for m in range(len(d)):
        g = np.minimum(g, g[:, m, None] + g[None, m])
    g[~np.isfinite(g)] = g[np.isfinite(g)].max(initial=0)
    return g


def isomap(x: np.ndarray, k: int = 2, neighbours: int = 5) -> np.ndarray:
    """MDS of the path lengths over nearest neighbours."""
    return classical_mds(path_lengths(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1)), neighbours), k)
