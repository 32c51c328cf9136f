"""How many individuals are there?  Ward linkage of distance tables, cutoffs, and sweeps.

A linkage runs once a group (one group a task: a group is the trails of one species, tag and fold); it
returns the sorted merge heights, and every cutoff after that is SQL: n trails less the merges up to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trails of one group, at most: its matrix has half a gigabyte then.
MOST_TRAILS = 8000
#: The cutoffs of a full sweep.
CUTOFFS = tuple(round(0.4 + 0.1 * k, 6) for k in range(38))


def square_distances(pairs: DataFrame, keys: Sequence[str], a: str, b: str, dist: str) -> DataFrame:
    """(keys, i, j, d): the symmetric long form of a distance matrix, zeros on the diagonal.

    Repeated pairs count with their mean; distances that are null or NaN are missing.
    """
    keys = list(keys)
    p = pairs.filter(F.col(dist).isNotNull() & ~F.isnan(dist)).groupBy(*keys, F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.avg(dist).alias("d")).filter("i <> j")
    both = p.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "d").select(*keys, "e.i", "e.j", "d")
    own = pairs.select(*keys, F.explode(F.array(a, b)).alias("i")).distinct().select(*keys, "i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    return both.unionByName(own)


def complete_trails(square: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only trails that have a distance to all others of their group; one pass, as the counts are of all trails."""
    keys = list(keys)
    n = square.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("c"))
    most = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    good = (n.join(most, keys) if keys else n.crossJoin(most)).filter("c = n").select(*keys, "i")
    return square.join(good, [*keys, "i"], "left_semi").join(good.withColumnRenamed("i", "j"), [*keys, "j"], "left_semi")


def dense(pdf: pd.DataFrame, fill: bool = True) -> tuple[list[str], np.ndarray]:
    """Sorted labels and the matrix of a long table; what is missing is the largest distance."""
    labels = sorted(set(pdf["i"]) | set(pdf["j"]))
    if len(labels) > MOST_TRAILS:
        raise ValueError(f"{len(labels)} trails in one group; its matrix may have {MOST_TRAILS}")
    at = {x: k for k, x in enumerate(labels)}
    m = np.full((len(labels), len(labels)), np.nan)
    m[pdf["i"].map(at), pdf["j"].map(at)] = pdf["d"]
    np.fill_diagonal(m, 0.0)
    if fill and len(labels):
        m[np.isnan(m)] = np.nanmax(m)
    return labels, m


def ward(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of Ward linkage of a distance matrix; cluster n + k is made by merge k.

    Chains of nearest neighbours are followed until two clusters are nearest to each other, so all merges
    take n squared steps; they are then put in order of height.
    """
    n = len(d)
    if n > MOST_TRAILS:
        raise ValueError(f"{n} trails in one group; a linkage holds a matrix of at most {MOST_TRAILS}")
    if n < 2:
        return []
    q = d.astype(float) ** 2
    np.fill_diagonal(q, np.inf)
    size, live, found, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(live))]
        while True:
            x = chain[-1]
            y = int(np.argmin(q[x]))
            # of equally near ones the one before in the chain, so that it ends
            if len(chain) > 1 and q[x, chain[-2]] <= q[x, y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        i, j = min(x, y), max(x, y)
        h = q[i, j]
        found.append((float(np.sqrt(max(h, 0))), i, j))
        others = live.copy()
        others[[i, j]] = False
        s = size[others]
        new = ((size[i] + s) * q[i, others] + (size[j] + s) * q[j, others] - s * h) / (size[i] + size[j] + s)
        q[i, others] = q[others, i] = new
        q[j, :] = q[:, j] = np.inf
        size[i] += size[j]
        live[j] = False
    name, out = list(range(n)), []
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (h, i, j) in enumerate(sorted(found, key=lambda m: m[0])):
        i, j = root(i), root(j)
        out.append((min(name[i], name[j]), max(name[i], name[j]), h))
        up[j], name[i] = i, n + k
    return out


def heights(d: np.ndarray) -> list[float]:
    return sorted(h for _, _, h in ward(d))


def cut_labels(d: np.ndarray, cutoff: float, merges: list | None = None) -> np.ndarray:
    """Cluster number of each row when merges up to ``cutoff`` are made; numbered in order of first row."""
    n, merges = len(d), ward(d) if merges is None else merges
    root = list(range(2 * n - 1)) if n else []
    # a merge is made if it and all merges below it are at most the cutoff
    reach = {}
    for k, (a, b, h) in enumerate(merges):
        reach[n + k] = max(h, reach.get(a, 0.0), reach.get(b, 0.0))
        if reach[n + k] <= cutoff:
            root[a] = root[b] = n + k

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = [find(i) for i in range(n)]
    first = {}
    return np.array([first.setdefault(x, len(first)) for x in ids])


def cluster_count(d: np.ndarray, cutoff: float) -> int:
    return len(set(cut_labels(d, cutoff).tolist()))


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of a labelling with a distance matrix; a cluster of one scores 0."""
    out = []
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def silhouette_count(d: np.ndarray) -> int:
    """The number of clusters, 2 to n - 1, with the best silhouette; the first of equals; fewer than three rows are an error."""
    n = len(d)
    if n < 3:
        raise ValueError("a silhouette needs three rows")
    h = heights(d)
    best, at = -2.0, 2
    for k in range(2, n):
        s = silhouette(d, cut_labels(d, h[n - k - 1] if n - k - 1 >= 0 else -1.0))
        if s > best + 1e-12:
            best, at = s, k
    return at


def _grouped(square: DataFrame, keys: Sequence[str], schema: str, make) -> DataFrame:
    """``make`` of the labels and matrix of each group, a group a task; the matrix bounds its trails (``MOST_TRAILS``)."""
    keys = list(keys)
    types = dict(square.dtypes)
    d = square if keys else square.withColumn("_all", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = make(*dense(pdf))
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return d.groupBy(*(keys or ["_all"])).applyInPandas(one, ", ".join([f"`{c}` {types[c]}" for c in keys] + [schema]))


def merge_heights(square: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, heights): number of trails and sorted merge heights of each group."""
    return _grouped(square, keys, "n int, heights array<double>", lambda labels, m: pd.DataFrame({"n": [len(labels)], "heights": [heights(m)]}))


def counts_at(linkage: DataFrame, cutoff: Column) -> DataFrame:
    """Linkage rows with ``pred_count``: clusters that are left when merges up to the cutoff are made."""
    return linkage.withColumns({"cutoff": cutoff, "pred_count": F.col("n") - F.size(F.filter("heights", lambda h: h <= cutoff))})


def cutoff_range(heights_: Column, n: Column, k: Column) -> Column:
    """Struct (cutoff, low, high): the middle and the quarters of the range of sorted heights at which there are ``k`` clusters.

    ``k`` must lie within 1 and the number of rows.  Where no merge lies below, the range begins at 0;
    where none lies above, it has no width.
    """
    lo = F.when(n - k >= 1, F.get(heights_, (n - k - 1).cast("int"))).otherwise(0.0)
    hi = F.coalesce(F.get(heights_, (n - k).cast("int")), lo)
    ok = (k > 0) & (k <= n)
    s = F.struct((lo + (hi - lo) / 2).alias("cutoff"), (lo + (hi - lo) / 4).alias("low"), (lo + 3 * (hi - lo) / 4).alias("high"))
    return F.when(ok, s).otherwise(F.raise_error(F.lit("cluster count out of range")))


def cluster_labels(square: DataFrame, keys: Sequence[str], cutoffs: Sequence[float]) -> DataFrame:
    """(keys, cutoff, trail, cluster) for each cutoff."""

    def make(labels: list[str], m: np.ndarray) -> pd.DataFrame:
        rows = [(float(c), t, int(k)) for c in cutoffs for t, k in zip(labels, cut_labels(m, c))]
        return pd.DataFrame(rows, columns=["cutoff", "trail", "cluster"])

    return _grouped(square, keys, "cutoff double, trail string, cluster int", make)


def silhouette_counts(square: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, pred_count): the count with the best silhouette; null for groups of fewer than three trails."""
    return _grouped(square, keys, "n int, pred_count int", lambda labels, m: pd.DataFrame({"n": [len(labels)], "pred_count": pd.array([silhouette_count(m) if len(labels) >= 3 else None], dtype="Int32")}))


def mds_points(square: DataFrame, keys: Sequence[str], k: int = 2) -> DataFrame:
    """(keys, trail, x1, x2, ...): coordinates of each group's trails whose distances approach the given ones."""
    from .reduction import classical_mds

    def make(labels: list[str], m: np.ndarray) -> pd.DataFrame:
        x = classical_mds(m, min(k, len(labels)))
        x = np.hstack([x, np.zeros((len(labels), k - x.shape[1]))])
        return pd.DataFrame({"trail": labels} | {f"x{j + 1}": x[:, j] for j in range(k)})

    return _grouped(square, keys, "trail string, " + ", ".join(f"x{j + 1} double" for j in range(k)), make)


def isomap_points(square: DataFrame, keys: Sequence[str], k: int = 2, neighbours: int = 5) -> DataFrame:
    """``mds_points`` of path lengths over each trail's nearest neighbours."""
    from .reduction import classical_mds, path_lengths

    def make(labels: list[str], m: np.ndarray) -> pd.DataFrame:
        x = classical_mds(path_lengths(m, neighbours), min(k, len(labels)))
        x = np.hstack([x, np.zeros((len(labels), k - x.shape[1]))])
        return pd.DataFrame({"trail": labels} | {f"x{j + 1}": x[:, j] for j in range(k)})

    return _grouped(square, keys, "trail string, " + ", ".join(f"x{j + 1} double" for j in range(k)), make)


def cutoff_sweep(labels: DataFrame, truth: DataFrame, keys: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """(keys, cutoff, pred_count, true_count, erd, v, score): each cutoff against the true individuals of the trails.

    ``truth`` has (trail, individual); the score is alpha (1 - ERD) + (1 - alpha) V.
    """
    from .evaluation import relative_difference, v_measure

    by = [*keys, "cutoff"]
    known = labels.join(truth, "trail")
    n = known.groupBy(*by).agg(F.countDistinct("cluster").alias("pred_count"), F.countDistinct("individual").alias("true_count"))
    s = n.join(v_measure(known, "individual", "cluster", by).select(*by, "v"), by).withColumn("erd", relative_difference("pred_count", "true_count"))
    return s.withColumn("score", alpha * (1 - F.col("erd")) + (1 - alpha) * F.col("v"))


def reevaluated(linkage: DataFrame, keys: Sequence[str], cutoff: float, true_count: str = "true_count") -> DataFrame:
    """(keys, true_count, pred_count, erd): counts of each group at one given cutoff."""
    from .evaluation import relative_difference

    at = counts_at(linkage, F.lit(float(cutoff)))
    return at.select(*keys, true_count, "pred_count", relative_difference("pred_count", true_count).alias("erd"))


# ------------------------------------------------------------------ full sweep
def v_scores(true: np.ndarray, pred: np.ndarray) -> tuple[float, float, float]:
    """Homogeneity, completeness and V of two labellings; an entropy of zero counts as 1."""
    n = len(true)
    _, t = np.unique(true, return_inverse=True)
    _, p = np.unique(pred, return_inverse=True)
    both = np.zeros((t.max() + 1, p.max() + 1))
    np.add.at(both, (t, p), 1)
    ent = lambda c: float(-(c[c > 0] / n * np.log(c[c > 0] / n)).sum())
    ht, hp, hb = ent(both.sum(axis=1)), ent(both.sum(axis=0)), ent(both.ravel())
    h = 1.0 if ht < 1e-12 else 1 - (hb - hp) / ht
    c = 1.0 if hp < 1e-12 else 1 - (hb - ht) / hp
    return h, c, 2 * h * c / (h + c) if h + c > 0 else 0.0


def scaled_columns(m: np.ndarray) -> np.ndarray:
    """Each column to 0..1 by its own range, one of no range becoming 0; the upper triangle then counts for both."""
    lo, span = m.min(axis=0), np.ptp(m, axis=0)
    up = np.triu((m - lo) / np.where(span > 0, span, 1), 1)
    return up + up.T


def sweep_curves(pairs: DataFrame, keys: Sequence[str], distances: Sequence[str], cutoffs: Sequence[float] = CUTOFFS, alpha: float = 0.5) -> DataFrame:
    """(keys, dist, prep, cutoff, pred_count, true_count, erd, homogeneity, completeness, v, score) of each group of trails.

    ``pairs`` has trail_a_id, trail_b_id, ind_a, ind_b and the distance columns; each distance, raw and
    scaled by column, is a linkage of the trails that have it to all others.  Each group (keys and
    distance) is one task; it makes one linkage for all cutoffs.  The score is alpha (1 - ERD) +
    (1 - alpha) V.  Groups of fewer than two such trails give no rows.
    """
    from .evaluation import relative_difference

    # keys may be null, so a group goes by their text
    groups, keys = list(keys), ["_g"]
    pairs = pairs.withColumn("_g", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit(""))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dist"), F.col(c).cast("double").alias("_d")) for c in distances])).alias("_e")
    long = pairs.select("_g", "trail_a_id", "trail_b_id", "ind_a", "ind_b", each).select("_g", "_e.dist", "trail_a_id", "trail_b_id", "ind_a", "ind_b", "_e._d")
    by = ["_g", "dist"]
    square = complete_trails(square_distances(long, by, "trail_a_id", "trail_b_id", "_d"), by)
    own = F.explode(F.array(F.struct(F.col("trail_a_id").alias("i"), F.col("ind_a").alias("ind")), F.struct(F.col("trail_b_id").alias("i"), F.col("ind_b").alias("ind"))))
    truth = pairs.select(*keys, own.alias("_t")).select(*keys, "_t.*").groupBy(*keys, "i").agg(F.min("ind").alias("ind"))
    rows = square.join(truth, [*keys, "i"])
    types = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, m = dense(pdf)
        at = dict(zip(pdf["i"], pdf["ind"].astype(str)))
        true, out = np.array([at[x] for x in labels]), []
        for prep, d in (("raw", m), ("minmax", scaled_columns(m))) if len(labels) > 1 else ():
            merges = ward(d)
            for c in cutoffs:
                got = cut_labels(d, c, merges)
                out.append((prep, float(c), len(set(got.tolist())), len(set(true.tolist())), *v_scores(true, got)))
        out = pd.DataFrame(out, columns=["prep", "cutoff", "pred_count", "true_count", "homogeneity", "completeness", "v"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    schema = [f"`{c}` {types[c]}" for c in by] + ["prep string, cutoff double, pred_count int, true_count int, homogeneity double, completeness double, v double"]
    spread = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    s = spread.groupBy(*by).applyInPandas(one, ", ".join(schema)).withColumn("erd", relative_difference("pred_count", "true_count"))
    s = s.withColumn("score", alpha * (1 - F.col("erd")) + (1 - alpha) * F.col("v"))
    return s.join(pairs.select("_g", *groups).distinct(), "_g").select(*groups, *[c for c in s.columns if c != "_g"])


def sweep_benchmark(curves: DataFrame, keys: Sequence[str], fold: str = "fold", origin: str = "origin") -> DataFrame:
    """The best cutoff of each (keys, dist, prep) by its mean score over the folds of origin cv, and what it gives on origin test.

    Of equal scores the smallest cutoff is taken; columns of the test are null where it has no rows.
    """
    by = [*keys, "dist", "prep"]
    cv = curves.filter(F.col(origin) == "cv").groupBy(*by, "cutoff").agg(*[F.avg(c).alias(c) for c in ("erd", "homogeneity", "completeness", "v", "score")])
    names = ("erd", "homogeneity", "completeness", "v", "score")
    best = cv.groupBy(*by).agg(F.max_by(F.struct("cutoff", *names), F.struct("score", -F.col("cutoff"))).alias("b"))
    best = best.select(*by, F.col("b.cutoff").alias("cutoff"), *[F.col(f"b.{c}").alias(f"cv_{c}") for c in names])
    test = curves.filter(F.col(origin) == "test").select(*by, "cutoff", *[F.col(c).alias(f"test_{c}") for c in ("pred_count", "true_count", "erd", "homogeneity", "completeness", "v")])
    return best.join(test, [*by, "cutoff"], "left")
