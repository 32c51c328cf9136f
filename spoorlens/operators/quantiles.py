"""Exact quantiles of whole columns, without any task that holds a column's values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which Spark's own exact percentile is taken, whose last task holds a column's distinct values.
FEW = 1_000_000
BINS = 1024


def _histogram(df: DataFrame, features: list[str], ends: list[tuple[int, float, float]], bins: int) -> dict[tuple[int, int], tuple[int, float, float]]:
    """(interval, bin) to count, least and greatest value, of values within each of ``ends`` (feature number, least, greatest)."""
    import pyarrow as pa

    def run(batches):
        count = np.zeros((len(ends), bins), np.int64)
        least, most = np.full((len(ends), bins), np.inf), np.full((len(ends), bins), -np.inf)
        for b in batches:
            for t, (k, lo, hi) in enumerate(ends):
                x = b.column(k).to_numpy(zero_copy_only=False)
                x = x[(x >= lo) & (x <= hi)]
                at = np.minimum((x - lo) / (hi - lo) * bins, bins - 1).astype(int) if hi > lo else np.zeros(len(x), int)
                np.add.at(count[t], at, 1)
                np.minimum.at(least[t], at, x)
                np.maximum.at(most[t], at, x)
        t, i = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(i, pa.int32()), pa.array(count[t, i]), pa.array(least[t, i]), pa.array(most[t, i])], ["t", "i", "n", "lo", "hi"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(run, "t int, i int, n long, lo double, hi double")
    rows = parts.groupBy("t", "i").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # at most intervals x bins
    return {(r["t"], r["i"]): (r["n"], r["lo"], r["hi"]) for r in rows}


def column_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], few: int = FEW, bins: int = BINS) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of each feature, null and NaN left out; None for a feature without values.

    Each pass counts the values of an interval in bins and goes on with the bin that holds the wanted rank,
    until one value is left: passes grow with the logarithm of the range, and a task keeps its bins only.
    Tables of up to ``few`` rows go by Spark's exact percentile, which gives the same.
    """
    features, probs = list(features), list(probs)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    if few and df.select(*features).limit(few + 1).count() <= few:
        row = df.agg(*[F.percentile(value[c], F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{k}") for k, c in enumerate(features)]).first()
        return {c: list(row[k]) if row[k] is not None else [None] * len(probs) for k, c in enumerate(features)}
    ends = df.agg(*[f(value[c]).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # wanted ranks, and the interval that each is in: feature, values before it, least, greatest
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, float, float]] = {}
    for k in range(len(features)):
        n = ends[f"n{k}"]
        for p in probs if n else ():
            at = int(np.floor(p * (n - 1)))
            for rank in {at, min(at + 1, n - 1)}:
                open_[k, rank] = (0, ends[f"lo{k}"], ends[f"hi{k}"])
    while open_:
        done = [x for x, (_, lo, hi) in open_.items() if lo == hi]
        for x in done:
            found[x] = open_.pop(x)[1]
        if not open_:
            break
        intervals = sorted({(k, lo, hi) for (k, _), (_, lo, hi) in open_.items()})
        seen = _histogram(df, features, intervals, bins)
        number = {x: t for t, x in enumerate(intervals)}
        for (k, rank), (before, lo, hi) in list(open_.items()):
            t = number[k, lo, hi]
            for i in range(bins):
                if (t, i) in seen:
                    n, a, b = seen[t, i]
                    if before + n > rank:
                        open_[k, rank] = (before, a, b)
                        break
                    before += n
    out = {}
    for k, c in enumerate(features):
        n = ends[f"n{k}"]
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            at = int(np.floor(p * (n - 1)))
            a, b = found[k, at], found[k, min(at + 1, n - 1)]
            out[c].append(a + (b - a) * (p * (n - 1) - at))
    return out
