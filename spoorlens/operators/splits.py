"""Splits, folds, holdouts and trails that never break an individual apart.

Random choices are orders by a seeded hash of the key, so a result depends on the data alone and not
on how it is partitioned.  ``order`` replaces the hash, where a caller wants another fixed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import known
from .cleaning import ranked_within

SEED, TEST_SIZE, FOLDS = 99, 0.2, 5


def seeded(*keys: str | Column, seed: int = SEED) -> Column:
    """A random order of keys that is the same everywhere."""
    return F.xxhash64(F.lit(seed), *keys)


def _order(key: str, order: Column | None, seed: int) -> list[Column]:
    return [order if order is not None else seeded(F.col(key), seed=seed), F.col(key)]


def individuals(df: DataFrame, individual: str = "individual_id", sex: str = "sex", position: str = "id") -> DataFrame:
    """(individual, sex): one row for each known individual with the first valid sex of its rows."""
    rows = df.filter(known(F.col(individual)).isNotNull() & F.lower(F.col(sex)).isin("f", "m"))
    return rows.groupBy(individual).agg(F.min_by(F.lower(F.col(sex)), F.col(position)).alias(sex))


def stratified_split(df: DataFrame, individual: str = "individual_id", sex: str = "sex", position: str = "id", test_size: float = TEST_SIZE, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """``df`` with ``split``: of each sex the first ``ceil(n * test_size)`` individuals in random order are test, the others train.

    Rows of individuals without a valid sex, and of unknown ones, are inference.
    """
    own = individuals(df, individual, sex, position)
    ranked = ranked_within(own, [sex], _order(individual, order, seed))
    split = ranked.select(individual, F.when(F.col("_k") <= F.ceil(F.col("_n") * test_size), "test").otherwise("train").alias("split"))
    return df.join(split, individual, "left").fillna("inference", ["split"])


def group_split(df: DataFrame, group: str, test_size: float = TEST_SIZE, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """``df`` with ``split``: the first ``floor(n * (1 - test_size))`` groups in random order are train."""
    own = df.select(group).filter(F.col(group).isNotNull()).distinct()
    ranked = ranked_within(own, [], _order(group, order, seed))
    split = ranked.select(group, F.when(F.col("_k") <= F.floor(F.col("_n") * (1 - test_size) + 1e-9), "train").otherwise("test").alias("split"))
    return df.join(split, group, "left")


def stratified_folds(df: DataFrame, group: str = "individual_id", stratum: str = "sex", n_folds: int = FOLDS, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """(group, stratum, fold): the groups of each stratum dealt to the folds in turn.

    The number of folds is at most that of the groups of the smallest stratum; fewer than two are an error.
    """
    own = df.select(group, stratum).filter(F.col(group).isNotNull() & F.col(stratum).isNotNull()).distinct()
    least = own.groupBy(stratum).count().agg(F.min("count")).first()[0] or 0
    k = min(n_folds, least)
    if k < 2:
        raise ValueError(f"folds need two groups of each stratum; the smallest has {least}")
    ranked = ranked_within(own, [stratum], _order(group, order, seed))
    return ranked.select(group, stratum, ((F.col("_k") - 1) % k).cast("int").alias("fold"))


def fold_balance(df: DataFrame, fold: str = "fold", target: str = "sex", classes: Sequence = ("f", "m")) -> DataFrame:
    """(fold, valid): whether a fold has rows of exactly the given classes."""
    has = [F.max((F.col(target) == c).cast("int")) == 1 for c in classes]
    only = F.min(F.col(target).isin(*classes).cast("int")) == 1
    return df.groupBy(fold).agg(*[h.alias(f"_h{k}") for k, h in enumerate(has)], only.alias("_o")).select(fold, F.coalesce(F.expr(" and ".join([f"_h{k}" for k in range(len(has))] + ["_o"])), F.lit(False)).alias("valid"))


def folds_valid(df: DataFrame, fold: str = "fold", target: str = "sex", classes: Sequence = ("f", "m")) -> bool:
    """Whether there are two folds or more and each has exactly the given classes."""
    r = fold_balance(df.filter(F.col(fold).isNotNull()), fold, target, classes).agg(F.count(F.lit(1)), F.min("valid")).first()
    return r[0] >= 2 and bool(r[1])


def make_folds(df: DataFrame, group: str = "individual_id", stratum: str = "sex", fold: str = "fold", n_folds: int = FOLDS, seeds: Sequence[int] = (99, 100, 101)) -> tuple[DataFrame, str]:
    """``df`` with valid folds, and how they came about: existing, stratified, group or rows."""
    if fold in df.columns and folds_valid(df, fold, stratum):
        return df, "existing"
    bare = df.drop(fold)
    for seed in seeds:
        try:
            out = bare.join(stratified_folds(bare, group, stratum, n_folds, seed).select(group, F.col("fold").alias(fold)).distinct(), group, "left")
        except ValueError:
            break
        if folds_valid(out, fold, stratum):
            return out, "stratified"
    for seed in seeds:
        out = bare.withColumn(fold, F.pmod(seeded(group, seed=seed), F.lit(n_folds)).cast("int"))
        if folds_valid(out, fold, stratum):
            return out, "group"
    return bare.withColumn(fold, F.pmod(seeded(*[F.col(c) for c in bare.columns]), F.lit(n_folds)).cast("int")), "rows"


def sample_individuals(df: DataFrame, n: int, individual: str = "individual_id", where: Column | None = None, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """Rows of ``n`` random individuals among the rows that satisfy ``where``."""
    pool = df.filter(where) if where is not None else df
    ids = pool.select(individual).filter(F.col(individual).isNotNull()).distinct().orderBy(*_order(individual, order, seed)).limit(n)
    return pool.join(ids, individual, "left_semi")


def origin_split(df: DataFrame, inference: Sequence[str], test: Sequence[str], sampled: Sequence[tuple[str, str, int]], individual: str = "individual_id", sex: str = "sex", origin: str = "dataorigin", seed: int = SEED, order: Column | None = None) -> DataFrame:
    """``df`` with ``split`` by data origin: whole origins go to inference or test, and of others some individuals of a sex to test.

    ``sampled`` has (origin, sex, how many).  An individual of test is in no train row; null origins are train.
    """
    tests = df.filter(F.col(origin).isin(*test)).select(individual)
    for o, s, n in sampled:
        tests = tests.union(sample_individuals(df, n, individual, (F.col(origin) == o) & (F.col(sex) == s), seed, order).select(individual))
    tests = tests.filter(F.col(individual).isNotNull()).distinct().withColumn("_t", F.lit(True))
    split = F.when(F.col(origin).isin(*inference), "inference").when(F.col("_t"), "test").otherwise("train")
    return df.join(tests, individual, "left").withColumn("split", split).drop("_t")


def sequential_holdouts(df: DataFrame, sizes: Sequence[int], iterations: int, individual: str = "individual_id", seed: int = SEED, order: Column | None = None) -> DataFrame:
    """(iteration, n_val, individual): independent draws without replacement; sizes are held within 2 and n - 1.

    Fewer than three individuals are an error.
    """
    ids = df.select(individual).filter(F.col(individual).isNotNull()).distinct()
    n = ids.count()
    if n < 3:
        raise ValueError(f"a holdout needs three individuals; there are {n}")
    grid = [(i, s, max(2, min(s, n - 1))) for i in range(iterations) for s in sizes]
    draws = ids.select(individual, F.explode(F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(s).alias("n_val"), F.lit(k).alias("_k")) for i, s, k in grid])).alias("g")).select(individual, "g.*")
    rnd = order if order is not None else F.xxhash64(F.lit(seed), "iteration", "n_val", individual)
    # the rank is bounded, so Spark limits each draw in each task before it shuffles
    w = Window.partitionBy("iteration", "n_val").orderBy(rnd, individual)
    return draws.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(k for _, _, k in grid)).filter("_r <= _k").select("iteration", "n_val", individual)


def chunk_trails(df: DataFrame, size: int, individual: str = "individual_id", key: str = "id", seed: int = SEED, order: Column | None = None) -> DataFrame:
    """``df`` with ``new_trail``: each individual's rows in random order cut into trails of ``size``; the short rest is null."""
    d = ranked_within(df.filter(F.col(individual).isNotNull()), [individual], _order(key, order, seed))
    lost = df.filter(F.col(individual).isNull()).withColumns({"_n": F.lit(0).cast("long"), "_k": F.lit(1).cast("long")})
    d = d.unionByName(lost)
    number = F.floor((F.col("_k") - 1) / size) + 1
    return d.withColumn("new_trail", F.when(number * size <= F.col("_n"), F.concat_ws("_", individual, F.lit(size), number))).drop("_k", "_n")


def assigned_leftovers(df: DataFrame, trail: str = "trail", individual: str = "individual_id", key: str = "id", seed: int = SEED) -> DataFrame:
    """``df`` in which rows without a trail have one of their individual's trails, by a seeded hash of their key.

    Null and ``unknown`` trails count as none; rows of unknown individuals, and of those without any trail,
    keep what they have.
    """
    named = lambda c: known(F.lower(F.trim(c))).isNotNull()
    has = named(trail)
    own = df.filter(has & named(individual)).select(individual, F.col(trail).alias("_t")).distinct()
    # an individual's trails, not its rows, are numbered
    order = Window.partitionBy(individual).orderBy("_t")
    own = own.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(individual))})
    sizes = own.groupBy(individual).agg(F.max("_n").alias("_n"))
    lost = df.filter(~has).join(sizes, individual, "left").withColumn("_k", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("_n")).cast("int")).drop("_n")
    found = lost.join(own.drop("_n"), [individual, "_k"], "left").withColumn(trail, F.coalesce("_t", trail)).select(*df.columns)
    return df.filter(has).unionByName(found)


def diverse_subsamples(df: DataFrame, sizes: Sequence[int], trail: str = "trail", key: str = "id", candidates: int = 20, keep: int = 3, seed: int = SEED) -> DataFrame:
    """(trail, size, sample, sub_trail, samples): for each trail and size up to ``keep`` different subsets that overlap least.

    ``candidates`` random subsets are drawn; they are ranked by their mean Jaccard overlap with the
    other candidates of the trail.
    """
    rows = df.filter(F.col(trail).isNotNull()).select(trail, F.col(key).cast("string").alias("_id"))
    drawn = rows.select(trail, "_id", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(c).alias("cand")) for s in sizes for c in range(candidates)])).alias("g")).select(trail, "_id", "g.*")
    w = Window.partitionBy(trail, "size", "cand").orderBy(F.xxhash64(F.lit(seed), "size", "cand", "_id"), "_id")
    drawn = drawn.withColumn("_r", F.row_number().over(w)).filter("_r <= size")
    sets = drawn.groupBy(trail, "size", "cand").agg(F.sort_array(F.collect_list("_id")).alias("samples")).filter("size(samples) = size")
    sets = sets.groupBy(trail, "size", "samples").agg(F.min("cand").alias("cand"))
    a, b = sets.alias("a"), sets.alias("b")
    jac = F.size(F.array_intersect("a.samples", "b.samples")) / F.size(F.array_union("a.samples", "b.samples"))
    met = a.join(b, (F.col(f"a.{trail}") == F.col(f"b.{trail}")) & (F.col("a.size") == F.col("b.size")))
    mean = met.groupBy(F.col(f"a.{trail}").alias(trail), F.col("a.size").alias("size"), F.col("a.cand").alias("cand"), F.col("a.samples").alias("samples")).agg(F.avg(F.when(F.col("a.cand") != F.col("b.cand"), jac)).alias("j"))
    best = Window.partitionBy(trail, "size").orderBy(F.coalesce("j", F.lit(0.0)), "cand")
    out = mean.withColumn("sample", F.row_number().over(best)).filter(F.col("sample") <= keep)
    return out.select(trail, "size", "sample", F.concat(F.col(trail), F.lit("_sub"), F.col("size"), F.lit("_sample"), F.col("sample")).alias("sub_trail"), "samples")


def triplets(df: DataFrame, individual: str, key: str, per_anchor: int = 1, seed: int = SEED) -> DataFrame:
    """(anchor, positive, negative): for each row another of its individual and one of the next individual in random order.

    Rows are placed on rings by hash: the positive is the next on the individual's ring, the negative
    the row of equal number on the next individual's ring.  Individuals with one row give no anchor.
    """
    rows = df.filter(F.col(individual).isNotNull()).select(F.col(individual).alias("g"), F.col(key).alias("k"))
    rows = ranked_within(rows, ["g"], [seeded("k", seed=seed), "k"], "r", "n").withColumn("r", F.col("r") - 1)
    groups = ranked_within(rows.groupBy("g").agg(F.any_value("n").alias("n")), [], [seeded("g", seed=seed), "g"], "o", "m").withColumn("o", F.col("o") - 1)
    nxt = groups.select(((F.col("o") - 1 + F.col("m")) % F.col("m")).alias("o"), F.col("g").alias("g2"), F.col("n").alias("n2"))
    out = rows.filter("n > 1").crossJoin(F.broadcast(rows.sparkSession.range(1, per_anchor + 1).withColumnRenamed("id", "t")))
    pos = rows.select("g", F.col("r").alias("pr"), F.col("k").alias("positive"))
    out = out.withColumn("pr", ((F.col("r") + 1 + (F.col("t") - 1) % (F.col("n") - 1)) % F.col("n")).cast("int")).join(pos, ["g", "pr"])
    out = out.join(groups.select("g", "o"), "g").join(nxt, "o").filter("g2 <> g").withColumn("nr", ((F.col("r") + F.col("t")) % F.col("n2")).cast("int"))
    neg = rows.select(F.col("g").alias("g2"), F.col("r").alias("nr"), F.col("k").alias("negative"))
    return out.join(neg, ["g2", "nr"]).select(F.col("k").alias("anchor"), "positive", "negative")


def random_pairs(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """(a, b): ``n`` pairs of rows drawn with replacement, the two of a pair being different."""
    rows = df.select(F.col(key).alias("k")).distinct()
    m = rows.count()
    if m < 2:
        return rows.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0)
    numbered = ranked_within(rows, [], [seeded("k", seed=seed), "k"], "i", "m").select("k", (F.col("i") - 1).alias("i"))
    d = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m)).alias("i"), (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(m - 1))).alias("s"))
    d = d.withColumn("j", (F.col("i") + F.col("s")) % m)
    return d.join(numbered.withColumnRenamed("k", "a"), "i").join(numbered.select(F.col("k").alias("b"), F.col("i").alias("j")), "j").select("a", "b")
