"""Problems 1, 2 and 5 against planted cases and brute force."""

import math
import random

import pandas as pd
import pytest

from spoorlens.llm.density import cluster_pairs, describe_clusters, follow, near_limits, trail_clusters
from spoorlens.llm.fingerprint import MEASURES, TOLERANCE, _near_names, _squeezed, cross_split_pairs, overlap_counts
from spoorlens.llm.topn import best_models
from spoorlens.sources.stages import Stages

PAIRS = "comparison_id long, trail_a_id string, trail_b_id string, pipeline string, dist_euclidean double, near boolean, cluster string, peak string"


def planted(rnd, sizes, bridges=True):
    trails, rows, n = [], [], 0
    for c, s in enumerate(sizes):
        trails.append([f"c{c:02d}_t{k:02d}" for k in range(s)])

    def add(a, b, near, runs=2):
        nonlocal n
        for p, unit in rnd.sample([("x", 1.0), ("y", 20.0)], runs):
            d = unit * (rnd.uniform(0.2, 0.8) if near else rnd.uniform(1.6, 6.0))
            rows.append((n, a, b, p, d, None, "k", None))
            n += 1

    for t in trails:
        pairs = [(a, b) for i, a in enumerate(t) for b in t[:i]]
        skip, far = set(), set()
        if len(t) >= 6:
            skip, far = {pairs[1]}, {pairs[4]}
        for p in pairs:
            if p not in skip:
                add(*p, p not in far)
    flat = [(a, b) for i, x in enumerate(trails) for y in trails[:i] for a in x for b in y]
    bridge = {(trails[i][0], trails[i - 1][-1]) for i in range(3, len(trails), 2) if len(trails[i]) > 2 and len(trails[i - 1]) > 2} if bridges else set()
    for p in flat:
        if p in bridge:
            add(*p, True)
        elif rnd.random() < 0.5:
            add(*p, False)
    return trails, rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_the_planted_ones(spark, seed):
    rnd = random.Random(seed)
    trails, rows = planted(rnd, [2, 3, 4, 5, 6, 8, 12, 3, 9, 1, 1])
    rows += rows[:20] + [(10**6, "c00_t00", None, "x", 0.1, None, None, None), (10**6 + 1, "c00_t00", "c01_t00", None, math.nan, None, None, None), (10**6 + 2, "unknown", "c01_t00", "x", 0.1, None, None, None), (10**6 + 3, "c05_t01", "C05-T02_sub3_sample1", "x", -1.0, None, None, None)]
    members, results = trail_clusters(spark.createDataFrame(rows, PAIRS))
    got = {(r[0], r[1]) for r in cluster_pairs(members).collect()}
    assert got == {(a, b) for t in trails for i, b in enumerate(t) for a in t[:i]}
    text = describe_clusters(members, results).toPandas()
    assert sorted(text.groupby("cluster").n_trails.first()) == sorted(len(t) for t in trails if len(t) > 1)
    assert (text.rank_no <= 3).all() and (text.near_share > 0.5).all()


def test_missing_comparisons_are_no_votes(spark):
    rnd = random.Random(4)
    near = [(f"s{a:02d}", f"s{b:02d}") for a in range(20) for b in range(a) if rnd.random() < 0.4]
    near += [("k1", "k2"), ("k2", "k3"), ("k3", "k4")]
    # two whole sets, one near pair and few far ones between them
    near += [(f"{p}{a}", f"{p}{b}") for p in "pq" for a in range(8) for b in range(a)] + [("p0", "q0")]
    far = [(f"p{k}", f"q{(k + 3) % 8}") for k in range(8)]
    rows = [(k, a, b, "x", 0.5 if k < len(near) else 4.0, None, None, None) for k, (a, b) in enumerate(near + far)]
    clusters = {}
    for r in trail_clusters(spark.createDataFrame(rows, PAIRS))[0].collect():
        clusters.setdefault(r["cluster"], set()).add(r["trail"])
    want = [{f"s{k:02d}" for k in range(20)}, {"k1", "k2", "k3", "k4"}, {f"p{k}" for k in range(8)}, {f"q{k}" for k in range(8)}]
    assert sorted(map(sorted, clusters.values())) == sorted(map(sorted, want))


@pytest.mark.parametrize("clusters", [1, 20, 60, 250])
def test_near_share_may_be_any(spark, clusters):
    """Clusters of two, every pair compared: the near share falls as one by twice their number."""
    rnd = random.Random(clusters)
    names = [f"t{k:03d}" for k in range(2 * clusters + 1)]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[:k]]
    near = {(names[2 * k + 1], names[2 * k]) for k in range(clusters)}
    rows = [(k, a, b, "x", rnd.uniform(0.3, 0.8) if (a, b) in near else rnd.uniform(1.6, 6.0), None, None, None) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")]), PAIRS)
    members = trail_clusters(df)[0].collect()
    assert {r["trail"] for r in members} == set(names[:-1])
    assert all(r["density"] == 1 and (r["delta"] < 1) == (r["trail"] != r["cluster"]) for r in members)


def test_a_pipeline_of_one_range_is_named(spark):
    rows = [(k, f"a{k}", f"b{k}", "x", 1.0 + k / 1000, None, None, None) for k in range(30)] + [(100 + k, f"a{k}", f"c{k}", "y", [0.1, 3.0][k % 2], None, None, None) for k in range(30)]
    with pytest.warns(UserWarning, match="pipeline x"):
        members = trail_clusters(spark.createDataFrame(rows, PAIRS))[0]
    assert members.count() == 30
    limits = {r["pipeline"]: r for r in near_limits(spark.createDataFrame(rows, PAIRS)).collect()}
    assert limits["x"]["near_limit"] is None and limits["x"]["n"] == 30 and limits["y"]["n_near"] == 15


def test_no_pairs_no_clusters(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert cluster_pairs(trail_clusters(empty)[0]).collect() == []
    one_range = spark.createDataFrame([(k, f"a{k}", f"b{k}", "x", 1.0 + k / 1000, None, None, None) for k in range(50)], PAIRS)
    assert cluster_pairs(trail_clusters(one_range)[0]).collect() == []


def test_follow_long_chain(spark):
    rows = [(f"n{k:03d}", f"n{max(k - 1, 0):03d}") for k in range(300)]
    got = follow(spark.createDataFrame(rows, "node string, to string"), Stages(spark, "t")).collect()
    assert len(got) == 300 and {r["peak"] for r in got} == {"n000"}


# ------------------------------------------------------------------ problem 2
FOOT = "id long, individual_id string, trail string, dataorigin string, `__split__` string, rep string, m string, " + ", ".join(f"{c} double" for c in MEASURES)


def brute(rows):
    out = set()
    ok = lambda v: v is not None and v == v and v > 0
    name = lambda s: None if s is None or s.strip().lower() in ("unknown", "") else s.strip().lower().split("_sub")[0]
    same = lambda x, y: x is None or y is None or _near_names(x, y) or _near_names(_squeezed(x), _squeezed(y))
    tr = [r for r in rows if r[4] == "train"]
    ev = [r for r in rows if r[4] in ("test", "inference")]
    for a in tr:
        for b in ev:
            both = [(x, y) for x, y in zip(a[7:], b[7:]) if ok(x) and ok(y)]
            if both and all(abs(x - y) <= TOLERANCE * max(x, y) * (1 + 1e-12) for x, y in both) and same(name(a[1]), name(b[1])) and same(name(a[2]), name(b[2])):
                out.add((a[0], b[0]))
    return out


def test_overlaps_match_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(260):
        base = [rnd.uniform(50, 60) * (1 + i) for i in range(12)]
        ind = f"kb{rnd.randrange(6):07d}"
        for _ in range(rnd.choice([1, 2, 2, 3])):
            m = [v * (1 + rnd.choice([0, 0, 0.003, -0.004, 0.0099])) for v in base]
            for i in rnd.sample(range(12), rnd.choice([0, 0, 0, 1, 1, 2, 2, 3, 4, 6, 10, 12])):
                m[i] = rnd.choice([None, math.nan, -999.0])
            who = rnd.choice([ind, ind, ind, "unknown", None, ind.replace("0", "", 1), "zz0000999"])
            rows.append((len(rows), who, rnd.choice([f"t_{ind}", f"t_{ind}_sub2_sample1", None]), "o", rnd.choice(["train", "train", "test", "inference", None]), "r", "m", *m))
    rows += [(len(rows) + k, *r[1:]) for k, r in enumerate(rows[:15])]  # exact copies
    got = cross_split_pairs(spark.createDataFrame(rows, FOOT))
    assert sorted((r["train_id"], r["eval_id"]) for r in got.collect()) == sorted(brute(rows))
    assert overlap_counts(got).count() >= 1


def test_overlaps_of_nothing(spark):
    assert cross_split_pairs(spark.createDataFrame([], FOOT)).collect() == []


@pytest.mark.parametrize("a, b, same", [("li0000027", "li0000072", True), ("pe0000009", "pe9", True), ("ab", "ba", True), ("kb00enclosure", "kb00encosure", True), ("kb0000001", "ze0000134", False), ("", "", True)])
def test_names_with_slips(a, b, same):
    assert (_near_names(a, b) or _near_names(_squeezed(a), _squeezed(b))) is same


# ------------------------------------------------------------------ problem 5
MODELS = "record_id long, species string, model_key string, pipeline_id string, mean_cv_balanced_accuracy double, rank_no int, score string, n int"


def test_top_records_and_skipped_files(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(6000):
        g = "hot" if k % 3 == 0 else f"s{rnd.randrange(40)}"
        s = rnd.choice([round(rnd.random(), 2), None, math.nan, 1.5, -0.1]) if rnd.random() < 0.2 else round(rnd.random(), 2)
        rows.append((k, rnd.choice([g, g.upper(), f" {g} "]), "m", rnd.choice([f"p{rnd.randrange(2000)}", None]), s, 1, "s", 2))
    got, info = best_models(spark.createDataFrame(rows, MODELS), 5, unit_rows=100)
    df = pd.DataFrame(rows, columns=["record_id", "g", "m", "p", "s", *"xyz"])
    df = df[df.s.between(0, 1)].assign(g=df.g.str.strip().str.lower(), p=df.p.fillna("none"))
    one = df.groupby(["g", "p", "s"]).record_id.min().reset_index().sort_values(["g", "s", "record_id"], ascending=[True, False, True])
    one["k"] = one.groupby("g").cumcount() + 1
    want = one[one.k <= 5]
    assert sorted((r["record_id"], r["rank_no"]) for r in got.collect()) == sorted(zip(want.record_id, want.k))
    assert 0 < info["read"] < info["files"]


def test_top_records_all_tied_and_none(spark):
    rows = [(k, "a", "m", f"p{k}", 0.5, 1, "s", 2) for k in range(900)]
    got, info = best_models(spark.createDataFrame(rows, MODELS), 5, unit_rows=50)
    assert sorted(r["record_id"] for r in got.collect()) == [0, 1, 2, 3, 4] and info["read"] == info["files"]
    assert best_models(spark.createDataFrame([], MODELS))[0].collect() == []
