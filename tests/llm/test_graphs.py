"""Problems 4 and 6: groups and families against union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorlens.llm.components import contracted_groups, star_components, undirected
from spoorlens.llm import family_split
from spoorlens.llm.family_split import animal, animal_kinds, assign_splits, broken_animals, entity, entity_families, split_ranges, split_report
from spoorlens.llm.groups import trail_groups
from spoorlens.sources.stages import Stages


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    low = {}
    for x in up:
        low[find(x)] = min(low.get(find(x), x), x)
    return {x: low[find(x)] for x in up}


def random_edges(kind, rnd):
    n = lambda k: f"n{k:03d}"
    if kind == "chain":
        order = [n(k) for k in rnd.sample(range(60), 60)]
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(n(0), n(k)) for k in range(1, 50)]
    if kind == "clique":
        return [(n(i), n(j)) for i in range(9) for j in range(i)]
    if kind == "cycle":
        return [(n(k), n((k + 1) % 20)) for k in range(20)]
    return [(n(rnd.randrange(120)), n(rnd.randrange(120))) for _ in range(80)]


@pytest.mark.parametrize("kind", ["chain", "star", "clique", "cycle", "random"])
def test_groups_match_union_find(spark, kind):
    rnd = random.Random(kind)
    edges = random_edges(kind, rnd)
    true = union_find([(a, b) for a, b in edges if a != b])
    rows = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges + edges[:5]] + [(None, "n001"), ("n002", "n002")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = contracted_groups(df, "a", "b", Stages(spark, "t"), least_share=0.2 if kind == "random" else 0.02)
    assert {r[0]: r[1] for r in got.collect()} == true
    star = star_components(Stages(spark, "t").write(undirected(df, "a", "b"), "e"), Stages(spark, "t"))
    assert {r[0]: r[1] for r in star.collect()} == true


SCHEMA = "trail_a_id string, trail_b_id string, same_individual string, extra int, node string, root string"


def test_trail_groups_spelling_and_flags(spark):
    rows = [
        ("Eo - A_t01\t", "eo_a_t02_sub3_sample1", " TRUE", 1, "x", "y"), ("eo_a_t02", "eo_a_t03", "true", 1, None, None), ("eo_a_t02", "eo_a_t03", "false", 1, None, None),
        ("eo_a_t03", "eo_b_t01", "unknown", 1, None, None), ("eo_b_t01", None, "true", 1, None, None), ("unknown", "eo_b_t01", "true", 1, None, None),
        ("eo_b_t01", "eo_b_t01_sub2_sample9", "true", 1, None, None), ("", "eo_b_t02", "true", 1, None, None), ("eo_c_t01", "eo_c_t02", None, 1, None, None),
    ]
    got = trail_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("eo_a_t01", "eo_a_t01"), ("eo_a_t02", "eo_a_t01"), ("eo_a_t03", "eo_a_t01")]


def test_trail_groups_of_nothing(spark):
    assert trail_groups(spark.createDataFrame([], SCHEMA)).collect() == []


FOOT = "id long, species string, individual_id string, fold int, `__split__` string, family string, entity string"


def test_broken_animals(spark):
    rows = [
        (1, "Amur Tiger", "a1", 0, "train", "x", None), (2, "amur_tiger", "A1", 1, "Train ", None, None), (3, "amur_tiger", "a2", 0, "train", None, None), (4, "amur_tiger", "a2", 1, "test", None, None),
        (5, "cheetah", "a2", 1, "train", None, None), (6, None, "a1", 3, "train", None, None), (7, "cheetah", "unknown", 1, "train", None, None), (8, "cheetah", "unknown", 2, "train", None, None),
        (9, "cheetah", "a2", None, "train", None, None), (9, "cheetah", "a2", None, "train", None, None), (None, None, None, None, None, None, None),
    ]
    got = broken_animals(spark.createDataFrame(rows, FOOT)).collect()
    assert [tuple(r) for r in got] == [("amur_tiger", "a1")]
    assert broken_animals(spark.createDataFrame([], FOOT)).collect() == []


def test_assignment_keeps_families_whole(spark):
    rnd = random.Random(3)
    rows = [(k, "s", "hot" if k % 3 == 0 else f"i{rnd.randrange(300)}", 0, "train", "f", "e") for k in range(3000)] + [(9000 + k, None, None, None, None, None, None) for k in range(50)]
    df = spark.createDataFrame(rows, FOOT)
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.25), ("validation", 0.15), (None, 0.3), ("off", -1.0)], "split_name string, target_share double")
    out = assign_splits(df, targets, {"animal": animal()})
    assert out.count() == len(rows)
    assert out.groupBy("family").agg(F.countDistinct("split_name").alias("n")).filter("n > 1").count() == 0
    n = {r[0]: r[1] for r in out.groupBy("split_name").count().collect()}
    # one animal holds a third of the rows, and the shares are met all the same
    for name, share in (("train", 0.6), ("test", 0.25), ("validation", 0.15)):
        assert abs(n[name] / len(rows) - share) < 0.02
    even = spark.createDataFrame([r for r in rows if r[2] != "hot"], FOOT)
    n = {r[0]: r[1] for r in assign_splits(even, targets, {"animal": animal()}).groupBy("split_name").count().collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.6) < 0.02 and abs(n["test"] / total - 0.25) < 0.02
    none = targets.limit(0)
    assert assign_splits(df, none, {"animal": animal()}).filter("split_name is not null").count() == 0
    assert assign_splits(df.limit(0), targets, {"animal": animal()}).count() == 0


def test_both_queries_go_through_the_stars(spark, monkeypatch):
    """Spellings of an animal are joined by the components; rows and targets of no animal stay apart."""
    seen = []
    real = family_split.star_components
    monkeypatch.setattr(family_split, "star_components", lambda edges, stages: (seen.append(edges.count()), real(edges, stages))[1])
    rows = [(1, "Amur Tiger", "a1", 0, "train", "x", None), (2, "amur_tiger", "A1", 1, "Train ", None, None), (3, "AMUR  tiger", "a1 ", 2, "train", None, None), (4, "cheetah", "a1", 1, "train", None, None), (5, None, "a1", 3, "train", None, None)]
    df = spark.createDataFrame(rows, FOOT)
    assert [tuple(r) for r in broken_animals(df).collect()] == [("amur_tiger", "a1")]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    out = assign_splits(df, targets, animal_kinds())
    assert len(seen) == 2 and min(seen) == 4
    assert out.groupBy("family").count().orderBy("count").toPandas()["count"].tolist() == [1, 1, 3]
    report = {r["split_name"]: r for r in split_report(out, targets).collect()}
    assert sum(r["n_rows"] for r in report.values()) == 5 and all(r["n_broken"] == 0 for r in report.values())


@pytest.mark.parametrize("hot", [0.0, 0.1, 1 / 3])
def test_split_ranges_spare_large_families(hot):
    rnd = random.Random(7)
    shares = {"train": 0.7, "validation": 0.12, "test": 0.18}
    for _ in range(20):
        # a large family holds a stretch of the circle and counts at its middle
        weights, first, long = np.ones(4096), rnd.randrange(4096), int(hot * 4096)
        if long:
            weights = np.roll(np.concatenate([np.zeros(long), np.ones(4096 - long)]), first)
            weights[(first + long // 2) % 4096] = long
        ranges = split_ranges(weights, shares)
        got = {s: sum(weights[a:b].sum() for x, a, b in ranges if x == s) / 4096 for s in shares}
        assert all(abs(got[s] - shares[s]) < 0.002 for s in shares)
        assert sorted(k for _, a, b in ranges for k in range(a, b)) == list(range(4096))


def test_families_over_two_kinds_of_entity(spark):
    rnd = random.Random(5)
    rows = [(f"a{rnd.randrange(40)}" if rnd.random() < 0.9 else None, f"s{rnd.randrange(40)}" if rnd.random() < 0.9 else None) for _ in range(60)]
    df = spark.createDataFrame(rows, "author string, source string")
    kinds = {"author": entity("author", F.col("author")), "source": entity("source", F.col("source"))}
    got = {r["entity"]: r["family"] for r in entity_families(df, kinds, Stages(spark, "t")).collect()}
    name = lambda k, v: f"{k}\x1f{v}"
    edges = [(name("author", a), name("source", s)) for a, s in rows if a and s] + [(x, x) for a, s in rows for x in ([name("author", a)] if a else []) + ([name("source", s)] if s else [])]
    assert got == union_find(edges)
