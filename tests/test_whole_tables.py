"""Queries without SQL that must use every pair row and every dimension."""

import os

import pytest

import __spark_entry__ as entry
from spoorlens.plans import pipelines as PL
from spoorlens.plans.pipeline_queries import DIMS
from spoorlens.plans.relational_queries import mp

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
DISTANCES = ["euclidean", "manhattan", "chebyshev", "canberra"]


def test_every_pipeline_takes_part(spark):
    usable = {r["pipeline"]: r["count"] for r in mp(spark, DATA).filter("same is not null").na.drop(subset=DISTANCES).groupBy("pipeline").count().collect()}
    assert len(usable) == 3
    judged = {}
    for r in entry.queries()["pl14_distance_benchmark"](spark, DATA).collect():
        judged[r["pipeline"]] = judged.get(r["pipeline"], 0) + r["tp"] + r["fn"] + r["fp"] + r["tn"]
    assert judged == usable
    weights = entry.queries()["pl20_distance_weights"](spark, DATA).collect()
    assert {(r["pipeline"], r["distance"]) for r in weights} == {(p, x) for p in usable for x in DISTANCES}
    assert {r["pipeline"] for r in entry.queries()["ag14_auc_by_pipeline"](spark, DATA).collect()} == set(usable)


@pytest.mark.parametrize("name, step, place", [("pl02_fold_pairs", "cross_validated_pairs", 1), ("pl04_baseline_pairs", "baseline_pairs", 2), ("pl05_embedding_pairs", "embedding_pairs", 2), ("pl07_experiments", "experiments", 1)])
def test_every_dimension_takes_part(spark, monkeypatch, name, step, place):
    class Seen(Exception):
        pass

    def see(*args, **kw):
        raise Seen(args[place])

    monkeypatch.setattr(PL, step, see)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, DATA)
    assert seen.value.args[0] == DIMS
