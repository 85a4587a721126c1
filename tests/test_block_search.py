import numpy as np
from pyspark.sql import functions as F

from stillhouse.operators import block_search as B
from stillhouse.operators import knn as K
from stillhouse.plans import knn as P

SCHEMA = "profile_id bigint, features map<string,double>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ragged(n, seed, copies=0):
    """Profiles of which many lack features, each in its own way, with equal ones among them."""
    rng = np.random.default_rng(seed)
    rows = [(i, {f"f{j}": float(np.round(rng.normal() * 3, 2)) for j in range(9) if rng.random() < (0.5 if i % 2 else 1)}) for i in range(n)]
    return rows + [(n + i, rows[i][1]) for i in range(copies)]


def test_no_profile_is_sent(spark):
    h, q = K.staged_profiles([spark.createDataFrame(ragged(120, 1), SCHEMA), spark.createDataFrame(ragged(40, 2), SCHEMA)])
    scales = K.feature_scales(h.long(), True)
    assert "Exchange" not in plan(K.nearest_profiles(q, h, 3, scales, query_rows=8, history_rows=16))
    assert "Exchange" not in plan(K.block_nearest(q.long(), h.long(), 3, scales))


def test_odd_profiles_as_by_the_join(spark):
    rows = [*ragged(300, 3, copies=60), (900, None), (901, {}), (902, {" F0 ": 1.0, "f0": 2.0, "F 1": float("nan")}), (902, {"f2": 1.0}), (None, {"f0": 1.0})]
    df = spark.createDataFrame(rows, SCHEMA)
    (p,) = K.staged_profiles([df])
    long = K.long_profiles(df)
    assert {tuple(r) for r in p.long().collect()} == {tuple(r) for r in long.collect()}
    weights = long.select("feature").distinct().withColumn("weight", F.lit(0.4)).limit(4)
    told = lambda n: {(r["query_id"], r["id"], r["rank"], r["shared"], round(r["distance"], 9)) for r in n.collect()}
    for scales, w in ((K.feature_scales(long, True), None), (K.feature_scales(long, True), weights), (None, None)):
        seen = F.col("feature") != "f3"
        want = told(K.nearest(K.shared_feature_distance(long.filter(seen), long.filter(seen), scales, w, 0.7), 4))
        assert told(K.nearest_profiles(p, p, 4, scales, w, 0.7, lambda f: f == "f3", query_rows=50, history_rows=70)) == want and want


def test_standard_neighbours_need_no_join(spark):
    df = spark.createDataFrame([*ragged(250, 4, copies=101), (1000, {}), (1050, {"alone": 1.0})], SCHEMA)
    (p,) = K.staged_profiles([df])
    found = K.standard_neighbours(p, 5)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    told = lambda n: {(r["query_id"], r["id"], r["rank"], round(r["distance"], 5)) for r in n.collect()}
    assert told(found) == told(K.standard_neighbours(K.Profiles(None, p.long()), 5))


def test_leave_one_out_sends_no_profile(spark, small):
    assert "FlatMapCoGroups" not in plan(P.leave_one_out(spark, small))


def test_held_out_profiles_are_staged_once(spark, small, monkeypatch):
    """Five scenarios compare the same two staged tables; nothing is grouped by blocks of profiles."""
    staged = []
    monkeypatch.setattr(K, "stage", lambda df, keep=K.stage: staged.append(df.columns) or keep(df))
    text = plan(P.holdout_grid(spark, small))
    assert len([c for c in staged if "x" in c]) == 2 and "FlatMapCoGroups" not in text


def crowded(n, seed):
    """Profiles in crowds of up to forty, some alone; some lack a channel."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(n // 12, 12)) * 4
    near = middles[rng.integers(0, len(middles), n) ** 2 // len(middles)] + rng.normal(size=(n, 12)) * 0.05
    return [(i, {f"f{j}": float(near[i, j]) for j in range(12) if i % 5 or j < 8}) for i in range(n)]


def test_crowds_hide_no_neighbour_and_show_none_twice(spark):
    df = spark.createDataFrame(crowded(900, 5), SCHEMA)
    (p,) = K.staged_profiles([df])
    told = lambda n: sorted((r["query_id"], r["id"], r["rank"], round(r["distance"], 8)) for r in n.collect())
    want = told(K.nearest(K.shared_feature_distance(p.long(), p.long(), K.feature_scales(p.long(), True)), 4))
    assert told(K.nearest_profiles(p, p, 4, K.feature_scales(p.long(), True), query_rows=400, history_rows=300)) == want
    assert told(K.standard_neighbours(p, 5)) == told(K.standard_neighbours(K.Profiles(None, p.long()), 5))


def test_rows_of_a_crowd_are_compared_as_one():
    rng = np.random.default_rng(6)
    z = np.repeat(rng.normal(size=(50, 6)) * 4, 30, axis=0) + rng.normal(size=(1500, 6)) * 0.01
    order, number = B.crowds(z[rng.permutation(1500)])
    assert sorted(order) == list(range(1500)) and len(set(number)) <= 60


def test_scenarios_are_searched_in_one_pass(spark, small):
    """No neighbour is joined with its values, and history is read in one stage for all five scenarios."""
    for query in (P.holdout_grid, P.leave_one_out):
        text = plan(query(spark, small))
        assert "Join" not in text and text.count("MapInArrow") == 1


def test_a_block_holds_what_crowds(spark):
    """20,000 rows of 120 features, read in one task, are one block: rows of a spot form one crowd, not one per block."""
    from stillhouse.operators.block_search import _NUMBERS, Measure, _in_crowds

    spots = spark.range(0, 20_000, 1, 1).select("id", F.expr("transform(sequence(1, 120), i -> cast((id % 50) * i as double))").alias("x"))
    staged = _in_crowds(spots, Measure(np.ones(120), np.ones(120)), np.arange(120), min(65_536, _NUMBERS // 120))
    crowd = np.array([r["crowd"] for r in staged.select("crowd").collect()])
    assert 1 + (np.diff(crowd) != 0).sum() == 50
