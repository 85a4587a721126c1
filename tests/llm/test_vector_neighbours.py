import numpy as np
from pyspark.sql import functions as F

from stillhouse.llm.vector_neighbours import all_neighbours, dense_vectors, neighbours_of


def brute(ids, x, k, radius=np.inf):
    out = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order) if d[j] <= radius}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id bigint, v array<double>")


def test_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(1)
    ids = rng.permutation(300)
    x = rng.normal(size=(300, 9)) * 5
    x[:40] = x[40:80] + rng.normal(size=(40, 9)) * 0.1
    x[5] *= 1e6  # one huge vector must not spoil the codes of the others
    for radius in (np.inf, 3.0):
        for rows in (64, 1000):
            got = {(r["id"], r["neighbour"], r["rank"]) for r in all_neighbours(frame(spark, ids, x), 5, radius, rows).collect()}
            assert got == brute(ids, x, 5, radius)
    q = frame(spark, ids, x).filter("id % 10 = 0")
    got = {(r["id"], r["neighbour"], r["rank"]) for r in neighbours_of(q, frame(spark, ids, x), 4, np.inf, 50).collect()}
    assert got == {t for t in brute(ids, x, 4) if t[0] % 10 == 0}


def test_ties_and_few_rows(spark):
    x = np.zeros((8, 3))
    got = {(r["id"], r["neighbour"]) for r in all_neighbours(frame(spark, range(8), x), 3, np.inf, 4).collect()}
    assert {b for a, b in got if a == 7} == {0, 1, 2} and {b for a, b in got if a == 0} == {1, 2, 3}
    assert all_neighbours(frame(spark, [1], x[:1]), 3).count() == 0
    assert all_neighbours(frame(spark, [], x[:0]), 3).count() == 0
    assert all_neighbours(frame(spark, [1, 2], x[:2]), 3).count() == 2


def test_vectors_from_maps(spark):
    rows = [(1, {"a b": 1.0, "C": 2.0}), (2, {" A B ": float("nan"), "c": None}), (3, None), (4, {}), (None, {"c": 1.0}), (5, {"a_b": 3.0}), (5, {"a_b": 3.0})]
    df = spark.createDataFrame(rows, "profile_id bigint, features map<string,double>").withColumn("id", F.lit(9)).withColumn("v", F.lit(0))
    got = {r["id"]: list(r["v"]) for r in dense_vectors(df, "profile_id", "features").collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [3.0, 0.0]}
    assert dense_vectors(df.limit(0), "profile_id", "features").count() == 0


def test_no_vector_is_sent(spark):
    """Vectors meet each other through the shared folder: a plan without any exchange, however many blocks there are."""
    x = np.random.default_rng(2).normal(size=(200, 4))
    plan = all_neighbours(frame(spark, range(200), x), 5, 1.0, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan


def test_far_rows_are_passed_over(monkeypatch):
    import pyarrow as pa

    from stillhouse.llm import vector_neighbours as V

    met, product = [], V._product
    monkeypatch.setattr(V, "_product", lambda a, b: met.append(len(a) * len(b)) or product(a, b))
    x = np.random.default_rng(3).normal(size=(8000, 8)) * 4
    x[1::2] = x[::2] + 0.1
    rows = pa.table({"id": np.arange(8000), "v": list(x)})
    block, heaps = V._Block(rows), V._Heaps(8000, 5, 2.0)
    V._search(block, block, heaps)
    assert sum(met) < 0.4 * 8000**2 and (heaps.d[:, 0] < 0.3).all()
    for i in range(0, 8000, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((np.arange(8000), d)) if j != i and d[j] <= 2.0][:5]
        assert list(heaps.i[i][np.isfinite(heaps.d[i])]) == near
