import random

import numpy as np
from pyspark.sql import functions as F

from stillhouse.operators import corpus as C
from stillhouse.operators import curves as V
from stillhouse.operators import knn as K
from stillhouse.operators import retrieval as R


def test_char_chunks_cover_the_text(spark):
    texts = [(1, "ab " * 1000), (2, ""), (3, None), (4, "x"), (5, "　 \n"), (6, "y" * 800), (7, "z" * 801)]
    got = R.char_chunks(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 4, 6, 7} and len(by[4]) == len(by[6]) == 1 and len(by[7]) == 2 and all(len(r["chunk_text"]) <= 800 for r in got)


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "sulfur content of crude"), (2, "water content"), (3, None), (4, "")], "id bigint, text string")
    q = spark.createDataFrame([(1, "sulfur"), (2, "sulfur sulfur"), (3, "nothing"), (4, None)], "query_id bigint, query_text string")
    got = {r["query_id"]: r["score"] for r in R.bm25_scores(q, docs).collect()}
    assert set(got) == {1, 2} and abs(got[2] - 2 * got[1]) < 1e-12


def test_hybrid_of_one_hit_is_zero(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "id bigint, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id bigint, query_text string")
    assert [(r["fused"], r["bm25_score"] > 0) for r in R.hybrid_scores(q, docs).collect()] == [(0.0, True)]


def test_grid_join_is_all_pairs(spark):
    a, b = spark.range(7).withColumnRenamed("id", "q"), spark.range(11).withColumnRenamed("id", "r")
    got = {(x["q"], x["r"]) for x in R.grid_join(a, b, ("q", "r"), 2, 3).collect()}
    assert len(got) == 77


def test_nearest_rank(spark):
    rnd = random.Random(1)
    values = [rnd.randint(0, 50) for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value int")
    got = C.nearest_rank(df, {"a": 0.1, "b": 0.5, "c": 1.0}, ["g"]).first()
    s = sorted(values)
    assert (got["a"], got["b"], got["c"]) == (s[10], s[50], s[100])


def test_upsert_and_latest(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    news = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, C.upsert(base, news, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert C.upsert(base, news.limit(0), ["k"]).count() == 2


def test_drop_reasons(spark):
    cases = [("", "short_table_fragment"), ("a | b | c", "short_table_fragment"), ("Short prose that ends well enough and is not a table at all because it has many words.", "too_short"), ("word " * 50, None), ("acknowledgments " + "word " * 50, "reference_or_ack"), ("12 34 5 " * 30 + "x", "low_alpha_ratio"), (None, "short_table_fragment")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(C.drop_reason(F.col("t"), F.lit(None).cast("string"))).collect()]
    assert got == [w for _, w in cases]


def test_sentence_chunks_respect_the_budget(spark):
    text = " ".join(f"Sentence number {i} has seven words here." for i in range(40))
    got = C.sentence_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"), budget=30, overlap=1).orderBy("chunk_no").collect()
    assert all(len(r["chunk_text"].split()) <= 30 for r in got) and {r["doc_id"] for r in got} == {1}
    assert got[0]["chunk_text"].split(". ")[-1].rstrip(".") == got[1]["chunk_text"].split(". ")[0].rstrip(".")


def test_interpolation_matches_numpy(spark):
    rnd = random.Random(3)
    pts = [(1, float(x), rnd.random()) for x in sorted(rnd.sample(range(100), 12))]
    grid = [(float(g),) for g in range(-5, 110, 7)]
    got = V.interpolate(spark.createDataFrame(pts, "sample int, x double, y double"), spark.createDataFrame(grid, "gx double")).orderBy("gx").collect()
    want = np.interp([g for (g,) in grid], [p[1] for p in pts], [p[2] for p in pts])
    assert np.allclose([r["gy"] for r in got], want)


def test_nearest_within_matches_brute_force(spark):
    rnd = random.Random(4)
    left = sorted({(rnd.randint(1, 2), round(rnd.uniform(0, 50), 1)) for _ in range(40)})
    right = [(rnd.randint(1, 2), round(rnd.uniform(0, 50), 2), rnd.random()) for _ in range(60)]
    got = {(r["sample"], r["x"], r["rx"]) for r in V.nearest_within(spark.createDataFrame(left, "sample int, x double"), spark.createDataFrame(right, "sample int, rx double, ry double"), 1.5, 2).collect()}
    want = set()
    for s, x in left:
        near = sorted((abs(x - rx), rx) for t, rx, _ in right if t == s and abs(x - rx) <= 1.5)[:2]
        want |= {(s, x, rx) for _, rx in near}
    assert got == want


def test_curves_of_nulls_and_nothing(spark):
    none = spark.createDataFrame([], "sample int, x double, y double")
    odd = spark.createDataFrame([(1, None, 1.0), (1, 2.0, None), (1, float("nan"), 1.0), (None, 1.0, 1.0), (2, 1.0, 3.0), (2, 1.0, 5.0)], "sample int, x double, y double")
    assert V.curve_statistics(V.clean_points(none)).count() == 0 and V.weighted_histogram(none, 4).count() == 0
    got = {r["sample"]: r["y"] for r in V.clean_points(odd).collect()}
    assert got == {None: 1.0, 2: 4.0}


def test_distances_use_shared_features_only(spark):
    q = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0)], "id int, feature string, value double")
    h = spark.createDataFrame([(1, "a", 1.0), (2, "b", 4.0), (2, "a", 1.0), (3, "c", 1.0)], "id int, feature string, value double")
    got = {r["id"]: (round(r["distance"], 6), r["shared"]) for r in K.shared_feature_distance(q, h).collect()}
    assert got == {1: (1.0, 1), 2: (round((0.25 / 2) ** 0.5 + 0.5, 6), 2)}


def test_average_ranks_and_weights(spark):
    rnd = random.Random(5)
    rows = [(i, f, float(rnd.randint(0, 6))) for i in range(30) for f in ("t", "f")]
    import pandas as pd

    wide = pd.DataFrame(rows, columns=["id", "feature", "value"]).pivot(index="id", columns="feature", values="value")
    got = K.target_weights(spark.createDataFrame(rows, "id int, feature string, value double"), ["t"]).first()
    assert abs(got["pearson"] - wide["f"].corr(wide["t"])) < 1e-9 and abs(got["spearman"] - wide["f"].rank().corr(wide["t"].rank())) < 1e-9


def test_idw_prefers_the_near(spark):
    n = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (0, 3, 2.0)], "query_id int, id int, distance double")
    v = spark.createDataFrame([(1, "t", 10.0), (2, "t", 20.0)], "id int, feature string, value double")
    got = K.idw_estimates(n, v).first()
    assert abs(got["estimate"] - 10.0) < 1e-4 and got["supporters"] == 2 and (got["low"], got["high"]) == (10.0, 20.0)
