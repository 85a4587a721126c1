import random

from pyspark.sql import functions as F

from stillhouse.llm.components import components
from stillhouse.llm.near_duplicates import NearParams, near_groups, near_links, near_pairs
from stillhouse.llm.words import WORD


def shingled(text, width):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, limit):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            s, t = shingled(x, width), shingled(y, width)
            if a != b and s and t and len(s & t) / len(s | t) >= limit:
                out.add((min(a, b), max(a, b)))
    return out


def texts(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rnd.choice(words) for _ in range(60)]
        rows.append((f"a{i}", " ".join(base)))
        for k in range(rnd.randint(0, 2)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(60)] = rnd.choice(words)
            rows.append((f"b{i}_{k}", " ".join(copy)))
    return rows


def test_pairs_match_brute_force(spark):
    for width, limit in ((3, 0.45), (5, 0.8)):
        rows = texts(width)
        got = {tuple(r) for r in near_pairs(spark.createDataFrame(rows, "id string, text string"), NearParams(width=width, similarity=limit)).collect()}
        assert got == brute(rows, width, limit) and got


def test_odd_rows(spark):
    body = "one two three four five six seven eight nine ten"
    rows = [("a", body), ("a", body), ("b", body.upper() + "!"), ("c", None), ("d", ""), ("e", "two words"), (None, body), ("f", body + " eleven"), ("g", "x " * 100_000)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("keys", F.lit(1)).withColumn("same", F.lit("clash"))
    got = {tuple(r) for r in near_pairs(df, NearParams(width=3, similarity=0.8)).collect()}
    assert got == {("a", "b"), ("a", "f"), ("b", "f")}
    groups = {r["id"]: (r["group_id"], r["copies_of"], r["links"]) for r in near_groups(df, NearParams(width=3, similarity=0.8)).collect()}
    assert groups["b"] == ("a", "a", 1) and groups["f"] == ("a", "f", 1) and groups["g"] == ("g", "g", 0) and groups["e"] == ("e", "e", 0) and groups["c"] == groups["d"] == ("c", "c", 0)
    links, members = near_links(df.limit(0))
    assert links.count() == 0 and members.count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100 and all(got[200 + i] == 200 for i in range(60))
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
    assert [tuple(r) for r in components(spark.createDataFrame([("x", "x")], "a string, b string")).collect()] == [("x", "x")]


def test_short_texts_stay_in_the_groups(spark):
    """Texts of fewer words than a shingle: copies fall together, no pair is made of them, nobody vanishes."""
    df = spark.createDataFrame([("a", "Heavy oil"), ("b", "heavy  OIL"), ("c", "oil heavy"), ("d", None), ("e", ""), ("f", "one two three four"), ("g", "One, two, three, four!")], "id string, text string")
    params = NearParams(width=3, similarity=0.8)
    groups = {r["id"]: r["group_id"] for r in near_groups(df, params).collect()}
    assert set(groups) == set("abcdefg") and groups["a"] == groups["b"] == "a" and groups["c"] == "c" and groups["d"] == groups["e"] and groups["f"] == groups["g"] == "f"
    assert {tuple(r) for r in near_pairs(df, params).collect()} == {("f", "g")}
    apart = df.withColumn("part", F.when(F.col("id") == "g", "y").otherwise("x"))
    assert near_pairs(apart, params).count() == 0
