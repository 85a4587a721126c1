import pytest
from pyspark.sql import functions as F

from stillhouse.operators.evidence import bad_term, evidence_gate, merge_annotations, merge_first, paragraph_chunks
from stillhouse.operators.knn import block_nearest, feature_scales, nearest, rank_spaced, shared_feature_distance
from stillhouse.sources.files import load_tei, upsert_sources


def cut(text, most):
    """Paragraph chunks by hand."""
    chunks, current = [], ""
    for p in [x.strip() for x in (text or "").replace("\r\n", "\n").split("\n\n") if x.strip()]:
        joined = f"{current}\n\n{p}" if current else p
        if len(joined) <= most:
            current = joined
            continue
        if current:
            chunks.append(current)
        if len(p) <= most:
            current = p
        else:
            chunks += [p[i : i + most] for i in range(0, len(p), most)]
            current = ""
    return chunks + ([current] if current else [])


def test_paragraph_chunks(spark):
    texts = [None, "", " \n\n ", "short", "a" * 25, "ab\n\ncd\n\n" + "e" * 10 + "\n\nf", "x" * 10 + "\r\n\r\n" + "y" * 21 + "\n\nz", "b " * 400 + "\n\n" + "c" * 7, "一二三四五六七八九十十一\n\né" * 3]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(paragraph_chunks(F.col("t"), 10)).collect()]
    assert got == [cut(t, 10) for t in texts]


def test_gate_with_equivalent_documents(spark):
    rows = [
        (1, "two_doc", ["a", "b"], ["a"], None), (2, "two_doc", ["a", "b"], ["x"], [["a", "x"], ["b"]]), (3, "single_doc", ["a"], [" x "], [["a", "x"]]), (4, "single_doc", ["a", "b"], ["b"], None),
        (5, "single_doc", [], ["a"], None), (6, None, None, None, None), (7, "single_doc", ["a", "a", " ", None], ["a"], None),
    ]
    df = spark.createDataFrame(rows, "id int, mode string, gold array<string>, predicted array<string>, groups array<array<string>>").withColumn("coverage", F.lit("clash"))
    got = {r["id"]: (r["applied"], r["strict_pass"], r["soft_pass"], r["strict_coverage"], r["coverage"]) for r in evidence_gate(df).collect()}
    assert got == {1: (True, False, True, 0.5, 0.5), 2: (True, False, True, 0.0, 0.5), 3: (True, False, True, 0.0, 1.0), 4: (True, True, False, 0.5, 0.5), 5: (False, True, True, 1.0, 1.0), 6: (False, True, True, 1.0, 1.0), 7: (True, True, True, 1.0, 1.0)}


def test_first_list_wins(spark):
    a = spark.createDataFrame([("k", "x", 0.1), ("k", "y", None), ("k", "x", 0.3)], "g string, id string, score double")
    b = spark.createDataFrame([("k", "z", 0.9), ("k", "y", 0.8), ("l", "z", 0.5)], "g string, id string, score double")
    got = [tuple(r) for r in merge_first([a, b], ["g"], "id").orderBy("g", "rank").collect()]
    assert got == [("k", "x", 0.3, 0, 1), ("k", "y", 0.8, 0, 2), ("k", "z", 0.9, 1, 3), ("l", "z", 0.5, 1, 1)]
    assert merge_first([a, b], ["g"], "id", 1).count() == 2 and merge_first([a.limit(0)], ["g"], "id").count() == 0


def test_annotations_of_the_selection_stay(spark):
    s = spark.createDataFrame([("1", "mine", None), ("9", None, "only here")], "id string, label string, note string")
    c = spark.createDataFrame([("1", "theirs", "kept"), ("2", "other", None)], "id string, label string, note string")
    assert {tuple(r) for r in merge_annotations(s, c, "id").collect()} == {("1", "mine", "kept", True), ("9", None, "only here", True), ("2", "other", None, False)}


@pytest.mark.parametrize("term,want", [("", True), (None, True), ("the", True), ("oil of", True), ("ab", True), ("oxidation", True), ("oxidation rate", False), ("1984", True), ("resin", False)])
def test_bad_terms(spark, term, want):
    assert spark.createDataFrame([(term,)], "t string").select(bad_term(F.col("t"))).first()[0] is want


def test_blocks_find_what_the_join_finds(spark, small):
    x = spark.read.parquet(f"{small}/sample_profiles.parquet").select(F.col("profile_id").alias("id"), F.explode("features").alias("feature", "value")).filter("value is not null and not isnan(value)").groupBy("id", "feature").agg(F.max("value").alias("value"))
    q = x.filter("id % 3 = 0")
    for scales, weights in ((None, None), (feature_scales(x, True), x.select("feature").distinct().withColumn("weight", F.lit(0.3)).limit(5))):
        want = {(r["query_id"], r["id"], r["rank"], r["shared"], round(r["distance"], 9)) for r in nearest(shared_feature_distance(q, x, scales, weights, 0.7), 4).collect()}
        got = {(r["query_id"], r["id"], r["rank"], r["shared"], round(r["distance"], 9)) for r in block_nearest(q, x, 4, scales, weights, 0.7, query_rows=7, history_rows=11).collect()}
        assert got == want and got
    assert block_nearest(q.limit(0), x, 4).count() == 0 and block_nearest(q, x.limit(0), 4).count() == 0


def test_rank_spaced(spark):
    rows = spark.createDataFrame([("hot", i % 500, i) for i in range(2000)] + [("few", 3, 1), ("few", 1, 2)], "g string, v int, id int")
    got = {}
    for r in rank_spaced(rows.repartition(7), "g", ["v", "id"], 5).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["v"]))
    assert sorted(got["few"]) == [(0, 1), (1, 3)] and sorted(r for r, _ in got["hot"]) == [0, 500, 1000, 1499, 1999]
    order = sorted((i % 500, i) for i in range(2000))
    assert all(v == order[r][0] for r, v in got["hot"])


def test_sources_are_put_in(spark):
    old = spark.createDataFrame([("/A/b/", "one", "h"), ("/c", "two", None), (None, "x", "y")], "path string, name string, hint string")
    new = spark.createDataFrame([("/a//B", None, "new"), ("/d", "four", None)], "path string, name string, hint string")
    assert {tuple(r) for r in upsert_sources(old, new).collect()} == {("/a/b", "one", "new", "updated"), ("/c", "two", None, "kept"), ("/d", "four", None, "added")}


def test_tei(spark):
    xml = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On  resins</title></titleStmt><publicationStmt><date when="2014-03-01"/></publicationStmt>
    <sourceDesc><biblStruct><analytic><author><persName><forename>A.</forename><surname>Smith</surname></persName></author><author><persName><forename>B.</forename><surname>Jones</surname></persName></author><idno type="DOI">10.1/x</idno></analytic><monogr><title>Notes</title></monogr></biblStruct></sourceDesc></fileDesc>
    <profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader><text><body><div><head>Intro</head><p>First
    words.</p><p>More.</p></div><div><head>Empty</head></div><div><p>Last.</p></div></body></text></TEI>"""
    files = spark.createDataFrame([("a.xml", bytearray(xml.encode())), ("b.txt", bytearray(b"no xml")), ("c.xml", None)], "path string, content binary")
    docs, sections = load_tei(files)
    assert [tuple(r) for r in docs.collect()] == [("a.xml", "On resins", "Notes", "10.1/x", 2014, ["A. Smith", "B. Jones"], "Short.")]
    assert {tuple(r) for r in sections.collect()} == {("a.xml", 1, "First words. More."), ("a.xml", 3, "Last.")}
