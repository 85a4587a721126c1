import math
import re
from collections import Counter, defaultdict

from stillhouse.plans import graph

DOCS = "doc_id bigint, title string, text string, pub_year int"


def words(x):
    return re.findall("[a-z]{4,}", (x or "").lower())


def test_words_of_the_text_are_keywords(spark, tmp_path):
    """A word that stands only in texts, also of documents without a title, counts."""
    rows = [(i, None if i % 2 else "Plain title", "vanadyl sulfone" if i < 5 else f"other{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 4} words", 2000 + i % 2) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    got = {r["term"]: (r["tf"], r["df"], r["score"]) for r in graph.keyword_text_scores(spark, d).collect()}
    assert got["vanadyl"] == (10.0, 5, round(10 * math.log(1 + 40 / 5), 4))
    assert [("sulfone", "vanadyl", 5)] == [tuple(r) for r in graph.keyword_text_cooccurrence(spark, d).collect()]
    assert {(r["pub_year"], r["documents"]) for r in graph.keyword_text_years(spark, d).collect() if r["term"] == "vanadyl"} == {(2000, 3), (2001, 2)}


def test_similar_texts_against_brute_force(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "title", "text").collect()]
    tf = defaultdict(Counter)
    for r in rows:
        for t in words(r["title"]):
            tf[r["doc_id"]][t] += 4.0
        for t in words(r["text"]):
            tf[r["doc_id"]][t] += 0.35
    df = Counter(t for c in tf.values() for t in c)
    n = len(rows)
    vec = {}
    for k, c in tf.items():
        w = {t: math.sqrt(round(x, 6)) * (math.log((n + 1) / (df[t] + 1)) + 1) for t, x in c.items() if df[t] >= 2 and df[t] / n <= 0.35}
        size = math.sqrt(sum(x * x for x in w.values()))
        vec[k] = {t: x / size for t, x in w.items()}
    want = set()
    for q in vec:
        if q % 50 == 0:
            s = [(-round(c, 9), k) for k in vec if k != q and (c := sum(x * vec[k].get(t, 0.0) for t, x in vec[q].items())) > 0]
            want |= {(q, k, i + 1, round(-c, 5)) for i, (c, k) in enumerate(sorted(s)[:5])}
    for blocks in ((8192, 2048), (16, 1)):  # one pair of blocks, and many
        monkeypatch.setattr(graph, "_DOC_BLOCK", blocks[0])
        monkeypatch.setattr(graph, "_QUERY_BLOCK", blocks[1])
        got = {(r["query_id"], r["doc_id"], r["rank"], round(r["cosine"], 5)) for r in graph.tfidf_similar_texts(spark, d).collect()}
        assert got == want and len(got) >= 5
