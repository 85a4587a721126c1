"""Queries on tags, keywords and document similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.plans.corpus import _CH, _chunks
from stillhouse.sources.tables import stage, table


def _tags(spark, d) -> DataFrame:
    """(chunk_id, file_name, tag): the distinct tags of each chunk."""
    both = F.array_distinct(F.concat(F.coalesce("entity_tags", F.array().cast("array<string>")), F.coalesce("method_tags", F.array().cast("array<string>"))))
    return _chunks(spark, d).select("chunk_id", "file_name", F.explode(both).alias("tag")).filter("tag is not null")


_TG = f"{_CH}, tg as (select distinct chunk_id, file_name, tag from (select chunk_id, file_name, unnest(list_concat(coalesce(entity_tags, []), coalesce(method_tags, []))) as tag from ch) where tag is not null)"


def tag_nodes(spark, d):
    return _tags(spark, d).groupBy("tag").agg(F.count("*").alias("chunks"), F.countDistinct("file_name").alias("files"))


def tag_cooccurrence(spark, d):
    """Pairs of tags that stand in one chunk, with their number; a chunk has a handful of tags."""
    t = _tags(spark, d).select("chunk_id", "tag")
    pairs = t.withColumnRenamed("tag", "source").join(t.withColumnRenamed("tag", "target"), "chunk_id").filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).filter("weight >= 2")


def file_summary(spark, d):
    """Chunks per file with its eight most frequent tags."""
    c = _chunks(spark, d).groupBy("file_name").agg(F.count("*").alias("chunks"), F.max("year").alias("year"))
    n = _tags(spark, d).groupBy("file_name", "tag").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("n"), "tag"))).filter("r <= 8")
    tags = top.groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ";").alias("tags"))
    return c.join(tags, "file_name", "left").select("file_name", "chunks", "year", F.coalesce("tags", F.lit("")).alias("tags"))


def _terms(spark, d) -> DataFrame:
    """(doc_id, term, tf): words of four letters or more of each title."""
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_TERMS = "tm as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}')) as term from documents) group by all), nd as (select count(*) as n from documents)"


def keyword_scores(spark, d):
    """Keywords in 4 to 18 % of the documents: score = tf ln(1 + N / df)."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    g = _terms(spark, d).groupBy("term").agg(F.sum("tf").cast("bigint").alias("tf"), F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n: one row
    kept = g.filter((F.col("df") >= 4) & (F.col("df") <= F.greatest(F.lit(1.0), F.bround(0.18 * F.col("n")))))
    return kept.select("term", "tf", "df", F.round(F.col("tf") * F.log(1.0 + F.col("n") / F.col("df")), 6).alias("score"))


_KEPT = f"{_TERMS}, kw as (select term, sum(tf)::bigint as tf, count(*) as df from tm group by 1), kept as (select term, tf, df, round(tf * ln(1 + n::double / df), 6) as score from kw, nd where df >= 4 and df <= greatest(1, round_even(0.18::double * n, 0)))"


def keyword_cooccurrence(spark, d):
    """Pairs of kept keywords in one title."""
    t = _terms(spark, d).join(keyword_scores(spark, d).select("term"), "term", "left_semi").select("doc_id", "term")
    pairs = t.withColumnRenamed("term", "source").join(t.withColumnRenamed("term", "target"), "doc_id").filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).filter("weight >= 3")


def keyword_years(spark, d):
    t = _terms(spark, d).join(table(spark, d, "documents").select("doc_id", "pub_year").filter("pub_year is not null"), "doc_id").join(keyword_scores(spark, d).select("term"), "term", "left_semi")
    return t.groupBy("term", "pub_year").agg(F.countDistinct("doc_id").alias("documents"))


def tfidf_similar_documents(spark, d):
    """For documents with an id divisible by 50 the five most similar titles: cosine of sqrt(tf) (ln((N+1)/(df+1)) + 1),
    over terms of at least two documents and at most 35 % of them."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    tm = _terms(spark, d)
    df = tm.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter("df >= 2 and df / n <= 0.35")  # n: one row
    w = tm.join(df, "term").select("doc_id", "term", (F.sqrt("tf") * (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    u = w.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("u"))
    q = u.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "term", F.col("u").alias("qu"))
    s = q.join(u, "term").filter("doc_id <> query_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("qu") * F.col("u")).alias("cosine"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "doc_id"))
    return s.withColumn("rank", r).filter("rank <= 5").select("query_id", "doc_id", "rank", F.round("cosine", 6).alias("cosine"))


# Weights of a word in the title and in the text, for keywords and for similar documents.
KEYWORD_WEIGHTS, PROFILE_WEIGHTS = (6.0, 2.0), (4.0, 0.35)


def _text_terms(spark, d, weights: tuple[float, float]) -> DataFrame:
    """(doc_id, term, tf): words of four letters or more of title and whole text, each with its weight; staged."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    counted = lambda c, w: F.transform(words(c), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.explode(F.concat(counted("title", weights[0]), counted("text", weights[1]))).alias("x")
    rows = table(spark, d, "documents").select("doc_id", both).select("doc_id", "x.term", "x.w")
    return stage(rows.groupBy("doc_id", "term").agg(F.round(F.sum("w"), 6).alias("tf")))


_TEXT_TERMS = """tm as (select doc_id, term, round(sum(w), 6) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{4,}}')) as term, {0}::double as w from documents
 union all select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')), {1}::double from documents) group by 1, 2), nd as (select count(*) as n from documents)"""


def _kept_text_terms(spark, d, terms: DataFrame) -> DataFrame:
    """(term, tf, df, score) of the terms in 4 to 18 % of all documents."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    g = terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n: one row
    kept = g.filter((F.col("df") >= 4) & (F.col("df") <= F.greatest(F.lit(1.0), F.bround(0.18 * F.col("n")))))
    return kept.select("term", F.round("tf", 4).alias("tf"), "df", F.round(F.col("tf") * F.log(1.0 + F.col("n") / F.col("df")), 4).alias("score"))


def keyword_text_scores(spark, d):
    """As keyword_scores, over title and whole text: a word counts 6 in the title and 2 in the text."""
    return _kept_text_terms(spark, d, _text_terms(spark, d, KEYWORD_WEIGHTS))


_KEPT_TEXT = f"{_TEXT_TERMS.format(*KEYWORD_WEIGHTS)}, kept as (select term, round(tf, 4) as tf, df, round(tf * ln(1 + n::double / df), 4) as score from (select term, sum(tf) as tf, count(*) as df from tm group by 1), nd where df >= 4 and df <= greatest(1, round_even(0.18::double * n, 0)))"


def keyword_text_cooccurrence(spark, d):
    """Pairs of kept keywords in one document, title or text."""
    tm = _text_terms(spark, d, KEYWORD_WEIGHTS)
    kept = stage(_kept_text_terms(spark, d, tm).select("term", F.monotonically_increasing_id().alias("no")))  # pairs are counted by number
    lists = tm.join(kept, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list("no")).alias("nos"))  # a document's own words
    after = lists.select("nos", F.posexplode("nos").alias("i", "a")).select("a", F.explode(F.expr("slice(nos, i + 2, size(nos))")).alias("b"))
    pairs = after.groupBy("a", "b").agg(F.count("*").alias("weight")).filter("weight >= 3")
    named = pairs.join(kept.select(F.col("no").alias("a"), F.col("term").alias("ta")), "a").join(kept.select(F.col("no").alias("b"), F.col("term").alias("tb")), "b")
    return named.select(F.least("ta", "tb").alias("source"), F.greatest("ta", "tb").alias("target"), "weight")


def keyword_text_years(spark, d):
    tm = _text_terms(spark, d, KEYWORD_WEIGHTS)
    t = tm.join(table(spark, d, "documents").select("doc_id", "pub_year").filter("pub_year is not null"), "doc_id").join(_kept_text_terms(spark, d, tm).select("term"), "term", "left_semi")
    return t.groupBy("term", "pub_year").agg(F.countDistinct("doc_id").alias("documents"))


_DOC_BLOCK, _QUERY_BLOCK = 8192, 2048


def _block_cosines(key, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The five nearest of a block of documents for each of a block of queries: postings of the block, added up per query."""
    out: list[tuple] = []
    if len(docs) and len(queries):
        docs = docs.sort_values("doc_id")
        ids = docs["doc_id"].to_numpy()
        term, u = np.concatenate(docs["terms"].tolist()), np.concatenate([x / np.sqrt(x @ x) for x in docs["ws"]])
        at = np.repeat(np.arange(len(ids)), [len(x) for x in docs["terms"]])
        order = np.argsort(term, kind="stable")
        term, u, at = term[order], u[order], at[order]
        for q, qt, qw in zip(queries["query_id"].tolist(), queries["q_terms"], queries["q_ws"]):
            lo, hi = np.searchsorted(term, qt, "left"), np.searchsorted(term, qt, "right")
            n = hi - lo
            if not n.sum():
                continue
            p = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
            c = np.bincount(at[p], u[p] * np.repeat(qw / np.sqrt(qw @ qw), n), len(ids))
            c[ids == q] = 0.0
            held = np.flatnonzero(c)
            r = np.round(c[held], 9)
            for j in held[np.lexsort((ids[held], -r))[:5]]:
                out.append((q, int(ids[j]), float(c[j])))
    return pd.DataFrame(out, columns=["query_id", "doc_id", "cosine"]).astype({"query_id": "int64", "doc_id": "int64", "cosine": "float64"})


def tfidf_similar_texts(spark, d):
    """As tfidf_similar_documents, over title (weight 4) and whole text (weight 0.35): the stated query set against all
    documents as pairs of blocks, the five best of a block merged per query."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    tm = _text_terms(spark, d, PROFILE_WEIGHTS)
    df = tm.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter("df >= 2 and df / n <= 0.35")  # n: one row
    df = stage(df.withColumn("no", F.monotonically_increasing_id()))
    w = tm.join(df, "term").select("doc_id", "no", (F.sqrt("tf") * (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w"))
    v = w.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_list("no").alias("terms"), F.collect_list("w").alias("ws"))  # a document's own words
    v = stage(v)
    many = v.count()
    blocks, q_blocks = max(1, -(-many // _DOC_BLOCK)), max(1, -(-many // (50 * _QUERY_BLOCK)))
    part = lambda k: F.pmod(F.xxhash64("doc_id"), F.lit(k))
    docs = v.withColumns({"b": part(blocks), "qb": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint")))})
    queries = v.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("terms").alias("q_terms"), F.col("ws").alias("q_ws"), part(q_blocks).alias("q_qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("q_b"))
    s = docs.groupBy("b", "qb").cogroup(queries.groupBy("q_b", "q_qb")).applyInPandas(_block_cosines, "query_id bigint, doc_id bigint, cosine double")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "doc_id"))
    return s.withColumn("rank", r).filter("rank <= 5").select("query_id", "doc_id", "rank", F.round("cosine", 6).alias("cosine"))


def _centroids(spark, d) -> DataFrame:
    """(label, dim, x): L2-normalised mean vector per label, in long form."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    mean = long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, "label").select("label", "dim", (F.col("m") / F.col("norm")).alias("x"))


def label_centroids(spark, d):
    return _centroids(spark, d).select("label", "dim", F.round("x", 5).alias("x"))


_CENT = "lg as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as x from embeddings), mn as (select label, dim, avg(x) as m from lg group by all), ce as (select label, dim, m / sqrt(sum(m * m) over (partition by label)) as x from mn)"


def label_similarity(spark, d):
    """Pairs of labels by the inner product of their mean vectors: a join on the dimension."""
    c = _centroids(spark, d)
    a, b = c.select(F.col("label").alias("label_a"), "dim", F.col("x").alias("xa")), c.select(F.col("label").alias("label_b"), "dim", F.col("x").alias("xb"))
    s = a.join(b, "dim").filter("label_a < label_b").groupBy("label_a", "label_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    return s.select("label_a", "label_b", F.round("s", 4).alias("similarity"))


def type_allocation(spark, d):
    """A thousand places dealt to the document types in proportion, the largest remainders first."""
    g = table(spark, d, "documents").groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(F.count("*").alias("c"))
    total = g.agg(F.sum("c").alias("total"))
    q = g.crossJoin(F.broadcast(total)).withColumn("exact", F.col("c") * 1000.0 / F.col("total")).withColumn("base", F.floor("exact"))  # total: one row
    left = q.agg((F.lit(1000) - F.sum("base")).alias("left"))
    w = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "doc_type")  # one row per type
    return q.crossJoin(F.broadcast(left)).withColumn("r", F.row_number().over(w)).select("doc_type", (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("places"))


QUERIES = {f.__name__: f for f in (tag_nodes, tag_cooccurrence, file_summary, keyword_scores, keyword_cooccurrence, keyword_years, tfidf_similar_documents, keyword_text_scores, keyword_text_cooccurrence, keyword_text_years, tfidf_similar_texts, label_centroids, label_similarity, type_allocation)}
SQL = {
    "tag_nodes": f"with {_TG} select tag, count(*) as chunks, count(distinct file_name) as files from tg group by 1",
    "tag_cooccurrence": f"with {_TG} select a.tag as source, b.tag as target, count(*) as weight from tg a join tg b using (chunk_id) where a.tag < b.tag group by 1, 2 having count(*) >= 2",
    "file_summary": f"""with {_TG}, c as (select file_name, count(*) as chunks, max(year) as year from ch group by 1), n as (select file_name, tag, count(*) as n from tg group by all),
 t as (select file_name, string_agg(tag, ';' order by n desc, tag) as tags from (select *, row_number() over (partition by file_name order by n desc, tag) as r from n) where r <= 8 group by 1) select c.file_name, chunks, year, coalesce(tags, '') as tags from c left join t on c.file_name = t.file_name""",
    "keyword_scores": f"with {_KEPT} select * from kept",
    "keyword_cooccurrence": f"with {_KEPT}, k as (select doc_id, term from tm where term in (select term from kept)) select a.term as source, b.term as target, count(*) as weight from k a join k b using (doc_id) where a.term < b.term group by 1, 2 having count(*) >= 3",
    "keyword_years": f"with {_KEPT} select term, pub_year, count(distinct doc_id) as documents from tm join documents using (doc_id) where pub_year is not null and term in (select term from kept) group by 1, 2",
    "tfidf_similar_documents": f"""with {_TERMS}, df as (select term, count(*) as df, max(n) as n from tm, nd group by 1 having count(*) >= 2 and count(*)::double / max(n) <= 0.35), w as (select doc_id, term, sqrt(tf) * (ln((n + 1)::double / (df + 1)) + 1) as w from tm join df using (term)),
 u as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as u from w), s as (select q.doc_id as query_id, u.doc_id, sum(q.u * u.u) as cosine from u q join u using (term) where q.doc_id % 50 = 0 and u.doc_id <> q.doc_id group by all)
 select query_id, doc_id, rank, round(cosine, 6) as cosine from (select *, row_number() over (partition by query_id order by round(cosine, 9) desc, doc_id) as rank from s) where rank <= 5""",
    "keyword_text_scores": f"with {_KEPT_TEXT} select * from kept",
    "keyword_text_cooccurrence": f"with {_KEPT_TEXT}, k as (select doc_id, term from tm where term in (select term from kept)) select a.term as source, b.term as target, count(*) as weight from k a join k b using (doc_id) where a.term < b.term group by 1, 2 having count(*) >= 3",
    "keyword_text_years": f"with {_KEPT_TEXT} select term, pub_year, count(distinct doc_id) as documents from tm join documents using (doc_id) where pub_year is not null and term in (select term from kept) group by 1, 2",
    "label_centroids": f"with {_CENT} select label, dim, round(x, 5) as x from ce",
    "label_similarity": f"with {_CENT} select a.label as label_a, b.label as label_b, round(sum(a.x * b.x), 4) as similarity from ce a join ce b using (dim) where a.label < b.label group by 1, 2",
    "type_allocation": "with g as (select coalesce(doc_type, '') as doc_type, count(*) as c from documents group by 1), q as (select doc_type, c * 1000.0::double / sum(c) over () as exact from g), b as (select *, floor(exact) as base from q) select doc_type, (base + case when row_number() over (order by round(exact - base, 9) desc, doc_type) <= 1000 - sum(base) over () then 1 else 0 end)::bigint as places from b",
}
