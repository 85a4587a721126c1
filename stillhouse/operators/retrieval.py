"""Chunking, inverted index, hash vectors and hybrid search as joins and aggregations over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.functions.text import bm25_tokens, normalize_text


@dataclass(frozen=True)
class SearchParams:
    k1: float = 1.5
    b: float = 0.75
    buckets: int = 384
    vector_weight: float = 0.65
    bm25_weight: float = 0.35
    route_k: int = 60
    top_k: int = 10


def char_chunks(docs: DataFrame, size: int = 800, overlap: int = 100, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_no, chunk_text, ...) of windows of ``size`` characters that overlap.

    White space is normalised first; empty texts and nulls have no chunk; the last window ends with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    text = normalize_text(F.col("text"))
    body = docs.select("doc_id", *(keep or []), text.alias("_t")).filter("_t <> ''")
    last = F.greatest(F.lit(0), F.ceil((F.length("_t") - size) / F.lit(float(step)))).cast("int")
    out = body.select("doc_id", *(keep or []), "_t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return out.withColumn("chunk_text", F.trim(F.substring(F.col("_t"), F.col("chunk_no") * step + 1, F.lit(size)))).drop("_t").filter("chunk_text <> ''")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): term frequencies with the length of their document, in tokens."""
    tokens = docs.select(F.col(id_col).alias("id"), bm25_tokens(F.col(text_col)).alias("t")).filter(F.size("t") > 0)
    return tokens.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_statistics(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ``n_docs`` is one row with column n."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n").cast("double")
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # n_docs: one row


def bm25_scores(queries: DataFrame, docs: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, id, score) of all documents that share a term with a query.

    ``queries`` has query_id and query_text, ``docs`` id and text. A term that stands in a query several times counts as
    often. Only postings of the queries' terms are scored: the join is on the term.
    """
    post = postings(docs, "id", "text")
    stats = docs.select("id", F.size(bm25_tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"))
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = post.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    rows = wanted.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = F.col("qtf") * idf * tf * (params.k1 + 1.0) / (tf + params.k1 * (1.0 - params.b + params.b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score")).filter("score > 0")


def hash_vector(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(id, bucket, w): lower-cased blank-separated tokens counted in md5 buckets, L2-normalised; sparse, long form."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(normalize_text(F.col(text_col))), " ")).alias("t")).filter("t <> ''")
    bucket = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    counts = words.groupBy("id", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("c"))
    norm = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norm, "id").select("id", "bucket", (F.col("c") / F.col("norm")).alias("w"))


def vector_scores(queries: DataFrame, docs: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, id, score): inner products of hash vectors."""
    q = hash_vector(queries, "query_id", "query_text", params.buckets).select(F.col("id").alias("query_id"), "bucket", F.col("w").alias("qw"))
    d = hash_vector(docs, "id", "text", params.buckets)
    return d.join(q, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def top_per_query(scores: DataFrame, k: int, score: str = "score", ident: str = "id") -> DataFrame:
    """The k best rows of each query, ties to the smaller id; rank from 1. Scores are compared at 9 decimals."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), ident)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def min_max(scores: DataFrame, out: str) -> DataFrame:
    """Scores of each query on [0, 1]; all 0 where they don't differ."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn(out, F.when(hi <= lo, 0.0).otherwise((F.col("score") - lo) / (hi - lo)))


def hybrid_scores(queries: DataFrame, docs: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, id, fused, vector_score, bm25_score): both routes' best, min-max normalised and summed by weight.

    A side that lacks an id counts 0; weights are normalised to 1.
    """
    v = min_max(top_per_query(vector_scores(queries, docs, params), params.route_k).drop("rank"), "nv").withColumnRenamed("score", "vector_score")
    s = min_max(top_per_query(bm25_scores(queries, docs, params), params.route_k).drop("rank"), "ns").withColumnRenamed("score", "bm25_score")
    total = params.vector_weight + params.bm25_weight
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = v.join(s, ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", (params.vector_weight / total * zero("nv") + params.bm25_weight / total * zero("ns")).alias("fused"), zero("vector_score").alias("vector_score"), zero("bm25_score").alias("bm25_score"))


def group_evidence(hits: DataFrame, chunks_per_doc: int, top_docs: int) -> DataFrame:
    """(query_id, doc_id, doc_rank, doc_score, chunks): hits (query_id, doc_id, chunk_no, score) by document, best first."""
    per_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(F.round("score", 9)), "chunk_no")
    kept = hits.withColumn("r", F.row_number().over(per_doc)).filter(F.col("r") <= chunks_per_doc)
    docs = kept.groupBy("query_id", "doc_id").agg(F.max("score").alias("doc_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_no"))), lambda x: x["chunk_no"].cast("string")), ",").alias("chunks"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("doc_score", 9)), "doc_id")
    return docs.withColumn("doc_rank", F.row_number().over(w)).filter(F.col("doc_rank") <= top_docs)


def merge_evidence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of two rounds (query_id, doc_id, chunk_no, score) as one: the larger score of each chunk wins."""
    return first.unionByName(second).groupBy("query_id", "doc_id", "chunk_no").agg(F.max("score").alias("score"))


def dot(a: str, b: str):
    """Inner product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def grid_join(queries: DataFrame, rows: DataFrame, by: tuple[str, str], query_block: int = 2_048, row_block: int = 16_384) -> DataFrame:
    """Every query row with every row, as an equi-join on a grid of blocks: for a stated query set against all rows.

    ``by`` names the columns whose hash deals queries and rows into blocks, so that no task holds more than a pair of
    blocks, however many there are.
    """
    nq, nr = max(1, -(-queries.count() // query_block)), max(1, -(-rows.count() // row_block))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.withColumn("_i", at(by[0], nq)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = rows.withColumn("_j", at(by[1], nr)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return r.join(q, ["_i", "_j"]).drop("_i", "_j")


def dense_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id, score): exact inner products of the vectors (id, v) with a stated query set (query_id, qv)."""
    return grid_join(queries, vectors, ("query_id", "id")).select("query_id", "id", dot("qv", "v").alias("score"))
