"""Queries over documents and embeddings: chunking, index statistics, search, evidence, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillhouse.functions.text import chunk_id
from stillhouse.operators import retrieval as R
from stillhouse.sources.tables import table

_SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = f"trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))"
_TOKENS = r"list_concat(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9\\\]^_/]+'), lambda x: lower(x)), regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]'))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: test items whose id is divisible by 50."""
    return table(spark, d, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def chunk_char_windows(spark, d):
    c = R.char_chunks(table(spark, d, "documents"), keep=["source"])
    return c.select("doc_id", "chunk_no", F.length("chunk_text").alias("n_chars"), chunk_id(F.col("source"), F.col("chunk_no"), F.col("chunk_text")).alias("chunk_id"))


_CHUNKS = f"""chunks as (select doc_id, source, k as chunk_no, trim(substr(t, k * 700 + 1, 800)) as chunk_text from
 (select doc_id, source, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 800) / 700.0))::int)) as k from (select doc_id, source, {_NORM} as t from documents) where t <> '') where trim(substr(t, k * 700 + 1, 800)) <> '')"""


def bm25_term_stats(spark, d):
    docs = _docs(spark, d)
    s = R.term_statistics(R.postings(docs, "id", "text"), docs.agg(F.count("*").alias("n")))
    return s.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_doc_lengths(spark, d):
    p = R.postings(_docs(spark, d), "id", "text")
    return p.groupBy("id").agg(F.sum("tf").cast("bigint").alias("dl"), F.count("*").alias("terms"))


_POST = f"""toks as (select doc_id as id, unnest({_TOKENS.format('text')}) as term from documents), post as (select id, term, count(*) as tf from toks group by all),
 lens as (select doc_id as id, len({_TOKENS.format('text')}) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from lens)"""
_BM25 = f"""{_POST}, asked as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_TOKENS.format('text')}) as term from eval_items where item_id % 50 = 0) group by all),
 dfs as (select term, count(*) as df from post group by all),
 bm as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score from post join lens using (id) join dfs using (term) join asked using (term), st group by all)"""
_VEC = f"""hw as (select kind, id, (concat('0x', substr(md5(t), 1, 8))::bigint % 384)::int as bucket from (select 'd' as kind, doc_id as id, unnest(string_split(lower({_NORM}), ' ')) as t from documents union all select 'q', item_id, unnest(string_split(lower({_NORM}), ' ')) from eval_items where item_id % 50 = 0) where t <> ''),
 hc as (select kind, id, bucket, count(*)::double as c from hw group by all), hv as (select kind, id, bucket, c / sqrt(sum(c * c) over (partition by kind, id)) as w from hc),
 vs as (select q.id as query_id, x.id, sum(q.w * x.w) as score from hv q join hv x on q.kind = 'q' and x.kind = 'd' and q.bucket = x.bucket group by all)"""
_TOP = "select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from {0}) where rank <= {1}"


def bm25_topk(spark, d):
    return R.top_per_query(R.bm25_scores(_queries(spark, d), _docs(spark, d)), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def hash_embed_topk(spark, d):
    return R.top_per_query(R.vector_scores(_queries(spark, d), _docs(spark, d)), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def hybrid_search(spark, d):
    h = R.hybrid_scores(_queries(spark, d), _docs(spark, d))
    top = R.top_per_query(h, 10, "fused")
    return top.select("query_id", "id", "rank", F.round("fused", 6).alias("fused"), F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"))


_MM = "select query_id, id, score, case when max(score) over w <= min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from ({0}) window w as (partition by query_id)"
_HYBRID = f"""with {_BM25}, {_VEC}, v as ({_MM.format(_TOP.format('vs', 60))}), b as ({_MM.format(_TOP.format('bm', 60))}),
 f as (select coalesce(v.query_id, b.query_id) as query_id, coalesce(v.id, b.id) as id, 0.65::double * coalesce(v.s, 0) + 0.35::double * coalesce(b.s, 0) as score, coalesce(v.score, 0) as vector_score, coalesce(b.score, 0) as bm25_score from v full join b on v.query_id = b.query_id and v.id = b.id)"""


def search_final(spark, d):
    """Fused scores only choose the candidates; the raw vector score orders the answer (hits of the other route have 0)."""
    h = R.top_per_query(R.hybrid_scores(_queries(spark, d), _docs(spark, d)), 60, "fused").drop("rank")
    return R.top_per_query(h, 10, "vector_score").select("query_id", "id", "rank", F.round("vector_score", 6).alias("vector_score"))


def _chunk_hits(spark, d, k=30):
    c = R.char_chunks(table(spark, d, "documents")).withColumn("id", F.concat("doc_id", F.lit(":"), "chunk_no"))
    s = R.bm25_scores(_queries(spark, d), c.select("id", F.col("chunk_text").alias("text")))
    split = F.split("id", ":")
    return R.top_per_query(s, k).select("query_id", split[0].cast("bigint").alias("doc_id"), split[1].cast("int").alias("chunk_no"), "score")


def document_evidence(spark, d):
    e = R.group_evidence(_chunk_hits(spark, d), 2, 10)
    return e.select("query_id", "doc_id", "doc_rank", F.round("doc_score", 6).alias("doc_score"), "chunks")


_CBM = f"""with {_CHUNKS}, ct as (select doc_id || ':' || chunk_no as id, {_TOKENS.format('chunk_text')} as t from chunks), toks as (select id, unnest(t) as term from ct), post as (select id, term, count(*) as tf from toks group by all),
 lens as (select id, len(t) as dl from ct), st as (select count(*) as n, avg(dl) as avgdl from lens), asked as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_TOKENS.format('text')}) as term from eval_items where item_id % 50 = 0) group by all),
 dfs as (select term, count(*) as df from post group by all),
 bm as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score from post join lens using (id) join dfs using (term) join asked using (term), st group by all)"""


def merged_evidence(spark, d):
    """Evidence of the chunk route merged with the whole-document route, chunk 0 standing for the document."""
    whole = R.top_per_query(R.vector_scores(_queries(spark, d), _docs(spark, d)), 20).select("query_id", F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), "score")
    m = R.merge_evidence(_chunk_hits(spark, d), whole)
    return m.groupBy("query_id", "doc_id").agg(F.count("*").alias("chunks"), F.round(F.max("score"), 6).alias("best"))


def vector_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    return R.top_per_query(R.dense_scores(q, v), 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


_DENSE = "ds as (select q.vec_id as query_id, v.vec_id as id, v.label, q.label as qlabel, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::double * x[2]::double)) as score from embeddings q, embeddings v where q.vec_id % 50 = 0)"


def retrieval_metrics_at_10(spark, d):
    """Hit, recall, precision, reciprocal rank and average precision of the ten nearest others, gold being the own label."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    labels = e.select(F.col("vec_id").alias("id"), "label")
    hits = R.top_per_query(R.dense_scores(q, v).filter("id <> query_id"), 10).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id")
    gold = labels.groupBy(F.col("label").alias("want")).agg((F.count("*") - 1).alias("gold"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = hits.join(gold, "want").withColumn("hit", (F.col("label") == F.col("want")).cast("int")).withColumn("seen", F.sum("hit").over(w))
    g = h.groupBy("query_id").agg(F.max("hit").alias("hit"), F.sum("hit").alias("n"), F.count("*").alias("k"), F.first("gold").alias("gold"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"))
    return g.filter("gold > 0").select("query_id", "hit", F.round(F.col("n") / F.col("gold"), 6).alias("recall"), F.round(F.col("n") / F.col("k"), 6).alias("precision"), F.round("rr", 6).alias("rr"), F.round(F.col("ap") / F.col("gold"), 6).alias("ap"))


def stale_index_check(spark, d):
    """Index ids without a document, and whether they are a fifth or more."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    missing = e.join(docs, "vec_id", "left_anti").agg(F.count("*").alias("missing"))
    return e.agg(F.count("*").alias("total")).crossJoin(missing).select("total", "missing", F.round(F.col("missing") / F.col("total"), 6).alias("ratio"), (F.col("missing") >= 0.2 * F.col("total")).alias("stale"))  # one row each


def references_by_source(spark, d):
    """The first ten distinct sources of each query's hits, numbered in hit order."""
    h = R.top_per_query(R.bm25_scores(_queries(spark, d), _docs(spark, d)), 60).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source").distinct(), "id")
    first = h.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "source")
    return first.withColumn("label", F.row_number().over(w)).filter("label <= 10")


QUERIES = {f.__name__: f for f in (chunk_char_windows, bm25_term_stats, bm25_doc_lengths, bm25_topk, hash_embed_topk, hybrid_search, search_final, document_evidence, merged_evidence, vector_topk, retrieval_metrics_at_10, stale_index_check, references_by_source)}
SQL = {
    "chunk_char_windows": f"with {_CHUNKS} select doc_id, chunk_no, length(chunk_text) as n_chars, md5(concat_ws('|', source, chunk_no::varchar, substr(chunk_text, 1, 200))) as chunk_id from chunks",
    "bm25_term_stats": f"with {_POST} select term, count(*) as df, round(ln(1 + (max(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)), 6) as idf from post, st group by term",
    "bm25_doc_lengths": f"with {_POST} select id, sum(tf)::bigint as dl, count(*) as terms from post group by id",
    "bm25_topk": f"with {_BM25} select query_id, id, rank, round(score, 6) as score from ({_TOP.format('bm', 10)})",
    "hash_embed_topk": f"with {_VEC} select query_id, id, rank, round(score, 6) as score from ({_TOP.format('vs', 10)})",
    "hybrid_search": f"{_HYBRID} select query_id, id, rank, round(score, 6) as fused, round(vector_score, 6) as vector_score, round(bm25_score, 6) as bm25_score from ({_TOP.format('f', 10)})",
    "search_final": f"{_HYBRID}, c as ({_TOP.format('f', 60)}) select query_id, id, rank, round(vector_score, 6) as vector_score from (select query_id, id, vector_score, row_number() over (partition by query_id order by round(vector_score, 9) desc, id) as rank from c) where rank <= 10",
    "document_evidence": f"""{_CBM}, h as ({_TOP.format('bm', 30)}), s as (select query_id, string_split(id, ':')[1]::bigint as doc_id, string_split(id, ':')[2]::int as chunk_no, score from h),
 k as (select *, row_number() over (partition by query_id, doc_id order by round(score, 9) desc, chunk_no) as r from s), g as (select query_id, doc_id, max(score) as doc_score, string_agg(chunk_no::varchar, ',' order by r) as chunks from k where r <= 2 group by all)
 select * from (select query_id, doc_id, row_number() over (partition by query_id order by round(doc_score, 9) desc, doc_id) as doc_rank, round(doc_score, 6) as doc_score, chunks from g) where doc_rank <= 10""",
    "merged_evidence": f"""{_CBM}, {_VEC}, h as ({_TOP.format('bm', 30)}), s as (select query_id, string_split(id, ':')[1]::bigint as doc_id, string_split(id, ':')[2]::int as chunk_no, score from h union all select query_id, id, 0, score from ({_TOP.format('vs', 20)})),
 m as (select query_id, doc_id, chunk_no, max(score) as score from s group by all) select query_id, doc_id, count(*) as chunks, round(max(score), 6) as best from m group by all""",
    "vector_topk": f"with {_DENSE} select query_id, id, rank, round(score, 5) as score from ({_TOP.format('ds', 10)})",
    "retrieval_metrics_at_10": f"""with {_DENSE}, o as (select * from ds where id <> query_id), t as ({_TOP.format('o', 10)}), g as (select label, count(*) - 1 as gold from embeddings group by 1),
 h as (select t.*, gold, (t.label = qlabel)::int as hit, sum((t.label = qlabel)::int) over (partition by query_id order by rank) as seen from t join g on g.label = qlabel)
 select query_id, max(hit) as hit, round(sum(hit) / max(gold), 6) as recall, round(sum(hit) / count(*), 6) as precision, round(coalesce(max(case when hit = 1 then 1.0::double / rank end), 0), 6) as rr, round(sum(case when hit = 1 then seen::double / rank else 0 end) / max(gold), 6) as ap from h where gold > 0 group by query_id""",
    "stale_index_check": "with m as (select count(*) as missing from embeddings e where not exists (select 1 from documents where doc_id = e.vec_id)) select count(*) as total, max(missing) as missing, round(max(missing) / count(*), 6) as ratio, max(missing) >= 0.2 * count(*) as stale from embeddings, m",
    "references_by_source": f"with {_BM25}, h as ({_TOP.format('bm', 60)}), s as (select query_id, source, min(rank) as rank from h join (select distinct doc_id, source from documents) on doc_id = id group by all) select * from (select query_id, source, rank, row_number() over (partition by query_id order by rank, source) as label from s) where label <= 10",
}
