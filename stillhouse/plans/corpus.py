"""Queries over documents, chunks and questions: quality, labels, duplicates, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.functions.text import approx_tokens, doc_key, normalize_text, word_count
from stillhouse.operators import corpus as C
from stillhouse.operators.retrieval import char_chunks
from stillhouse.operators.evidence import paragraph_chunks as split_paragraphs
from stillhouse.sources.tables import table

_SP = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _n(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}', ' ', 'g'))"


def _wc(x: str) -> str:
    return f"(case when {_n(x)} = '' then 0 else len(string_split({_n(x)}, ' ')) end)"


def _alpha(x: str) -> str:
    return rf"(case when length({x}) = 0 then 0 else length(regexp_replace({x}, '\P{{L}}', '', 'g'))::double / length({x}) end)"


_TABLE, _ACK, _REF = C.TABLE_FORM, C.ACKNOWLEDGEMENT, C.REFERENCE_SECTION


def _chunks(spark, d):
    """Chunks, each id once."""
    m = F.col("metadata")
    rows = table(spark, d, "document_chunks").select("chunk_id", "text", m["section"].alias("section"), m["file_name"].alias("file_name"), m["source"].alias("source"), m["title"].alias("title"), m["doi"].alias("doi"), m["year"].alias("year"), m["chunk_id"].alias("chunk_no"), m["entity_tags"].alias("entity_tags"), m["method_tags"].alias("method_tags"))
    return C.keep_latest(rows, ["chunk_id"], F.col("text"))


_CH = "ch as (select * exclude n from (select chunk_id, text, metadata.section as section, metadata.file_name as file_name, metadata.source as source, metadata.title as title, metadata.doi as doi, metadata.year as year, metadata.chunk_id as chunk_no, metadata.entity_tags as entity_tags, metadata.method_tags as method_tags, row_number() over (partition by chunk_id order by text) as n from document_chunks) where n = 1)"


def text_statistics(spark, d):
    docs = table(spark, d, "documents")
    t = F.coalesce("text", F.lit(""))
    m = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.length(t).alias("c"), word_count(t).alias("w"), approx_tokens(t).alias("k"))
    m = m.select("source", F.expr("stack(3, 'chars', c, 'words', w, 'tokens', k) as (metric, value)"))
    ranks = C.nearest_rank(m, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["source", "metric"])
    a = m.groupBy("source", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))
    return a.join(ranks, ["source", "metric"])


_STATS = f"""with m as (select coalesce(source, '') as source, unnest(['chars', 'words', 'tokens']) as metric, unnest([length(coalesce(text, '')), {_wc("coalesce(text, '')")}, greatest(1, round_even(length(coalesce(text, '')) / 4.0::double, 0)::int)]) as value from documents),
 r as (select *, row_number() over (partition by source, metric order by value) - 1 as i, count(*) over (partition by source, metric) as n from m)
 select source, metric, max(n) as n, min(value) as low, max(value) as high, round(avg(value), 4) as mean, min(case when i = round_even((n - 1) * 0.1::double, 0) then value end) as p10, min(case when i = round_even((n - 1) * 0.5::double, 0) then value end) as p50, min(case when i = round_even((n - 1) * 0.9::double, 0) then value end) as p90 from r group by all"""


def length_histogram(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    bucket = F.when(n < 200, "<200").when(n < 500, "200-499").when(n < 1000, "500-999").when(n < 1500, "1000-1499").otherwise("1500+")
    return table(spark, d, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def clean_drop_reasons(spark, d):
    return _chunks(spark, d).select("chunk_id", F.coalesce(C.drop_reason(F.col("text"), F.col("section")), F.lit("keep")).alias("reason"))


_T = "coalesce(text, '')"
_TABFRAG = rf"({_n(_T)} = '' or regexp_matches({_n(_T)}, '^[\W\d_]+$') or length({_n(_T)}) - length(replace({_n(_T)}, '|', '')) >= 2 or (regexp_matches({_n(_T)}, '{_TABLE}') and {_wc(_T)} <= 14))"
_REFACK = rf"(regexp_matches(trim(coalesce(section, '')), '{_REF}') or regexp_matches(trim(coalesce(section, '')), '{_ACK}') or regexp_matches(substr({_T}, 1, 240), '{_ACK}'))"
_REASON = f"case when {_wc(_T)} < 40 and {_TABFRAG} then 'short_table_fragment' when {_wc(_T)} < 40 then 'too_short' when {_REFACK} then 'reference_or_ack' when {_alpha(_T)} < 0.55 then 'low_alpha_ratio' when {_TABFRAG} and {_wc(_T)} < 80 then 'table_fragment' end"
_BUCKET = f"case when {_wc(_T)} < 40 and regexp_matches({_n(_T)}, '{_TABLE}') then 'short_table_fragment' when {_wc(_T)} < 40 then 'short_fragment' when {_REFACK} then 'reference_or_ack' when {_alpha(_T)} < 0.55 then 'low_alpha_ratio' when {_wc(_T)} >= 450 then 'very_long' when {_wc(_T)} >= 300 then 'long' else 'normal' end"


def drop_reason_counts(spark, d):
    """Window texts of the documents with what the cleaning filter does to them."""
    c = char_chunks(table(spark, d, "documents"), 400, 50).withColumns({"reason": F.coalesce(C.drop_reason(F.col("chunk_text"), F.lit(None).cast("string")), F.lit("keep")), "w": word_count(F.col("chunk_text"))})
    return c.groupBy("reason").agg(F.count("*").alias("n"), F.min("w").alias("min_words"), F.max("w").alias("max_words"))


def quality_buckets(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("text"), F.lit(None).cast("string").alias("section"))
    return docs.groupBy("source", C.quality_bucket(F.col("text"), F.col("section")).alias("bucket")).agg(F.count("*").alias("n"))


def quality_examples(spark, d):
    """The first three documents of each bucket."""
    b = table(spark, d, "documents").select("doc_id", C.quality_bucket(F.col("text"), F.lit(None).cast("string")).alias("bucket"), word_count(F.col("text")).alias("words"))
    return b.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))).filter("r <= 3")


# An English default for the label lexicons, which are parameters.
ENTITIES = {"asphaltenes": ["asphaltene"], "resins": ["resin"], "aromatics": ["aromatic", "arene"], "paraffins": ["paraffin", "alkane"], "sulfur compounds": ["thiophene", "sulfide"], "nitrogen compounds": ["pyridine", "quinoline", "carbazole"], "porphyrins": ["porphyrin"], "steranes": ["sterane", "hopane"]}
METHODS = {"GC": ["gas chromatography", "gc-fid"], "SimDis": ["simdis", "simulated distillation"], "FT-ICR MS": ["ft-icr", "ultrahigh-resolution mass"], "NMR": ["nmr", "nuclear magnetic"], "SARA": ["sara"], "HTGC": ["htgc"], "API": ["api"], "DBE": ["dbe"]}
GROUPS = [("journal", "journal"), ("thesis", "thesis"), ("report", "report"), ("memo", "memo"), ("notes", "notes")]
TASKS = [("distill", "separation"), ("chromatograph", "separation"), ("spectr", "spectroscopy"), ("viscos", "property"), ("density", "property")]
EVIDENCE = [("measured", "experimental"), ("held", "experimental"), ("reports", "reported"), ("because", "mechanism")]


def lexicon_tags(spark, d):
    t = C.lexicon_tags(table(spark, d, "documents"), "doc_id", "text", ENTITIES)
    return t.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ";").alias("tags"))


def _like(text, words):
    return "(" + " or ".join(f"contains(lower({text}), '{w.lower()}')" for w in words) + ")"


def _tags_sql(text, lexicon):
    return "list_filter([" + ", ".join(f"case when {_like(text, w)} then '{t}' end" for t, w in lexicon.items()) + "], lambda x: x is not null)"


def _first_sql(text, hints, default):
    return "case " + " ".join(f"when contains(lower({text}), '{h}') then '{v}'" for h, v in hints) + f" else '{default}' end"


def rule_labels(spark, d):
    """Group, task, evidence type and confidence of each document by rules."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    hits = lambda lex: F.size(F.filter(F.array(*[F.greatest(*[F.lower(text).contains(w.lower()) for w in ws], F.lit(False)) for ws in lex.values()]), lambda x: x))
    g, t, e = C.first_label(F.coalesce("source", F.lit("")), GROUPS, "other"), C.first_label(text, TASKS, "general"), C.first_label(text, EVIDENCE, "statement")
    score = 0.2 + F.when(g != "other", 0.2).otherwise(0.0) + F.when(t != "general", 0.2).otherwise(0.0) + F.least(F.lit(0.2), 0.05 * hits(ENTITIES)) + F.least(F.lit(0.1), 0.05 * hits(METHODS)) + F.when(e != "statement", 0.1).otherwise(0.0)
    return docs.select("doc_id", g.alias("source_group"), t.alias("task_group"), e.alias("evidence_type"), F.round(F.least(score, F.lit(0.95)), 2).alias("confidence"))


_LAB_G, _LAB_T, _LAB_E = _first_sql("coalesce(source, '')", GROUPS, "other"), _first_sql(_T, TASKS, "general"), _first_sql(_T, EVIDENCE, "statement")


def excluded_documents(spark, d):
    """Documents that stay when those with one of the phrases in title or source are taken out, by type."""
    phrases = ["salts", "survey_import", "porphyrins"]
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit(""))))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return table(spark, d, "documents").groupBy("doc_type", out.alias("excluded")).agg(F.count("*").alias("n"))


def content_hash_duplicates(spark, d):
    """Documents whose bytes stood under a smaller id before, with that id."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(first, "sha").filter("doc_id <> first_id").select("doc_id", "first_id", "copies", "sha")


def language_gate(spark, d):
    """English rows whose question has no Chinese character and whose answer has at most one in a hundred."""
    q, a = F.coalesce("question", F.lit("")), F.regexp_replace(F.coalesce("answer_key", F.lit("")), _SP, "")
    cjk = F.length(F.regexp_replace(a, r"[^\x{4e00}-\x{9fff}]", ""))
    ratio = F.when(F.length(a) == 0, 0.0).otherwise(cjk / F.length(a))
    ok = ~q.rlike(r"[\x{4e00}-\x{9fff}]") & (ratio <= 0.01)
    return table(spark, d, "qa_benchmark").filter("language = 'en'").select("id", ok.alias("passes"), F.round(ratio, 6).alias("ratio"))


# Markers of questions that only make sense beside their paper.
VAGUE = [
    "according to the paper", "according to the study", "according to the studies", "according to the article", "according to both papers", "according to the two papers", "according to the two studies", "according to the two approaches",
    "based on the provided evidence", "based on provided evidence", "based on the paper", "based on the study", "based on the article", "based on paper a", "based on paper b", "in the paper", "in the study", "in the studies", "in this paper", "in this study", "paper a", "paper b", "provided evidence",
    "the two papers", "these two papers", "both papers", "the two studies", "these two studies", "both studies", "the two approaches", "these two approaches", "both approaches", "the two methods", "these two methods", "both methods", "the two works", "these two works", "both works", "two articles", "both articles",
    "energy & fuels study", "organic geochemistry paper", "the authors", "this work",
]
_WRITING, _YEARS = r"(?:papers?|stud(?:y|ies)|articles?)", r"(?:19|20)[0-9]{2}"
#: Ways to begin with a paper, to name one by its year, and to speak of two of them.
VAGUE_FORMS = [
    rf"^\s*(?:according to|based on|in)\s+(?:the\s+)?[a-z0-9\-\s/&]+\b{_WRITING}\b", rf"\b{_YEARS}\s+(?:[a-z][a-z&\-\s]{{2,80}}\s+)?{_WRITING}\b", rf"\b(?:paper|study|article)\s+(?:from|in)\s+{_YEARS}\b",
    r"\b(?:the|these|both)\s+two\s+(?:papers|studies|articles|approaches|methods|works)\b", r"\bpaper\s+[ab]\b",
]
_VAGUE = "|".join([*VAGUE, *VAGUE_FORMS])


def vague_reference_gate(spark, d):
    q = F.lower(F.coalesce("question", F.lit("")))
    vague = q.rlike(_VAGUE)
    return table(spark, d, "qa_benchmark").groupBy("benchmark_mode", (F.trim(q) != "").alias("asked"), vague.alias("vague")).agg(F.count("*").alias("n"))


def document_keys(spark, d):
    c = _chunks(spark, d)
    key = doc_key(F.col("doi"), F.col("title"), F.col("year"), F.col("file_name"), F.col("source"))
    return c.groupBy(key.alias("doc_key")).agg(F.count("*").alias("chunks"), F.countDistinct("file_name").alias("files"))


def document_texts(spark, d):
    """Chunks of a file joined in order, as a hash with their number and length."""
    c = _chunks(spark, d).filter("file_name is not null")
    g = c.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_no", F.lit(-1)).alias("k"), "chunk_id", normalize_text(F.col("text")).alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: v["t"]), " ")
    return g.select("file_name", F.size("x").alias("chunks"), F.length(text).alias("chars"), F.md5(text).alias("digest"))


def suffix_counts(spark, d):
    s = F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, d, "loaded_documents").groupBy("source", s.alias("suffix")).agg(F.count("*").alias("pages"), F.countDistinct("file_name").alias("files"))


def year_mentions(spark, d):
    y = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?:^|[^0-9A-Za-z])(19[0-9]{2}|20[0-9]{2})(?:[^0-9A-Za-z]|$)", 1)
    return table(spark, d, "documents").filter(y != "").groupBy(y.cast("int").alias("year")).agg(F.count("*").alias("documents"))


_YEAR = r"(?:^|[^0-9A-Za-z])(19[0-9]{2}|20[0-9]{2})(?:[^0-9A-Za-z]|$)"


def year_mentions_all(spark, d):
    """Documents per year named anywhere in the text; neighbouring years may share the sign between them."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "([^0-9A-Za-z])", "$1$1")
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(_YEAR), F.lit(1)))
    return table(spark, d, "documents").select(F.explode(years.cast("array<int>")).alias("year")).groupBy("year").agg(F.count("*").alias("documents"))


def question_signatures(spark, d):
    """Questions that read the same in lower case with single blanks, after the first of them."""
    q = table(spark, d, "qa_benchmark").select("id", F.lower(normalize_text(F.coalesce("question", F.lit("")))).alias("sig"))
    first = q.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return q.join(first, "sig").filter("id <> first_id").select("id", "first_id", "n")


def eligible_documents(spark, d):
    """Documents with three chunks or more of at least 300 characters."""
    c = char_chunks(table(spark, d, "documents"))
    g = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.length("chunk_text") >= 300).alias("long_chunks"))
    return g.filter("long_chunks >= 3")


def sentence_chunks(spark, d):
    c = C.sentence_chunks(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_no", F.size(F.split("chunk_text", " ")).alias("words"), F.md5("chunk_text").alias("digest"))


def paragraph_chunks(spark, d):
    """Paragraphs merged while they fit 800 characters; longer ones cut into pieces of 800 and a rest."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(split_paragraphs(F.col("text"))).alias("chunk_no", "t"))
    return c.select("doc_id", "chunk_no", F.length("t").alias("chars"), F.md5("t").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        text_statistics, length_histogram, clean_drop_reasons, drop_reason_counts, quality_buckets, quality_examples, lexicon_tags, rule_labels, excluded_documents,
        content_hash_duplicates, language_gate, vague_reference_gate, document_keys, document_texts, suffix_counts, year_mentions, year_mentions_all, question_signatures, eligible_documents, sentence_chunks, paragraph_chunks,
    )
}
_W400 = f"""c as (select doc_id, trim(substr(t, k * 350 + 1, 400)) as text, null::varchar as section from (select doc_id, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 400) / 350.0))::int)) as k from (select doc_id, {_n('text')} as t from documents) where t <> '') where trim(substr(t, k * 350 + 1, 400)) <> '')"""
SQL = {
    "text_statistics": _STATS,
    "length_histogram": "select case when n < 200 then '<200' when n < 500 then '200-499' when n < 1000 then '500-999' when n < 1500 then '1000-1499' else '1500+' end as bucket, count(*) as n from (select length(coalesce(text, '')) as n from documents) group by 1",
    "clean_drop_reasons": f"with {_CH} select chunk_id, coalesce({_REASON}, 'keep') as reason from ch",
    "drop_reason_counts": f"with {_W400} select coalesce({_REASON}, 'keep') as reason, count(*) as n, min({_wc('text')}) as min_words, max({_wc('text')}) as max_words from c group by 1",
    "quality_buckets": f"select source, {_BUCKET} as bucket, count(*) as n from (select *, null::varchar as section from documents) group by 1, 2",
    "quality_examples": f"select doc_id, bucket, words, r from (select *, row_number() over (partition by bucket order by doc_id) as r from (select doc_id, {_BUCKET} as bucket, {_wc('text')} as words from (select *, null::varchar as section from documents))) where r <= 3",
    "lexicon_tags": f"select doc_id as id, array_to_string(list_sort({_tags_sql('text', ENTITIES)}), ';') as tags from documents where len({_tags_sql('text', ENTITIES)}) > 0",
    "rule_labels": f"""select doc_id, g as source_group, t as task_group, e as evidence_type, round(least(0.2::double + case when g <> 'other' then 0.2::double else 0 end + case when t <> 'general' then 0.2::double else 0 end + least(0.2::double, 0.05::double * ne) + least(0.1::double, 0.05::double * nm) + case when e <> 'statement' then 0.1::double else 0 end, 0.95::double), 2) as confidence
 from (select doc_id, {_LAB_G} as g, {_LAB_T} as t, {_LAB_E} as e, len({_tags_sql(_T, ENTITIES)}) as ne, len({_tags_sql(_T, METHODS)}) as nm from documents)""",
    "excluded_documents": "select doc_type, x as excluded, count(*) as n from (select doc_type, regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(source, '')), 'salts|survey_import|porphyrins') as x from documents) group by 1, 2",
    "content_hash_duplicates": "with r as (select doc_id, sha256(text) as sha from documents where text is not null), f as (select sha, min(doc_id) as first_id, count(*) as copies from r group by 1 having count(*) > 1) select doc_id, first_id, copies, sha from r join f using (sha) where doc_id <> first_id",
    "language_gate": rf"select id, not regexp_matches(q, '[\x{{4e00}}-\x{{9fff}}]') and ratio <= 0.01 as passes, round(ratio, 6) as ratio from (select id, coalesce(question, '') as q, case when length(a) = 0 then 0 else length(regexp_replace(a, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))::double / length(a) end as ratio from (select *, regexp_replace(coalesce(answer_key, ''), '{_SP}', '', 'g') as a from qa_benchmark where language = 'en'))",
    "vague_reference_gate": f"select benchmark_mode, trim(lower(coalesce(question, ''))) <> '' as asked, regexp_matches(lower(coalesce(question, '')), '{_VAGUE}') as vague, count(*) as n from qa_benchmark group by 1, 2, 3",
    "document_keys": f"with {_CH} select case when trim(coalesce(doi, '')) <> '' then 'doi:' || trim(doi) when trim(coalesce(title, '')) <> '' then 'title:' || trim(title) || '::' || coalesce(year::varchar, '') else 'file:' || coalesce(file_name, '') || '::' || coalesce(source, '') end as doc_key, count(*) as chunks, count(distinct file_name) as files from ch group by 1",
    "document_texts": f"with {_CH}, g as (select file_name, count(*) as chunks, string_agg({_n('text')}, ' ' order by coalesce(chunk_no, -1), chunk_id) as t from ch where file_name is not null group by 1) select file_name, chunks, length(t) as chars, md5(t) as digest from g",
    "suffix_counts": r"select source, lower(regexp_extract(file_name, '\.([A-Za-z0-9]+)$', 1)) as suffix, count(*) as pages, count(distinct file_name) as files from loaded_documents group by 1, 2",
    "year_mentions": r"select y::int as year, count(*) as documents from (select regexp_extract(coalesce(text, ''), '(?:^|[^0-9A-Za-z])(19[0-9]{2}|20[0-9]{2})(?:[^0-9A-Za-z]|$)', 1) as y from documents) where y <> '' group by 1",
    "year_mentions_all": r"select y::int as year, count(*) as documents from (select unnest(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '([^0-9A-Za-z])', '\1\1', 'g'), '(?:^|[^0-9A-Za-z])(19[0-9]{2}|20[0-9]{2})(?:[^0-9A-Za-z]|$)', 1))) as y from documents) group by 1",
    "question_signatures": f"with q as (select id, lower({_n("coalesce(question, '')")}) as sig from qa_benchmark), f as (select sig, min(id) as first_id, count(*) as n from q group by 1) select id, first_id, n from q join f using (sig) where id <> first_id",
    "eligible_documents": f"""with c as (select doc_id, trim(substr(t, k * 700 + 1, 800)) as x from (select doc_id, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 800) / 700.0))::int)) as k from (select doc_id, {_n('text')} as t from documents) where t <> '')) select doc_id, count(*) as chunks, count(*) filter (where length(x) >= 300) as long_chunks from c where x <> '' group by 1 having count(*) filter (where length(x) >= 300) >= 3""",
}
