"""Queries on evidence: gates over retrieved documents, merged lists, terms, registries and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.operators import evidence as E
from stillhouse.sources.files import upsert_sources
from stillhouse.sources.tables import table


def _judged(spark, d):
    """Questions with the documents whose chunks they rest on as the prediction, and their reviewed scores."""
    q = table(spark, d, "qa_benchmark")
    score = lambda k: F.col("question_quality")[k].try_cast("double").alias(k)
    rows = q.select("id", F.col("benchmark_mode").alias("mode"), "source", "question_type", F.col("gold_doc_ids").alias("gold"), F.map_keys("source_chunk_ids").alias("predicted"), F.lit(None).cast("array<array<string>>").alias("groups"), score("clarity"), score("risk"))
    return E.evidence_gate(rows)


_JUDGED = """cl as (select id, benchmark_mode as mode, source, question_type, list_distinct(list_filter(list_transform(coalesce(gold_doc_ids, []), lambda x: trim(x)), lambda x: x is not null and x <> '')) as g, list_filter(list_transform(coalesce(map_keys(source_chunk_ids), []), lambda x: trim(x)), lambda x: x is not null and x <> '') as p,
 try_cast(question_quality['clarity'] as double) as clarity, try_cast(question_quality['risk'] as double) as risk from qa_benchmark), hc as (select *, len(g) as n, len(list_intersect(g, p)) as hit from cl),
 jd as (select *, n > 0 as applied, n = 0 or case when coalesce(mode = 'two_doc', false) then hit = n else hit > 0 end as strict_pass, n = 0 or case when coalesce(mode = 'two_doc', false) then hit * 2 >= n else hit = n end as soft_pass, case when n = 0 then 1 else hit::double / n end as coverage from hc)"""


def evidence_gate(spark, d):
    """Gate of each question, and its clarity as far as the evidence covers it."""
    g = _judged(spark, d)
    return g.select("id", "applied", "strict_pass", "soft_pass", F.round("coverage", 6).alias("coverage"), "groups_total", "groups_hit", F.round(F.coalesce("clarity", F.lit(0.0)) * F.col("coverage"), 6).alias("gated_clarity"))


def evaluation_wide(spark, d):
    """One row per mode with all measures of the gate and the reviewed scores side by side."""
    g = _judged(spark, d)
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    gated = F.coalesce("clarity", F.lit(0.0)) * F.col("coverage")
    return g.groupBy("mode").agg(
        F.count("*").alias("n"), F.count_if("applied").alias("applied"), share(F.col("strict_pass"), "strict_rate"), share(F.col("soft_pass"), "soft_rate"), share(F.col("coverage"), "coverage"), share(F.col("clarity"), "clarity"), share(F.col("risk"), "risk"),
        share(gated, "gated_clarity"), F.count("clarity").alias("scored"), F.count_if(F.col("clarity").isNull()).alias("unscored"), F.round(F.min("clarity"), 6).alias("least_clarity"), F.round(F.max("risk"), 6).alias("most_risk"),
        F.count_if((F.col("clarity") >= 0.6) & F.col("soft_pass")).alias("passed"),
    )


def rejudge_summary(spark, d):
    """By source, mode and question type: scored rows, rows without a score, and the share that passes a threshold set anew."""
    g = _judged(spark, d)
    ok = F.coalesce(F.col("clarity"), F.lit(0.0)) >= 0.7
    return g.groupBy("source", "mode", "question_type").agg(F.count("*").alias("n"), F.count_if(F.col("clarity").isNull()).alias("errors"), F.count_if(ok).alias("passed"), F.round(F.avg("clarity"), 6).alias("clarity"), F.count_if(ok & F.col("soft_pass")).alias("gated"))


def _ranked_chunks(spark, d):
    c = table(spark, d, "document_chunks").filter("chunk_id is not null").select("chunk_id", F.col("metadata.source_group").alias("source_group"), F.col("metadata.confidence").cast("double").alias("score"), F.col("metadata.evidence_type").alias("evidence_type"))
    return c.groupBy("chunk_id").agg(F.max(F.struct("score", "source_group", "evidence_type")).alias("x")).select("chunk_id", "x.*").withColumn("source_group", F.coalesce("source_group", F.lit("")))


_CHUNK = "cr as (select chunk_id, metadata.source_group as source_group, metadata.confidence::double as score, metadata.evidence_type as evidence_type from document_chunks where chunk_id is not null), ck as (select chunk_id, score, coalesce(source_group, '') as source_group, evidence_type from (select *, row_number() over (partition by chunk_id order by score desc nulls last, source_group desc nulls last, evidence_type desc nulls last) as r from cr) where r = 1)"


def anchors_first(spark, d):
    """Chunks of each group with the evidence type 'measurement' first, then those of every type, twenty a group."""
    c = _ranked_chunks(spark, d)
    return E.merge_first([c.filter("evidence_type = 'measurement'"), c], ["source_group"], "chunk_id", 20).select("source_group", "chunk_id", F.round("score", 6).alias("score"), "origin", "rank")


def accumulated_evidence(spark, d):
    """Chunks of sure evidence first, then earlier ones of middling and low confidence, all kept, with their place."""
    c = _ranked_chunks(spark, d)
    parts = [c.filter("score >= 0.7"), c.filter("score >= 0.4"), c]
    return E.merge_first(parts, ["source_group"], "chunk_id").select("source_group", "chunk_id", "origin", "rank")


def annotated_chunks(spark, d):
    """Chunks that a benchmark question rests on, with annotations of the selection where set and else of the chunk table."""
    q = table(spark, d, "qa_benchmark").select(F.explode("source_chunk_ids").alias("doc", "chunks"), F.col("question_type").alias("label")).select(F.explode("chunks").alias("chunk_id"), "label", F.col("doc").alias("title")).filter("chunk_id is not null")
    chosen = q.groupBy("chunk_id").agg(F.min("label").alias("label"), F.min("title").alias("title"))
    c = table(spark, d, "document_chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.min("metadata.evidence_type").alias("label"), F.min("metadata.title").alias("title"))
    return E.merge_annotations(chosen, c, "chunk_id").groupBy("selected", "label").agg(F.count("*").alias("n"), F.count("title").alias("titled"))


def term_windows(spark, d):
    """Terms of one to three words in the chunks' whole texts, those that say nothing left out, that stand in three chunks or more."""
    c = table(spark, d, "document_chunks").select("chunk_id", "text").distinct()
    t = c.select("chunk_id", F.explode(F.array_distinct(E.term_windows(F.col("text"), 1, 3))).alias("term")).filter(~E.bad_term(F.col("term")))
    return t.groupBy("term").agg(F.count("*").alias("chunks")).filter("chunks >= 3")


def top_terms(spark, d):
    """The ten most used terms of one word in each document's whole text, more uses first, then by name."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    t = table(spark, d, "documents").select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("uses")).filter(~E.bad_term(F.col("term")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("uses"), "term")
    return t.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("doc_id", "rank", "term", "uses")


def sources_upserted(spark, d):
    """The files of the page table as a registry, updated by those of the chunk table: what is stated anew wins, what is missing stays."""
    old = table(spark, d, "loaded_documents").groupBy(F.col("file_name").alias("path")).agg(F.min("source").alias("name"), F.min("title").alias("hint"))
    new = table(spark, d, "document_chunks").groupBy(F.col("metadata.file_name").alias("path")).agg(F.min("metadata.source").alias("name"), F.min("metadata.title").alias("hint"))
    return upsert_sources(old, new).groupBy("name", "change").agg(F.count("*").alias("files"), F.count("hint").alias("titled"))


def merged_features(spark, d):
    """Features of each sample over all its profiles, later profiles winning: their number and sum."""
    x = table(spark, d, "sample_profiles").filter("sample_id is not null").select("sample_id", F.col("updated_at").cast("timestamp").alias("at"), "profile_id", F.explode("features").alias("k", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    last = x.groupBy("sample_id", F.regexp_replace(F.lower(F.trim("k")), " ", "_").alias("feature")).agg(F.max(F.struct("at", "profile_id", "v"))["v"].alias("v"))
    return last.groupBy("sample_id").agg(F.count("*").alias("features"), F.round(F.sum("v"), 4).alias("total"))


def nested_numbers(spark, d):
    """Numbers inside the JSON objects of measured values, by key: how many there are and their mean size in decades."""
    o = table(spark, d, "property_observations").filter(F.ltrim("value_json").startswith("{")).select(F.explode(F.from_json("value_json", "map<string,string>")).alias("key", "v"))
    n = o.withColumn("n", F.col("v").try_cast("double"))
    return n.groupBy("key").agg(F.count("*").alias("fields"), F.count("n").alias("numbers"), F.round(F.avg(F.when(F.col("n") > 0, F.log10("n"))), 5).alias("decades"))


def sample_document(spark, d):
    """One sample by its id (the smallest there is): what its table and its observations tell of it."""
    s = table(spark, d, "samples").filter("sample_id is not null")
    one = s.agg(F.min("sample_id").alias("sample_id"))
    o = table(spark, d, "property_observations").join(F.broadcast(one), "sample_id", "left_semi")
    facts = o.agg(F.count("*").alias("observations"), F.countDistinct("property_name").alias("names"), F.min("created_at").alias("since"))
    return s.join(F.broadcast(one), "sample_id", "left_semi").groupBy("sample_id").agg(F.count("*").alias("versions")).crossJoin(facts)  # one row each


QUERIES = {f.__name__: f for f in (evidence_gate, evaluation_wide, rejudge_summary, anchors_first, accumulated_evidence, annotated_chunks, term_windows, top_terms, sources_upserted, merged_features, nested_numbers, sample_document)}

_STOPS = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_BAD = "(len(list_intersect(string_split({0}, ' '), [" + _STOPS + "])) > 0 or not contains({0}, ' ') and (length({0}) < 3 or " + " or ".join(f"ends_with({{0}}, '{e}')" for e in E.WEAK_ENDINGS) + ") or regexp_full_match({0}, '[0-9]+'))"
_MERGE = "lateral_m as (select source_group, chunk_id, min(origin) as origin, max(score) as score from ({0}) group by 1, 2), rk as (select *, row_number() over (partition by source_group order by origin, score desc nulls last, chunk_id) as rank from lateral_m)"
SQL = {
    "evidence_gate": f"with {_JUDGED} select id, applied, strict_pass, soft_pass, round(coverage, 6) as coverage, n as groups_total, hit as groups_hit, round(coalesce(clarity, 0) * coverage, 6) as gated_clarity from jd",
    "evaluation_wide": f"with {_JUDGED} select mode, count(*) as n, count(*) filter (where applied) as applied, round(avg(strict_pass::int::double), 6) as strict_rate, round(avg(soft_pass::int::double), 6) as soft_rate, round(avg(coverage), 6) as coverage, round(avg(clarity), 6) as clarity, round(avg(risk), 6) as risk, round(avg(coalesce(clarity, 0) * coverage), 6) as gated_clarity, count(clarity) as scored, count(*) filter (where clarity is null) as unscored, round(min(clarity), 6) as least_clarity, round(max(risk), 6) as most_risk, count(*) filter (where clarity >= 0.6 and soft_pass) as passed from jd group by 1",
    "rejudge_summary": f"with {_JUDGED} select source, mode, question_type, count(*) as n, count(*) filter (where clarity is null) as errors, count(*) filter (where coalesce(clarity, 0) >= 0.7) as passed, round(avg(clarity), 6) as clarity, count(*) filter (where coalesce(clarity, 0) >= 0.7 and soft_pass) as gated from jd group by 1, 2, 3",
    "anchors_first": f"with {_CHUNK}, " + _MERGE.format("select *, 0 as origin from ck where evidence_type = 'measurement' union all select *, 1 from ck") + " select source_group, chunk_id, round(score, 6) as score, origin, rank from rk where rank <= 20",
    "accumulated_evidence": f"with {_CHUNK}, " + _MERGE.format("select *, 0 as origin from ck where score >= 0.7 union all select *, 1 from ck where score >= 0.4 union all select *, 2 from ck") + " select source_group, chunk_id, origin, rank from rk",
    "annotated_chunks": "with e as (select question_type as label, unnest(map_entries(source_chunk_ids)) as x from qa_benchmark), u as (select label, x.key as title, unnest(x.value) as chunk_id from e), s as (select chunk_id, min(label) as label, min(title) as title from u where chunk_id is not null group by 1), c as (select chunk_id, min(metadata.evidence_type) as label, min(metadata.title) as title from document_chunks where chunk_id is not null group by 1) select s.chunk_id is not null as selected, coalesce(s.label, c.label) as label, count(*) as n, count(coalesce(s.title, c.title)) as titled from s full join c on s.chunk_id = c.chunk_id group by 1, 2",
    "term_windows": "with w as (select chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from (select distinct chunk_id, text from document_chunks)), t as (" + " union ".join(f"select chunk_id, w, array_to_string(w[i:i + {k - 1}], ' ') as term from (select chunk_id, w, unnest(generate_series(1, len(w) - {k - 1})) as i from w)" for k in (1, 2, 3)) + f") select term, count(*) as chunks from (select distinct chunk_id, w, term from t) where not {_BAD.format('term')} group by 1 having count(*) >= 3",
    "top_terms": f"with t as (select doc_id, term, count(*) as uses from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as term from documents) group by 1, 2) select doc_id, rank, term, uses from (select *, row_number() over (partition by doc_id order by uses desc, term) as rank from t where not {_BAD.format('term')}) where rank <= 10",
    "sources_upserted": "with o as (select regexp_replace(lower(trim(file_name)), '[/\\\\]+', '/', 'g') as path, min(source) as name, min(title) as hint from loaded_documents where file_name is not null group by 1), n as (select regexp_replace(lower(trim(metadata.file_name)), '[/\\\\]+', '/', 'g') as path, min(metadata.source) as name, min(metadata.title) as hint from document_chunks where metadata.file_name is not null group by 1) select coalesce(n.name, o.name) as name, case when o.path is null then 'added' when n.path is null then 'kept' else 'updated' end as change, count(*) as files, count(coalesce(n.hint, o.hint)) as titled from o full join n on o.path = n.path group by 1, 2",
    "merged_features": "with x as (select sample_id, updated_at, profile_id, unnest(map_entries(features)) as e from sample_profiles where sample_id is not null), l as (select sample_id, replace(lower(trim(e.key)), ' ', '_') as f, e.value as v, row_number() over (partition by sample_id, replace(lower(trim(e.key)), ' ', '_') order by updated_at desc nulls last, profile_id desc, e.value desc) as r from x where e.value is not null and not isnan(e.value)) select sample_id, count(*) as features, round(sum(v), 4) as total from l where r = 1 group by 1",
    "nested_numbers": "with o as (select value_json as v from property_observations where starts_with(ltrim(value_json), '{') and json_valid(value_json)), e as (select key, value from o, json_each(o.v::json)), t as (select key, json_extract_string(value, '$') as v from e) select key, count(*) as fields, count(try_cast(v as double)) as numbers, round(avg(case when try_cast(v as double) > 0 then log10(try_cast(v as double)) end), 5) as decades from t group by 1",
    "sample_document": "with i as (select min(sample_id) as k from samples), o as (select count(*) as observations, count(distinct property_name) as names, min(created_at) as since from property_observations, i where sample_id = k) select k as sample_id, (select count(*) from samples where sample_id = k) as versions, observations, names, since from i, o",
}
