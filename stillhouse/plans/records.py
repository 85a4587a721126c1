"""Queries on record-level work: classes, dimension joins, quotas, lookups, stored results against recomputed ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.operators.knn import long_profiles
from stillhouse.plans.corpus import _CH, _chunks
from stillhouse.sources.tables import table


def signal_classes(spark, d):
    """Events per type and class: low below the first third of its values, high from the second on."""
    e = table(spark, d, "events").select("event_type", F.col("value").cast("double").alias("v"))
    cut = e.groupBy("event_type").agg(F.expr("percentile(v, array(0.33, 0.67))").alias("q"))
    c = F.when(F.col("v").isNull(), "unknown").when(F.col("v") < F.col("q")[0], "low").when(F.col("v") < F.col("q")[1], "moderate").otherwise("high")
    return e.join(cut, "event_type").groupBy("event_type", c.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def tolerance_steps(spark, d):
    """Events by the tolerance that holds at their hour of the day: a step function of four steps."""
    h = F.hour(F.col("ts").cast("timestamp"))
    t = F.when(h < 6, 0.35).when(h < 12, 0.45).when(h < 18, 0.55).otherwise(0.8)
    return table(spark, d, "events").groupBy(t.alias("tolerance")).agg(F.count("*").alias("n"))


def dimension_rollup(spark, d):
    """Quantity per part size over the whole dimension of sizes 0 to 51; sizes without lines stay with 0."""
    sizes = spark.range(0, 52).select(F.col("id").cast("int").alias("p_size"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    g = lines.groupBy("p_size").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"), F.count("*").alias("n"))
    return sizes.join(g, "p_size", "left").select("p_size", F.round(F.coalesce("q", F.lit(0.0)), 4).alias("quantity"), F.coalesce("n", F.lit(0)).cast("bigint").alias("lines"))


def _kinds(spark, d):
    """(kind, term, n): acronyms, codes and capitalised two-word phrases of the chunks with the number of chunks."""
    c = _chunks(spark, d).select("chunk_id", F.coalesce("text", F.lit("")).alias("t"))
    find = {"acronym": r"\b[A-Z]{2,6}\b", "code": r"\b[A-Z]{2}-[0-9]{4}\b", "word": r"\b[a-z]{7,}\b"}
    out = None
    for kind, pattern in find.items():
        part = c.select("chunk_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))).alias("term"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "term").agg(F.count("*").alias("n"))


_KIND = f"{_CH}, kd as (select kind, term, count(*) as n from (" + " union all ".join(rf"select chunk_id, '{k}' as kind, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{p}'))) as term from ch" for k, p in (("acronym", r"\b[A-Z]{2,6}\b"), ("code", r"\b[A-Z]{2}-[0-9]{4}\b"), ("word", r"\b[a-z]{7,}\b"))) + ") group by all)"


def term_kinds(spark, d):
    return _kinds(spark, d).groupBy("kind").agg(F.count("*").alias("terms"), F.sum("n").alias("uses"), F.max("n").alias("most"))


def quota_selection(spark, d):
    """A hundred terms by quota: 75 words, 20 acronyms, 5 codes, the most used of each."""
    quota = F.create_map(F.lit("word"), F.lit(75), F.lit("acronym"), F.lit(20), F.lit("code"), F.lit(5))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "term")
    return _kinds(spark, d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota[F.col("kind")]).select("kind", "term", "n", "rank")


def score_lookup(spark, d):
    """Profiles by whether the stored table has a useful neighbour (a known distance of at most 1); a missing one counts as none."""
    n = table(spark, d, "neighbors").groupBy(F.col("query_profile_id").alias("profile_id")).agg(F.min("distance").alias("best"))
    p = table(spark, d, "sample_profiles").select("profile_id", F.lower(F.trim(F.coalesce("split", F.lit("")))).alias("split")).join(n, "profile_id", "left")
    return p.groupBy("split").agg(F.count("*").alias("n"), F.count("best").alias("known"), F.sum(F.coalesce(F.col("best") <= 1.0, F.lit(False)).cast("int")).cast("bigint").alias("useful"))


def stored_distance_errors(spark, d):
    """Per run of the stored neighbour table: mean and largest error of its distances against recomputed ones."""
    n = table(spark, d, "neighbors").filter("distance is not null and not isnan(distance)").select("run_id", F.col("query_profile_id").alias("a"), F.col("neighbor_profile_id").alias("b"), "distance").distinct()
    x = long_profiles(table(spark, d, "sample_profiles"))
    sq = x.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    pairs = n.select("a", "b").distinct()
    dots = pairs.join(x.select(F.col("id").alias("a"), "feature", F.col("value").alias("va")), "a").join(x.select(F.col("id").alias("b"), "feature", F.col("value").alias("vb")), ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    r = n.join(dots, ["a", "b"], "left").join(sq.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sq.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    e = F.abs(F.col("distance") - F.sqrt(F.greatest(F.col("sa") + F.col("sb") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))))
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg(e), 4).alias("mean_error"), F.round(F.max(e), 4).alias("max_error"), F.sum((e > 0.001).cast("int")).cast("bigint").alias("stale"))


def mapped_values(spark, d):
    """Orders per priority class, texts mapped by a dictionary, others kept."""
    m = F.create_map(*[F.lit(x) for kv in (("1-URGENT", "now"), ("2-HIGH", "now"), ("5-LOW", "later")) for x in kv])
    return table(spark, d, "orders").groupBy(F.coalesce(m[F.col("o_orderpriority")], F.col("o_orderpriority")).alias("class")).agg(F.count("*").alias("n"))


def merged_labels(spark, d):
    """Languages of questions: the stated one, else the one most questions of the source have."""
    q = table(spark, d, "qa_benchmark")
    g = q.filter("language is not null").groupBy("source", "language").agg(F.count("*").alias("c"))
    top = g.groupBy("source").agg(F.min_by("language", F.struct((-F.col("c")).alias("m"), "language")).alias("usual"))
    return q.join(top, "source", "left").groupBy(F.coalesce("language", "usual").alias("language")).agg(F.count("*").alias("n"), F.count("language").alias("stated"))


def table_preview(spark, d):
    """The first five manifest entries of each source as text, nulls as empty, with the number there are."""
    rows = table(spark, d, "manifest")
    total = rows.groupBy(F.coalesce("source", F.lit("")).alias("key")).agg(F.count("*").alias("total"))
    # the limit is taken before the shuffle, so a source of any size passes five rows on per task
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("entry_id"))).filter("r <= 5")
    m = first.join(total, F.coalesce("source", F.lit("")) == F.col("key"))
    return m.select(F.coalesce("source", F.lit("")).alias("source"), F.col("entry_id").cast("string").alias("entry_id"), F.coalesce("sample_name", F.lit("")).alias("sample_name"), F.coalesce(F.col("has_ir").cast("string"), F.lit("")).alias("has_ir"), "total")


def except_and_intersect(spark, d):
    """Samples with observations and profiles, with only one of them, by set operations."""
    o, p = (table(spark, d, t).select(F.lower(F.trim("sample_id")).alias("k")).filter("k is not null") for t in ("property_observations", "sample_profiles"))
    parts = {"both": o.intersect(p), "observations only": o.subtract(p), "profiles only": p.subtract(o)}
    out = None
    for n, x in parts.items():
        part = x.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (signal_classes, tolerance_steps, dimension_rollup, term_kinds, quota_selection, score_lookup, stored_distance_errors, mapped_values, merged_labels, table_preview, except_and_intersect)}
SQL = {
    "signal_classes": "with e as (select event_type, value::double as v from events), c as (select event_type, quantile_cont(v, 0.33) as a, quantile_cont(v, 0.67) as b from e group by 1) select event_type, case when v is null then 'unknown' when v < a then 'low' when v < b then 'moderate' else 'high' end as class, count(*) as n, round(avg(v), 6) as mean from e join c using (event_type) group by 1, 2",
    "tolerance_steps": "select case when h < 6 then 0.35 when h < 12 then 0.45 when h < 18 then 0.55 else 0.8 end::double as tolerance, count(*) as n from (select hour(ts) as h from events) group by 1",
    "dimension_rollup": "with g as (select p_size, sum(l_quantity::double) as q, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1) select s.p_size, round(coalesce(q, 0), 4) as quantity, coalesce(n, 0) as lines from (select unnest(generate_series(0, 51))::int as p_size) s left join g on g.p_size = s.p_size",
    "term_kinds": f"with {_KIND} select kind, count(*) as terms, sum(n)::bigint as uses, max(n) as most from kd group by 1",
    "quota_selection": f"with {_KIND} select kind, term, n, rank from (select *, row_number() over (partition by kind order by n desc, term) as rank from kd) where rank <= case kind when 'word' then 75 when 'acronym' then 20 else 5 end",
    "score_lookup": "with n as (select query_profile_id as profile_id, min(distance) as best from neighbors group by 1) select lower(trim(coalesce(split, ''))) as split, count(*) as n, count(best) as known, sum(coalesce(best <= 1, false)::int)::bigint as useful from sample_profiles left join n using (profile_id) group by 1",
    "stored_distance_errors": """with n as (select distinct run_id, query_profile_id as a, neighbor_profile_id as b, distance from neighbors where distance is not null and not isnan(distance)), fl as (select profile_id as id, unnest(map_entries(features)) as e from sample_profiles), x as (select id, replace(lower(trim(e.key)), ' ', '_') as f, max(e.value) as v from fl where e.value is not null and not isnan(e.value) group by 1, 2), sq as (select id, sum(v * v) as s from x group by 1),
 dt as (select p.a, p.b, sum(i.v * j.v) as d from (select distinct a, b from n) p join x i on i.id = p.a join x j on j.id = p.b and j.f = i.f group by 1, 2), r as (select run_id, abs(distance - sqrt(greatest(s.s + t.s - 2 * coalesce(d, 0), 0))) as e from n left join dt on dt.a = n.a and dt.b = n.b join sq s on s.id = n.a join sq t on t.id = n.b) select run_id, count(*) as n, round(avg(e), 4) as mean_error, round(max(e), 4) as max_error, sum((e > 0.001)::int)::bigint as stale from r group by 1""",
    "mapped_values": "select case o_orderpriority when '1-URGENT' then 'now' when '2-HIGH' then 'now' when '5-LOW' then 'later' else o_orderpriority end as class, count(*) as n from orders group by 1",
    "merged_labels": "with g as (select source, language, count(*) as c from qa_benchmark where language is not null group by 1, 2), t as (select source, language as usual from (select *, row_number() over (partition by source order by c desc, language) as r from g) where r = 1) select coalesce(language, usual) as language, count(*) as n, count(language) as stated from qa_benchmark left join t using (source) group by 1",
    "table_preview": "select coalesce(source, '') as source, entry_id::varchar as entry_id, coalesce(sample_name, '') as sample_name, coalesce(has_ir::varchar, '') as has_ir, total from (select *, row_number() over (partition by source order by entry_id) as r, count(*) over (partition by source) as total from manifest) where r <= 5",
    "except_and_intersect": "with o as (select distinct lower(trim(sample_id)) as k from property_observations where sample_id is not null), p as (select distinct lower(trim(sample_id)) as k from sample_profiles where sample_id is not null) select 'both' as part, count(*) as n from (select k from o intersect select k from p) union all select 'observations only', count(*) from (select k from o except select k from p) union all select 'profiles only', count(*) from (select k from p except select k from o)",
}
