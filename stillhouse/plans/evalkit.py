"""Queries of the evaluation kit: coverage, gates, grouped summaries, repeatability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.sources.tables import table


def _quality(spark, d):
    q = table(spark, d, "qa_benchmark")
    return q.select("id", "benchmark_mode", "question_type", "source", "language", *[F.col("question_quality")[k].try_cast("double").alias(k) for k in ("clarity", "risk")])


_QQ = "qq as (select id, benchmark_mode, question_type, source, language, try_cast(question_quality['clarity'] as double) as clarity, try_cast(question_quality['risk'] as double) as risk from qa_benchmark)"


def quality_summary_sets(spark, d):
    """Means and passes by mode, by mode and type, and over all."""
    q = _quality(spark, d)
    q.createOrReplaceTempView("_stillhouse_quality")
    return spark.sql("""select benchmark_mode, question_type, count(*) as n, round(avg(clarity), 6) as clarity, round(avg(risk), 6) as risk, count_if(clarity >= 0.7 and risk <= 0.3) as passed
        from _stillhouse_quality group by grouping sets ((), (benchmark_mode), (benchmark_mode, question_type))""")


def quality_by_mode_wide(spark, d):
    """One row per question type with a mean per mode."""
    modes = ["single_doc", "two_doc", "multi_doc"]
    g = _quality(spark, d).groupBy("question_type").pivot("benchmark_mode", modes).agg(F.round(F.avg("clarity"), 6))
    return g.select("question_type", *[F.col(m).alias(f"clarity_{m}") for m in modes])


def reviewed_score_gate(spark, d):
    """Rows by whether they reach all thresholds, a missing score failing."""
    ok = (F.coalesce("clarity", F.lit(0.0)) >= 0.6) & (F.coalesce("risk", F.lit(1.0)) <= 0.4)
    return _quality(spark, d).groupBy("source", ok.alias("passes")).agg(F.count("*").alias("n"))


def capped_quality(spark, d):
    """min(clarity, 1 - risk), clamped to [0, 1]."""
    c, r = F.coalesce("clarity", F.lit(0.0)), F.coalesce("risk", F.lit(1.0))
    return _quality(spark, d).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c, 1.0 - r)), 6).alias("score"))


def gold_coverage(spark, d):
    """How many of a question's gold documents have source chunks, and whether all do."""
    q = table(spark, d, "qa_benchmark")
    gold, have = F.array_distinct(F.coalesce("gold_doc_ids", F.array().cast("array<string>"))), F.coalesce(F.map_keys("source_chunk_ids"), F.array().cast("array<string>"))
    n, hit = F.size(gold), F.size(F.array_intersect(gold, have))
    return q.select("id", n.alias("gold"), hit.alias("covered"), F.when(n == 0, 1.0).otherwise(F.round(hit / n, 6)).alias("coverage"), (F.size(F.array_except(gold, have)) == 0).alias("strict"))


def chunk_references(spark, d):
    """Source chunks of questions that the chunk table has and lacks, per mode."""
    x = table(spark, d, "qa_benchmark").select("id", "benchmark_mode", F.explode("source_chunk_ids").alias("doc", "chunks")).select("id", "benchmark_mode", F.explode("chunks").alias("chunk_id")).distinct()
    known = table(spark, d, "document_chunks").select("chunk_id").distinct().withColumn("known", F.lit(1))
    return x.join(known, "chunk_id", "left").groupBy("benchmark_mode").agg(F.count("*").alias("refs"), F.count("known").alias("known"))


def repeatability_summary(spark, d):
    """Mean, sample deviation (0 for one), ends and distinct replicates of quantities per flag and year."""
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("m"), F.coalesce(F.stddev_samp(F.col("l_quantity").cast("double")), F.lit(0.0)).alias("s"), F.min("l_quantity").cast("double").alias("low"), F.max("l_quantity").cast("double").alias("high"), F.countDistinct("l_suppkey").alias("replicates"))
    return g.select("l_returnflag", "year", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), "low", "high", "replicates")


def two_level_means(spark, d):
    """Mean over suppliers of their mean discount, with the number of suppliers, per line status."""
    l = table(spark, d, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(F.avg(F.col("l_discount").cast("double")).alias("m"))
    return l.groupBy("l_linestatus").agg(F.round(F.avg("m"), 6).alias("mean"), F.countDistinct("l_suppkey").alias("suppliers"))


def latest_success(spark, d):
    """Per user and type the last event that wasn't an error."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return e.withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_type", "event_id", F.round(F.col("value").cast("double"), 6).alias("value"))


def resume_open_keys(spark, d):
    """Orders without a line that was returned: those still to be worked off, per priority."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def matched_only(spark, d):
    """Orders with a returned line, per priority."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def spread_selection(spark, d):
    """Five documents of each source spread evenly over its ids: positions round(i max(n / 5, 1)), half to even."""
    w = Window.partitionBy("source")
    r = table(spark, d, "documents").filter("source is not null").select("source", "doc_id").withColumns({"i": F.row_number().over(w.orderBy("doc_id")) - 1, "n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.bround(i * F.greatest(F.col("n") / 5.0, F.lit(1.0))).cast("int"))
    return r.filter(F.array_contains(wanted, F.col("i"))).select("source", "doc_id", "i")


def tag_first_use(spark, d):
    """Tags of a question numbered in the order of their first use over all questions of a source."""
    t = table(spark, d, "qa_benchmark").select("source", "id", F.posexplode("tags").alias("pos", "tag")).filter("tag is not null")
    first = t.groupBy("source", "tag").agg(F.min(F.struct("id", "pos")).alias("at"))
    w = Window.partitionBy("source").orderBy("at", "tag")
    return first.withColumn("number", F.row_number().over(w)).select("source", "tag", "number")


def experiment_grid(spark, d):
    """Runs of every doc type with three depths and two replicates, with the documents each covers."""
    types = table(spark, d, "documents").groupBy("doc_type").agg(F.count("*").alias("n"))
    return types.select("doc_type", "n", F.explode(F.array(*map(F.lit, (2, 4, 6)))).alias("top_k")).select("*", F.explode(F.array(*map(F.lit, (1, 2)))).alias("replicate")).withColumn("answers", F.col("n") * F.col("top_k"))


QUERIES = {
    f.__name__: f
    for f in (quality_summary_sets, quality_by_mode_wide, reviewed_score_gate, capped_quality, gold_coverage, chunk_references, repeatability_summary, two_level_means, latest_success, resume_open_keys, matched_only, spread_selection, tag_first_use, experiment_grid)
}
SQL = {
    "quality_summary_sets": f"with {_QQ} select benchmark_mode, question_type, count(*) as n, round(avg(clarity), 6) as clarity, round(avg(risk), 6) as risk, count(*) filter (where clarity >= 0.7 and risk <= 0.3) as passed from qq group by grouping sets ((), (benchmark_mode), (benchmark_mode, question_type))",
    "quality_by_mode_wide": f"with {_QQ} select question_type, " + ", ".join(f"round(avg(clarity) filter (where benchmark_mode = '{m}'), 6) as clarity_{m}" for m in ("single_doc", "two_doc", "multi_doc")) + " from qq group by 1",
    "reviewed_score_gate": f"with {_QQ} select source, coalesce(clarity, 0) >= 0.6 and coalesce(risk, 1) <= 0.4 as passes, count(*) as n from qq group by 1, 2",
    "capped_quality": f"with {_QQ} select id, round(greatest(0, least(1, coalesce(clarity, 0), 1 - coalesce(risk, 1))), 6) as score from qq",
    "gold_coverage": "with q as (select id, list_distinct(coalesce(gold_doc_ids, [])) as g, coalesce(map_keys(source_chunk_ids), []) as h from qa_benchmark) select id, len(g) as gold, len(list_intersect(g, h)) as covered, case when len(g) = 0 then 1 else round(len(list_intersect(g, h))::double / len(g), 6) end as coverage, len(list_intersect(g, h)) = len(g) as strict from q",
    "chunk_references": "with e as (select id, benchmark_mode, unnest(map_values(source_chunk_ids)) as c from qa_benchmark), x as (select distinct id, benchmark_mode, chunk_id from (select id, benchmark_mode, unnest(c) as chunk_id from e)) select benchmark_mode, count(*) as refs, count(k.chunk_id) as known from x left join (select distinct chunk_id from document_chunks) k using (chunk_id) group by 1",
    "repeatability_summary": "select l_returnflag, year(l_shipdate) as year, count(*) as n, round(avg(l_quantity::double), 6) as mean, round(coalesce(stddev_samp(l_quantity::double), 0), 6) as sd, min(l_quantity)::double as low, max(l_quantity)::double as high, count(distinct l_suppkey) as replicates from lineitem group by 1, 2",
    "two_level_means": "select l_linestatus, round(avg(m), 6) as mean, count(distinct l_suppkey) as suppliers from (select l_linestatus, l_suppkey, avg(l_discount::double) as m from lineitem group by 1, 2) group by 1",
    "latest_success": "select user_id, event_type, event_id, round(value::double, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events where event_type <> 'error') where r = 1",
    "resume_open_keys": "select o_orderpriority, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1",
    "matched_only": "select o_orderpriority, count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1",
    "spread_selection": "with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents where source is not null) select source, doc_id, i from r where i in (0, round_even(1 * greatest(n / 5.0::double, 1), 0)::int, round_even(2 * greatest(n / 5.0::double, 1), 0)::int, round_even(3 * greatest(n / 5.0::double, 1), 0)::int, round_even(4 * greatest(n / 5.0::double, 1), 0)::int)",
    "tag_first_use": "with t as (select source, id, generate_subscripts(tags, 1) as pos, unnest(tags) as tag from qa_benchmark), f as (select source, tag, min((id, pos)) as first_at from t where tag is not null group by 1, 2) select source, tag, row_number() over (partition by source order by first_at, tag) as number from f",
    "experiment_grid": "select doc_type, n, top_k, replicate, n * top_k as answers from (select doc_type, count(*) as n from documents group by 1), (values (2), (4), (6)) k(top_k), (values (1), (2)) r(replicate)",
}
