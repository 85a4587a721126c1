"""Queries on the sample catalog: latest versions, joins, upserts, deletions, checks, shape changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.operators.corpus import keep_latest, upsert
from stillhouse.sources.tables import stage, table


def _latest(spark, d):
    """Each sample once: the version with the latest updated_at (its first 19 characters), then the larger name."""
    stamp = F.regexp_replace(F.substring(F.coalesce("updated_at", F.lit("")), 1, 19), "T", " ")
    s = table(spark, d, "samples").filter("sample_id is not null").withColumn("stamp", stamp)
    return keep_latest(s, ["sample_id"], F.desc("stamp"), F.desc(F.coalesce("sample_name", F.lit(""))), F.desc(F.coalesce("project", F.lit(""))))


_LATEST = "ls as (select * from (select *, row_number() over (partition by sample_id order by stamp desc, coalesce(sample_name, '') desc, coalesce(project, '') desc) as n from (select *, replace(substr(coalesce(updated_at, ''), 1, 19), 'T', ' ') as stamp from samples where sample_id is not null)) where n = 1)"


def samples_latest(spark, d):
    return _latest(spark, d).select("sample_id", F.coalesce("project", F.lit("")).alias("project"), "stamp")


def sample_types(spark, d):
    """Samples per type, spelling aside."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce("sample_type", F.lit("")))), r"[\s_\-]+", " ")
    return _latest(spark, d).groupBy(t.alias("sample_type")).agg(F.count("*").alias("n"))


def catalog_overview(spark, d):
    """Each sample with the number of its observations, properties, manifest entries and profiles; sides counted before the join."""
    o = table(spark, d, "property_observations").groupBy("sample_id").agg(F.countDistinct("observation_id").alias("observations"), F.countDistinct("property_name").alias("names"))
    m = table(spark, d, "manifest").groupBy("sample_id").agg(F.count("*").alias("entries"))
    p = table(spark, d, "sample_profiles").groupBy("sample_id").agg(F.count("*").alias("profiles"))
    j = _latest(spark, d).select("sample_id").join(o, "sample_id", "left").join(m, "sample_id", "left").join(p, "sample_id", "left")
    return j.select("sample_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("observations", "names", "entries", "profiles")])


def table_counts(spark, d):
    names = ["samples", "property_observations", "manifest", "sample_profiles", "documents", "document_chunks"]
    out = None
    for n in names:
        part = table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def observation_latest(spark, d):
    """Observations by what their last delivery says, per source: deliveries and distinct ids."""
    o = table(spark, d, "property_observations")
    last = keep_latest(o.select("observation_id", "source", "value_json", "ingested_at"), ["observation_id"], F.desc("ingested_at"), F.desc(F.coalesce("value_json", F.lit(""))))
    a = last.groupBy("source").agg(F.count("*").alias("ids"))
    return o.groupBy("source").agg(F.count("*").alias("deliveries")).join(a, "source").select("source", "deliveries", "ids")


def late_arrivals(spark, d):
    """Observations by days between creation and arrival, in steps."""
    made = F.try_to_timestamp("created_at")
    days = (F.unix_seconds(F.col("ingested_at").cast("timestamp")) - F.unix_seconds(made)) / 86400.0
    step = F.when(days.isNull(), "unknown").when(days < 1, "0").when(days < 7, "1-6").when(days < 28, "7-27").otherwise("28+")
    return table(spark, d, "property_observations").groupBy(step.alias("days")).agg(F.count("*").alias("n"))


def samples_upserted(spark, d):
    """Orders of each customer after the later half of the year is merged over the earlier one, by key."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    first = o.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    late = o.filter("day >= '1996-01-01'")
    return upsert(first, late, ["o_custkey"])


def delete_cascade(spark, d):
    """Rows left in each table when samples of one project and all that hangs on them are deleted."""
    gone = _latest(spark, d).filter("lower(trim(project)) = 'qc'").select("sample_id")
    out = None
    for n in ("samples", "property_observations", "manifest", "sample_profiles"):
        part = table(spark, d, n).join(gone, "sample_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def orphan_check(spark, d):
    """Sample ids per table that the samples lack, letter case, separators and blanks aside."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    known = table(spark, d, "samples").select(key("sample_id").alias("k")).distinct()
    out = None
    for n in ("property_observations", "manifest", "sample_profiles"):
        part = table(spark, d, n).select(key("sample_id").alias("k")).distinct().join(known, "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(n).alias("name"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


def metadata_fields(spark, d):
    """Samples per cut as their JSON metadata tell it; broken or missing JSON is 'none'."""
    cut = F.coalesce(F.get_json_object("metadata_json", "$.cut"), F.lit("none"))
    return _latest(spark, d).groupBy(cut.alias("cut")).agg(F.count("*").alias("n"), F.count(F.get_json_object("metadata_json", "$.batch").try_cast("int")).alias("with_batch"))


def manifest_splits(spark, d):
    s = F.lower(F.trim("split"))
    return table(spark, d, "manifest").groupBy(s.alias("split"), "source").agg(F.count("*").alias("n"), F.count_if(F.col("has_gc_fid")).alias("gc_fid"), F.count_if(F.coalesce("has_ir", F.lit(False))).alias("ir"), F.countDistinct("sample_id").alias("samples"))


def property_groups(spark, d):
    """Observations per normalised group."""
    g = F.coalesce(F.lower(F.trim("property_group")), F.lit("none"))
    return table(spark, d, "property_observations").groupBy(g.alias("property_group")).agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("samples"))


def unpivoted_parts(spark, d):
    """Part measures as attribute and value rows, summarised per attribute and brand."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    long = p.unpivot(["p_partkey", "p_brand"], ["size", "price"], "attribute", "value")
    return long.groupBy("p_brand", "attribute").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def key_value_pivot(spark, d):
    """One row per order priority with a column per status."""
    g = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return g.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"status_{c.lower()}") for c in ("F", "O", "P")])


def natural_order(spark, d):
    """Manifest raw ids in natural order: by their letters, then their number, per source the first twenty."""
    n = F.regexp_extract("raw_sample_id", r"([0-9]{3,})", 1).try_cast("bigint")
    w = Window.partitionBy("source").orderBy(F.col("number").asc_nulls_last(), "entry_id")
    return table(spark, d, "manifest").select("source", "entry_id", n.alias("number")).withColumn("r", F.row_number().over(w)).filter("r <= 20")


def natural_order_all(spark, d):
    """As natural_order, every entry with its rank: rows are sorted over all tasks, and a task's rows are counted before
    their ranks, so that a large source isn't ranked in one task."""
    n = F.regexp_extract("raw_sample_id", r"([0-9]{3,})", 1).try_cast("bigint")
    keys = ["source", F.col("number").asc_nulls_last(), "entry_id"]
    rows = table(spark, d, "manifest").select("source", "entry_id", n.alias("number"))
    # stage() reads small files together, so the task's number is written with the rows
    rows = stage(rows.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).withColumn("task", F.spark_partition_id()))
    part = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "task").orderBy(*keys[1:])))
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # a row per source and task
    before = rows.groupBy(F.col("source").alias("s"), F.col("task").alias("t")).agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return part.join(before, part["source"].eqNullSafe(before["s"]) & (part["task"] == before["t"])).select("source", "entry_id", "number", (F.col("k") + F.col("before")).alias("r"))


def neighbour_audit(spark, d):
    """The stored neighbour table per run: rows, doubled pairs, missing distances, gaps in the ranks."""
    n = table(spark, d, "neighbors")
    g = n.groupBy("run_id", "query_profile_id", "neighbor_profile_id").agg(F.count("*").alias("c"), F.count("distance").alias("known"), F.max("neighbor_rank").alias("rank"))
    per = g.groupBy("run_id", "query_profile_id").agg(F.count("*").alias("pairs"), F.sum((F.col("c") > 1).cast("int")).alias("doubled"), F.sum((F.col("known") == 0).cast("int")).alias("unknown"), F.max("rank").alias("top"))
    return per.groupBy("run_id").agg(F.count("*").alias("queries"), F.sum("pairs").alias("pairs"), F.sum("doubled").alias("doubled"), F.sum("unknown").alias("unknown"), F.sum((F.col("top") > F.col("pairs")).cast("int")).cast("bigint").alias("with_gaps"))


QUERIES = {
    f.__name__: f
    for f in (samples_latest, sample_types, catalog_overview, table_counts, observation_latest, late_arrivals, samples_upserted, delete_cascade, orphan_check, metadata_fields, manifest_splits, property_groups, unpivoted_parts, key_value_pivot, natural_order, natural_order_all, neighbour_audit)
}
_TABLES = ["samples", "property_observations", "manifest", "sample_profiles", "documents", "document_chunks"]
SQL = {
    "samples_latest": f"with {_LATEST} select sample_id, coalesce(project, '') as project, stamp from ls",
    "sample_types": rf"with {_LATEST} select regexp_replace(lower(trim(coalesce(sample_type, ''))), '[\s_\-]+', ' ', 'g') as sample_type, count(*) as n from ls group by 1",
    "catalog_overview": f"with {_LATEST}, o as (select sample_id, count(distinct observation_id) as observations, count(distinct property_name) as names from property_observations group by 1), m as (select sample_id, count(*) as entries from manifest group by 1), p as (select sample_id, count(*) as profiles from sample_profiles group by 1) select sample_id, coalesce(observations, 0) as observations, coalesce(names, 0) as names, coalesce(entries, 0) as entries, coalesce(profiles, 0) as profiles from ls left join o using (sample_id) left join m using (sample_id) left join p using (sample_id)",
    "table_counts": " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in _TABLES),
    "observation_latest": "select source, count(*) as deliveries, i.ids from property_observations join (select source, count(*) as ids from (select source, row_number() over (partition by observation_id order by ingested_at desc, coalesce(value_json, '') desc) as n from property_observations) where n = 1 group by 1) i using (source) group by source, i.ids",
    "late_arrivals": "select case when d is null then 'unknown' when d < 1 then '0' when d < 7 then '1-6' when d < 28 then '7-27' else '28+' end as days, count(*) as n from (select (epoch_us(ingested_at) // 1000000 - epoch_us(try_cast(created_at as timestamptz)) // 1000000) / 86400.0::double as d from property_observations) group by 1",
    "samples_upserted": "with o as (select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders), f as (select * exclude r from (select *, row_number() over (partition by o_custkey order by day, o_orderkey) as r from o) where r = 1), l as (select * exclude r from (select *, row_number() over (partition by o_custkey order by o_orderkey desc, day desc) as r from o where day >= '1996-01-01') where r = 1) select * from f where o_custkey not in (select o_custkey from l) union all select * from l",
    "delete_cascade": f"with {_LATEST}, g as (select sample_id from ls where lower(trim(project)) = 'qc') " + " union all ".join(f"select '{n}' as name, count(*) as n from {n} t where not exists (select 1 from g where g.sample_id = t.sample_id)" for n in _TABLES[:4]),
    "orphan_check": " union all ".join(f"select '{n}' as name, count(*) as orphans from (select distinct regexp_replace(lower(trim(sample_id)), '[^a-z0-9]', '', 'g') as k from {n}) x where not exists (select 1 from samples s where regexp_replace(lower(trim(s.sample_id)), '[^a-z0-9]', '', 'g') = x.k)" for n in _TABLES[1:4]),
    "metadata_fields": f"with {_LATEST} select coalesce(json_extract_string(metadata_json, '$.cut'), 'none') as cut, count(*) as n, count(try_cast(json_extract_string(metadata_json, '$.batch') as int)) as with_batch from ls group by 1",
    "manifest_splits": "select lower(trim(split)) as split, source, count(*) as n, count(*) filter (where has_gc_fid) as gc_fid, count(*) filter (where coalesce(has_ir, false)) as ir, count(distinct sample_id) as samples from manifest group by 1, 2",
    "property_groups": "select coalesce(lower(trim(property_group)), 'none') as property_group, count(*) as n, count(distinct sample_id) as samples from property_observations group by 1",
    "unpivoted_parts": "select p_brand, attribute, count(*) as n, round(avg(value), 4) as mean from (select p_brand, 'size' as attribute, p_size::double as value from part union all select p_brand, 'price', p_retailprice::double from part) group by 1, 2",
    "key_value_pivot": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as status_f, count(*) filter (where o_orderstatus = 'O') as status_o, count(*) filter (where o_orderstatus = 'P') as status_p from orders group by 1",
    "natural_order": "select source, entry_id, number, r from (select *, row_number() over (partition by source order by number asc nulls last, entry_id) as r from (select source, entry_id, try_cast(regexp_extract(raw_sample_id, '([0-9]{3,})', 1) as bigint) as number from manifest)) where r <= 20",
    "natural_order_all": "select source, entry_id, number, row_number() over (partition by source order by number asc nulls last, entry_id) as r from (select source, entry_id, try_cast(regexp_extract(raw_sample_id, '([0-9]{3,})', 1) as bigint) as number from manifest)",
    "neighbour_audit": "with g as (select run_id, query_profile_id, neighbor_profile_id, count(*) as c, count(distance) as known, max(neighbor_rank) as rank from neighbors group by 1, 2, 3), p as (select run_id, query_profile_id, count(*) as pairs, sum((c > 1)::int) as doubled, sum((known = 0)::int) as unknown, max(rank) as top from g group by 1, 2) select run_id, count(*) as queries, sum(pairs)::bigint as pairs, sum(doubled)::bigint as doubled, sum(unknown)::bigint as unknown, sum((top > pairs)::int)::bigint as with_gaps from p group by 1",
}
