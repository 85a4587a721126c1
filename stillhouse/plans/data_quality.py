"""Queries of the general data problems: common units and the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.functions.measures import COMMON_UNIT, NO_VALUE, PROPERTY_ALIASES, UNIT_ALIASES
from stillhouse.operators.units import one_per_observation, recorded_scales
from stillhouse.operators.wide import FALSE_TEXTS, TRUE_TEXTS, filled_cells, wide_table
from stillhouse.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = recorded_scales(table(spark, d, "property_observations"), stated_too=False).filter("recorded_unit <> common_unit")
    return rows.groupBy("observation_id").agg(F.min("recorded_unit").alias("recorded_unit"))


def p1_common_values(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_observation(recorded_scales(table(spark, d, "property_observations")))
    return rows.select("observation_id", "property", "number", "recorded_unit", F.round("common_value", 6).alias("common_value"), F.round("confidence", 4).alias("confidence"), "review")


def p1_review_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per source, property and recorded scale: observations, and those whose scale needs a look."""
    o = table(spark, d, "property_observations")
    source = o.filter("observation_id is not null").groupBy("observation_id").agg(F.max("source").alias("source"))
    rows = one_per_observation(recorded_scales(o)).join(source, "observation_id", "left")
    return rows.groupBy("source", "property", "recorded_unit").agg(F.count("*").alias("n"), F.sum(F.col("review").cast("long")).alias("to_review"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wide, kinds = wide_table(table(spark, d, "property_observations"), table(spark, d, "samples"))
    return filled_cells(wide, kinds)


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "property_observations")
    return wide_table(o, table(spark, d, "samples"), scales=one_per_observation(recorded_scales(o)))[0]


QUERIES = {"p1_found": p1_found, "p1_common_values": p1_common_values, "p1_review_by_source": p1_review_by_source, "p2_found": p2_found, "p2_wide": p2_wide}


def _p2_sql() -> str:
    """The wide table's filled cells: spellings as a value list, one rule per type of attribute."""
    names = ", ".join(f"('{a}', '{p}')" for p, keys in PROPERTY_ALIASES.items() for a in keys)
    heads = "|".join(sorted((a for keys in PROPERTY_ALIASES.values() for a in keys), key=lambda a: (-len(a), a)))
    tails = "|".join(sorted((u for keys in UNIT_ALIASES.values() for u in keys), key=lambda u: (-len(u), u)))
    nothing = ", ".join(f"'{x}'" for x in NO_VALUE)
    boolean, whole = ", ".join(f"'{x}'" for x in TRUE_TEXTS + FALSE_TEXTS), "'cut_count'"
    measured = ", ".join(f"'{p}'" for p in COMMON_UNIT)
    return rf"""with al as (select * from (values {names}) t(alias, property)),
 o as (select sample_id, lower(property_name) as raw, regexp_replace(translate(lower(property_name), '³²¹µμ', '321uu'), '[^a-z0-9%]', '', 'g') as k, value_json as v from property_observations),
 p as (select o.sample_id, coalesce(w.property, b.property, nullif(regexp_replace(o.raw, '[^\p{{L}}\p{{N}}%]', '', 'g'), '')) as property, trim(case when ltrim(v) like '{{%' then coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.result'), json_extract_string(v, '$.val')) else json_extract_string(v, '$') end) as t
 from o left join al w on w.alias = k left join al b on w.alias is null and b.alias = regexp_extract(k, '^({heads})(?:in)?({tails})$', 1)),
 u as (select regexp_replace(lower(sample_id), '[^\p{{L}}\p{{N}}]', '', 'g') as k, property, t from p where property is not null and t is not null and lower(t) not in ({nothing})),
 g as (select distinct k, property from u where case when property in ({measured}) then regexp_matches(t, '[0-9]') when property = 'is_blended' then lower(t) in ({boolean}) when property = {whole} then try_cast(t as double) % 1 = 0 when property = 'sampled_on' then regexp_matches(t, '[0-9]{{4}}') else true end),
 s as (select regexp_replace(lower(sample_id), '[^\p{{L}}\p{{N}}]', '', 'g') as k, min(sample_id) as sample_id from samples where sample_id is not null group by 1)
 select s.sample_id, property as attribute_name from g join s using (k)"""


SQL = {"p2_found": _p2_sql()}
