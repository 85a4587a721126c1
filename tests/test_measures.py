import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillhouse.functions.measures import common_value, parse_observations, to_date, to_number
from stillhouse.operators.units import UnitParams, recorded_scales
from stillhouse.operators.wide import filled_cells, wide_table

SCHEMA = "observation_id string, sample_id string, property_name string, property_group string, value_json string, unit string, method string, created_at string, source string, ingested_at timestamp"


def observation(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra)


def row(no, name, value, unit=None, sample="pf_1", created="2024-01-01T00:00:00Z"):
    return (f"o{no}", sample, name, None, value, unit, None, created, "lab", datetime.datetime(2024, 1, 2))


@pytest.mark.parametrize("text,want", [("1.5", 1.5), ("1,5", 1.5), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("-3", -3.0), ("1e-4", 1e-4), ("", None), ("x", None), (None, None)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text", ["2024-03-05", "2024-03-05T00:00:00", "2024/03/05", "05.03.2024", "20240305", "05 Mar 2024"])
def test_dates(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(to_date(F.col("t"))).first()[0] == datetime.date(2024, 3, 5)


def test_values_and_units(spark):
    cases = [
        ("Density @ 20 C", "850.1", "kg/m³", ("density_20c", 850.1, "kg_m-3")), ("sulfur (wt%)", '"0,5"', None, ("sulfur", 0.5, "wt_percent")), ("T50", '"ca. 400.2 degF"', None, ("BP_50", 400.2, "degF")),
        ("kv40", '{"val": 3.1, "uom": "St"}', None, ("viscosity_40c", 3.1, "St")), ("kv40", '"mm2_s-1 1.2874"', None, ("viscosity_40c", 1.2874, "mm2_s-1")), ("Ni", '"<5.2 [ug/kg]"', None, ("nickel", 5.2, "ug_kg-1")),
        ("Ni", '"n/a"', "ppm", ("nickel", None, "mg_kg-1")), ("Ni", "null", None, ("nickel", None, None)), ("Ni", None, None, ("nickel", None, None)), ("Ni", '{"broken', None, ("nickel", None, None)), (None, "1.0", None, (None, 1.0, None)), ("no such thing", "1.0", "bar", ("nosuchthing", 1.0, "bar")),
        ("Ni", '"' + "x" * 200_000 + '"', None, ("nickel", None, None)),
    ]
    got = parse_observations(observation(spark, [row(i, n, v, u) for i, (n, v, u, _) in enumerate(cases)])).orderBy(F.expr("cast(substr(observation_id, 2) as int)")).collect()
    for g, (_, _, _, want) in zip(got, cases):
        assert (g["property"], g["number"], g["stated_unit"]) == want


def test_conversion(spark):
    df = spark.createDataFrame([(212.0, "degF", "degC"), (300.0, "K", "degC"), (0.5, "fraction", "wt_percent"), (2.0, "bar", "kPa"), (1.0, "bar", "degC"), (None, "K", "degC")], "n double, u string, c string")
    got = [r[0] for r in df.select(F.round(common_value(F.col("n"), F.col("u"), F.col("c")), 6)).collect()]
    assert got == [100.0, 26.85, 50.0, 200.0, None, None]


def test_scales_of_empty_and_odd_tables(spark):
    assert recorded_scales(observation(spark, [])).count() == 0
    odd = observation(spark, [(None,) * 10, row(1, None, None), row(2, "Ni", '""'), row(3, "Ni", "4.0", "mg_kg-1")])
    got = recorded_scales(odd.withColumn("number", F.lit("clash")).withColumn("guess", F.lit(1))).collect()
    assert [(r["observation_id"], r["recorded_unit"], r["common_value"]) for r in got] == [("o3", "mg_kg-1", 4.0)]


def test_hidden_units_are_found(spark):
    """Stated units of numbers that are impossible on the common scale are taken away and must be recovered."""
    o = spark.read.parquet("/root/testdata/sf0.01/property_observations.parquet")
    parsed = parse_observations(o).filter("stated_unit in ('kg_m-3', 'fraction', 'm2_s-1', 'kg_mol-1') and property in ('density_20c', 'aromatics', 'viscosity_40c', 'molecular_weight')")
    truth = {r["observation_id"]: r["stated_unit"] for r in parsed.filter("abs(hash(observation_id)) % 8 = 0").select("observation_id", "stated_unit").collect()}
    hide = F.col("observation_id").isin(list(truth))
    number = parse_observations(o).select("observation_id", "number", "property").dropDuplicates(["observation_id"])
    blank = o.join(number, "observation_id").withColumn("value_json", F.when(hide, F.col("number").cast("string")).otherwise(F.col("value_json"))).withColumn("unit", F.when(~hide, F.col("unit")))
    blank = blank.withColumn("property_name", F.when(hide, F.col("property")).otherwise(F.col("property_name"))).drop("number", "property")
    got = {r["observation_id"]: r["recorded_unit"] for r in recorded_scales(blank).filter(F.col("observation_id").isin(list(truth))).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    assert len(truth) > 40 and right / len(truth) > 0.95


def test_wide_table_cells(spark):
    rows = [
        row(1, "sulfur", "1.0", "wt_percent", "PF-1", "2024-01-01T00:00:00Z"), row(2, "S content", "20000", "ppm", " pf_1 ", "2024-02-01T00:00:00Z"), row(3, "color", '"Amber "', None, "pf_1"), row(4, "color", '"n/a"', None, "pf_1", "2025-01-01T00:00:00Z"),
        row(5, "blended?", '"Y"', None, "pf_1"), row(6, "is_blended", "false", None, "pf_2"), row(7, "is_blended", '"no"', None, "pf_4"), row(8, "number of cuts", '" 7 "', None, "pf_1"), row(9, "cut_count", "10.0", None, "pf_2"), row(10, "sampling date", '"05.03.2024"', None, "pf_1"),
        row(11, "sulfur", '"--"', None, "pf_3"), row(12, "sulfur", None, None, "pf_3"), row(13, None, "1", None, "pf_3"), row(14, "sulfur", "1.0", None, None), row(15, "sulfur", "1.0", None, " "), row(1, "sulfur", "1.0", "wt_percent", "PF-1", "2024-01-01T00:00:00Z"),
    ]
    samples = spark.createDataFrame([("pf_1",), ("pf_1",), ("pf_2",), (None,)], "sample_id string")
    wide, kinds = wide_table(observation(spark, rows), samples)
    got = {r["sample_id"]: r.asDict() for r in wide.collect()}
    assert set(got) == {"pf_1", "pf_2", "pf_4"} and kinds["sulfur"] == "number" and kinds["is_blended"] == "boolean" and kinds["cut_count"] == "integer" and kinds["sampled_on"] == "date" and kinds["color"] == "text"
    assert got["pf_1"]["sulfur"] == 2.0 and got["pf_1"]["color"] == "amber" and got["pf_1"]["is_blended"] is True and got["pf_1"]["cut_count"] == 7 and got["pf_1"]["sampled_on"] == datetime.date(2024, 3, 5)
    assert got["pf_2"]["is_blended"] is False and got["pf_2"]["cut_count"] == 10 and got["pf_2"]["sulfur"] is None
    assert filled_cells(wide, kinds).filter("sample_id = 'pf_2'").count() == 2


def test_wide_table_by_scales(spark):
    o = observation(spark, [row(1, "sulfur", "20000", None), row(2, "sulfur", "1.0", None, "pf_2")])
    scales = spark.createDataFrame([("o1", 2.0)], "observation_id string, common_value double")
    got = {r["sample_id"]: r["sulfur"] for r in wide_table(o, spark.createDataFrame([], "sample_id string"), scales=scales)[0].collect()}
    assert got == {"pf_1": 2.0, "pf_2": 1.0}


def test_wide_table_of_nothing(spark):
    wide, kinds = wide_table(observation(spark, []), spark.createDataFrame([], "sample_id string"))
    assert wide.count() == 0 and kinds == {} and filled_cells(wide, kinds).count() == 0
    clash = observation(spark, [row(1, "sulfur", "1.0", "wt_percent")]).withColumn("k", F.lit(1)).withColumn("order", F.lit(2)).withColumn("v_number", F.lit(3))
    assert wide_table(clash, spark.createDataFrame([("pf_1",)], "sample_id string"))[0].collect()[0]["sulfur"] == 1.0


def test_unlisted_names_are_attributes(spark):
    """A name outside the list of spellings becomes a column with its own type; its spellings fall together."""
    rows = [row(1, "Refractive Index", "1.48"), row(2, "refractive_index", "1.50", None, "pf_2"), row(3, "Operator", '"K. Ruslero"'), row(4, "sulfur", "1.0", "bar", "pf_3"), row(5, "  ", "1"), row(6, "sulfur", "2.0", "wt_percent")]
    wide, kinds = wide_table(observation(spark, rows), spark.createDataFrame([], "sample_id string"))
    got = {r["sample_id"]: r.asDict() for r in wide.collect()}
    assert kinds == {"refractiveindex": "number", "operator": "text", "sulfur": "number"}
    assert got["pf_1"] == {"sample_id": "pf_1", "refractiveindex": 1.48, "operator": "k. ruslero", "sulfur": 2.0} and got["pf_2"]["refractiveindex"] == 1.5
    assert "pf_3" not in got  # a pressure is no sulfur content


def test_forest_decides(spark):
    """Scales beside no or the common unit come from the forest alone, whatever the number of sources: without
    confident assignments none is moved."""
    o = spark.read.parquet("/root/testdata/sf0.001/property_observations.parquet")
    many = o.withColumn("source", F.concat(F.lit("lab "), F.pmod(F.xxhash64("observation_id"), F.lit(1000)).cast("string")))
    told = parse_observations(many).filter("stated_unit <> common_unit").select("observation_id").distinct()
    moved = lambda p: recorded_scales(many, p).filter("recorded_unit <> common_unit").select("observation_id").distinct().join(told, "observation_id", "left_anti").count()
    assert moved(UnitParams()) > 10 and moved(UnitParams(confident=1.1)) == 0
    assert recorded_scales(many, UnitParams(confident=1.1)).filter("review").count() > 10


def test_trees_are_walked_in_tasks(spark, small):
    """No row goes through a chain of vector functions one by one; the arrays say the same as Spark's forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from stillhouse.operators.units import Forest

    plan = recorded_scales(spark.read.parquet(f"{small}/property_observations.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF(" not in plan and "MapInArrow" in plan
    nominal = {"ml_attr": {"type": "nominal", "name": "b", "vals": ["0", "1", "2", "3", "4"]}}
    rows = spark.range(3000).select((F.rand(1) * 9 - 3).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b", metadata=nominal), F.randn(3).alias("c"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).withColumn("label", F.when(F.col("b") % 2 == 1, 2.0).when(F.col("a") > F.col("c"), 1.0).otherwise(0.0)).cache()
    model = RandomForestClassifier(numTrees=5, maxDepth=6, seed=1).fit(rows)
    told = model.transform(rows).select("features", "probability").collect()
    x = np.array([r["features"].toArray() for r in told])
    assert np.allclose(Forest(model, spark).probabilities(x), np.array([r["probability"].toArray() for r in told]), atol=1e-12)
