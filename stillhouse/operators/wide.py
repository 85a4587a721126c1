"""Entity, attribute, value rows as one wide row per entity with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.functions.measures import COMMON_UNIT, common_value, parse_observations, to_date
from stillhouse.sources.tables import stage

#: The attribute list is read by the driver, so its length is checked; beyond it the call fails.
MAX_ATTRIBUTES = 2_000

# Texts that mean true and false.
TRUE_TEXTS = ["true", "yes", "y", "1", "t", "1.0"]
FALSE_TEXTS = ["false", "no", "n", "0", "f", "0.0"]


def plain_id(x: Column) -> Column:
    """A sample id without case, separators and blanks."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def discover_attributes(parsed: DataFrame) -> dict[str, str]:
    """The attributes that occur, with the type that most of their usable values have.

    Types: number (values in a common unit), boolean, date, integer, text. Counted over all rows with map-side
    aggregation; only one row per attribute reaches the driver.
    """
    text = F.lower(F.col("value_text"))
    kinds = {
        "boolean": text.isin(TRUE_TEXTS + FALSE_TEXTS),
        "date": to_date(F.col("value_text")).isNotNull(),
        "integer": F.coalesce(F.col("value_text").try_cast("double") % 1 == 0, F.lit(False)),
        "number": F.col("number").isNotNull(),
        "words": text.rlike(r"^\p{L}"),
    }
    counts = parsed.filter("value_text is not null and property is not null").groupBy("property").agg(
        F.count("*").alias("n"), F.max(F.col("common_unit").isNotNull()).alias("measured"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in kinds.items()]
    )
    rows = counts.limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    out = {}
    for r in sorted(rows, key=lambda r: r["property"]):
        most = lambda k, r=r: 2 * r[k] > r["n"]
        out[r["property"]] = "number" if r["measured"] else "boolean" if most("boolean") and 2 * (r["n"] - r["integer"]) > r["n"] else "date" if most("date") else "integer" if most("integer") else "number" if most("number") and not most("words") else "text"
    return out


def typed_value(kind: str) -> Column:
    """The column ``value_text`` read as ``kind``; null where it isn't usable."""
    text = F.col("value_text")
    if kind == "number":
        # without a stated scale, the number stands on the common one; a unit of another kind makes it unusable
        converted = common_value(F.col("number"), F.coalesce("stated_unit", "common_unit"), F.col("common_unit"))
        return F.when(F.col("common_unit").isNull(), F.col("number")).otherwise(F.coalesce(F.col("scaled"), converted))
    if kind == "integer":
        x = F.col("number")
        return F.when(x % 1 == 0, x.cast("long"))
    if kind == "boolean":
        return F.when(F.lower(text).isin(TRUE_TEXTS), True).when(F.lower(text).isin(FALSE_TEXTS), False)
    if kind == "date":
        return to_date(text)
    return F.lower(F.trim(text))


def wide_table(observations: DataFrame, samples: DataFrame, attributes: dict[str, str] | None = None, scales: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """One row per sample with one typed column per attribute, and the attributes with their types.

    The attribute list and types are discovered first (unless given): every name that occurs, listed or not. Numbers come out in common units: by ``scales``
    (observation_id once, common_value), else by the stated unit. A number whose unit is of
    another kind isn't usable. Of several usable values of a cell the
    one with the latest created_at (as UTC) wins, then the larger observation_id; unusable values never win.
    Ids come out as in ``samples``: matched without case, separators and blanks, the smallest spelling where
    several match, the observation's own trimmed id where none does. Observations without id or property name
    are left out; a sample without usable values has no row. Empty tables give an empty result.
    """
    cols = ["observation_id", "sample_id", "property", "value_text", "number", "stated_unit", "common_unit", "created_at"]
    parsed = parse_observations(observations).filter("property is not null and value_text is not null").select(*cols)
    parsed = stage(parsed)
    kinds = attributes or discover_attributes(parsed)
    if scales is None:
        parsed = parsed.withColumn("scaled", F.lit(None).cast("double"))
    else:
        parsed = parsed.join(scales.select("observation_id", F.col("common_value").alias("scaled")), "observation_id", "left")
    order = F.coalesce(F.try_to_timestamp("created_at").cast("long"), F.lit(-(2**62)))
    names = {a: f"a{i}" for i, a in enumerate(kinds)}
    cells = [
        F.max(F.when((F.col("property") == a) & F.col(f"v_{k}").isNotNull(), F.struct("order", "observation_id", F.col(f"v_{k}").alias("v"))))["v"].alias(names[a])
        for a, k in kinds.items()
    ]
    rows = parsed.withColumns({"k": plain_id(F.col("sample_id")), "order": order, **{f"v_{k}": typed_value(k) for k in set(kinds.values())}}).filter("k is not null and k <> ''")
    wide = rows.groupBy("k").agg(F.min(F.trim("sample_id")).alias("own_id"), *cells)
    known = samples.filter("sample_id is not null").groupBy(plain_id(F.col("sample_id")).alias("k")).agg(F.min("sample_id").alias("sample_id"))
    # a sample with only unusable values still has a row before this filter
    joined = wide.join(known, "k", "left").withColumn("sample_id", F.coalesce("sample_id", "own_id"))
    out = joined.select("sample_id", *[F.col(names[a]).alias(a) for a in kinds])
    if kinds:
        out = out.filter(F.coalesce(*[F.col(f"`{a}`").cast("string") for a in kinds]).isNotNull())
    return out, kinds


def filled_cells(wide: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """(sample_id, attribute_name) of the cells that hold a value."""
    if not attributes:
        return wide.select("sample_id", F.lit("").alias("attribute_name")).limit(0)
    names = F.filter(F.array(*[F.when(F.col(f"`{a}`").isNotNull(), F.lit(a)) for a in attributes]), lambda x: x.isNotNull())
    return wide.select("sample_id", F.explode(names).alias("attribute_name"))
