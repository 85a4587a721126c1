"""Column expressions that read measured values: property names, units, numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of each property, as normalised by plain_key.
PROPERTY_ALIASES = {
    "density_20c": ["density20c", "densityat20degc", "density20degc", "dens20"],
    "saturates": ["saturates", "saturatecontent"],
    "aromatics": ["aromatics", "aromaticcontent"],
    "resins": ["resins", "resincontent"],
    "asphaltenes": ["asphaltenes", "asphaltenecontent", "c7asphaltenes"],
    "sulfur": ["sulfur", "sulphur", "totalsulfur", "totalsulphur", "scontent"],
    "carbon_residue": ["carbonresidue", "microcarbonresidue", "mcr"],
    "water_content": ["watercontent", "h2ocontent", "water"],
    "nitrogen": ["nitrogen", "totalnitrogen", "ncontent"],
    "nickel": ["nickel", "nickelcontent", "ni"],
    "vanadium": ["vanadium", "vanadiumv", "vcontent"],
    "BP_20": ["bp20", "bp20%", "t20", "boilingpoint20%"],
    "BP_35": ["bp35", "bp35%", "t35", "boilingpoint35%"],
    "BP_50": ["bp50", "bp50%", "t50", "boilingpoint50%"],
    "BP_65": ["bp65", "bp65%", "t65", "boilingpoint65%"],
    "BP_80": ["bp80", "bp80%", "t80", "boilingpoint80%"],
    "pour_point": ["pourpoint", "pptemperature"],
    "flash_point": ["flashpoint"],
    "viscosity_40c": ["viscosity40c", "viscosityat40degc", "kv40", "kinviscosity40c"],
    "molecular_weight": ["molecularweight", "molweight", "averagemolarmass"],
    "vapor_pressure": ["vaporpressure", "vapourpressure", "rvp"],
    "acid_number": ["acidnumber", "totalacidnumber", "tan"],
    "color": ["color", "colour"],
    "appearance": ["appearance", "visualappearance"],
    "is_blended": ["isblended", "blended"],
    "sampled_on": ["sampledon", "samplingdate"],
    "cut_count": ["cutcount", "numberofcuts"],
}

# The unit that each numeric property is reported in.
COMMON_UNIT = {
    "density_20c": "g_cm-3",
    "saturates": "wt_percent", "aromatics": "wt_percent", "resins": "wt_percent", "asphaltenes": "wt_percent",
    "sulfur": "wt_percent", "carbon_residue": "wt_percent", "water_content": "wt_percent",
    "nitrogen": "mg_kg-1", "nickel": "mg_kg-1", "vanadium": "mg_kg-1",
    "BP_20": "degC", "BP_35": "degC", "BP_50": "degC", "BP_65": "degC", "BP_80": "degC",
    "pour_point": "degC", "flash_point": "degC",
    "viscosity_40c": "mm2_s-1", "molecular_weight": "g_mol-1", "vapor_pressure": "kPa", "acid_number": "mgKOH_g-1",
}

# Spellings of each unit, as normalised by plain_key.
UNIT_ALIASES = {
    "g_cm-3": ["gcm3", "gml", "kgl", "gcc"],
    "kg_m-3": ["kgm3", "gl"],
    "lb_ft-3": ["lbft3", "pcf"],
    "lb_gal-1": ["lbgal", "lbgal1", "ppg", "lbusgal"],
    "degC": ["degc", "c", "celsius", "degreec", "degreescelsius"],
    "degF": ["degf", "f", "fahrenheit", "degreef"],
    "K": ["k", "kelvin"],
    "wt_percent": ["wtpercent", "wt%", "mass%", "%mm", "%", "%ww"],
    "fraction": ["fraction", "massfraction", "gg", "kgkg"],
    "mg_kg-1": ["mgkg1", "mgkg", "ppm", "ppmw", "ugg"],
    "ug_kg-1": ["ugkg1", "ugkg", "ppb", "ppbw"],
    "mm2_s-1": ["mm2s1", "mm2s", "cst"],
    "St": ["st", "stokes", "cm2s", "cm2s1"],
    "m2_s-1": ["m2s1", "m2s"],
    "g_mol-1": ["gmol1", "gmol", "da", "kgkmol"],
    "kg_mol-1": ["kgmol1", "kgmol", "kda"],
    "kPa": ["kpa"],
    "bar": ["bar"],
    "psi": ["psi", "psia", "lbfin2", "lbin2"],
    "mmHg": ["mmhg", "torr"],
    "mgKOH_g-1": ["mgkohg1", "mgkohg"],
}

# How a number on each scale becomes the common unit: (factor, offset), value * factor + offset.
TO_COMMON = {
    ("density", "g_cm-3"): (1.0, 0.0), ("density", "kg_m-3"): (0.001, 0.0),
    ("density", "lb_ft-3"): (0.01601846337396, 0.0), ("density", "lb_gal-1"): (0.11982642731689663, 0.0),
    ("percent", "wt_percent"): (1.0, 0.0), ("percent", "fraction"): (100.0, 0.0),
    ("percent", "mg_kg-1"): (1e-4, 0.0), ("percent", "ug_kg-1"): (1e-7, 0.0),
    ("trace", "mg_kg-1"): (1.0, 0.0), ("trace", "ug_kg-1"): (0.001, 0.0),
    ("trace", "wt_percent"): (1e4, 0.0), ("trace", "fraction"): (1e6, 0.0),
    ("temperature", "degC"): (1.0, 0.0), ("temperature", "degF"): (5.0 / 9.0, -160.0 / 9.0), ("temperature", "K"): (1.0, -273.15),
    ("viscosity", "mm2_s-1"): (1.0, 0.0), ("viscosity", "St"): (100.0, 0.0), ("viscosity", "m2_s-1"): (1e6, 0.0),
    ("molar", "g_mol-1"): (1.0, 0.0), ("molar", "kg_mol-1"): (1000.0, 0.0),
    ("pressure", "kPa"): (1.0, 0.0), ("pressure", "bar"): (100.0, 0.0),
    ("pressure", "psi"): (6.894757293168361, 0.0), ("pressure", "mmHg"): (0.1333223684, 0.0),
    ("acid", "mgKOH_g-1"): (1.0, 0.0),
}

DIMENSION_OF_UNIT = {
    "g_cm-3": "density", "wt_percent": "percent", "mg_kg-1": "trace", "degC": "temperature", "mm2_s-1": "viscosity",
    "g_mol-1": "molar", "kPa": "pressure", "mgKOH_g-1": "acid",
}

# Texts that stand for "no value".
NO_VALUE = ["", "-", "--", "---", "na", "n/a", "n.a.", "n.a", "nan", "none", "null", "nd", "n.d.", "n.d", "not determined", "not measured",
            "not available", "unknown", "tbd", "pending", "missing", "?", "x", ".", "..", "...", "—", "–", "nil", "no data", "not tested"]

#: A number that is not the tail of a unit such as mm2 or s-1.
NUMBER = r"(?<![A-Za-z0-9_^/.,\-])([-+−]?[0-9]+(?:[.,][0-9]+)*(?:[eE][-+]?[0-9]+)?)"


def literal_map(pairs: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def plain_key(x: Column) -> Column:
    """Lower case with only a-z, 0-9 and % kept; superscript digits and micro signs become plain."""
    return F.regexp_replace(F.translate(F.lower(x), "³²¹µμ", "321uu"), "[^a-z0-9%]", "")


def property_and_unit(name: Column) -> tuple[Column, Column]:
    """The property that a spelling names, and the key of the unit written behind it ('' for none).

    The list of spellings only merges names: one outside it is a property too, named by its letters and digits in
    small letters. Null for a name without any.
    """
    alias = {a: p for p, keys in PROPERTY_ALIASES.items() for a in keys}
    units = {u: c for c, keys in UNIT_ALIASES.items() for u in keys}
    longest = "|".join(sorted(alias, key=lambda a: (-len(a), a)))
    tails = "|".join(sorted(units, key=lambda a: (-len(a), a)))
    key = plain_key(name)
    whole = literal_map(alias)[key]
    pattern = f"^({longest})(?:in)?({tails})$"
    known = F.coalesce(whole, literal_map(alias)[F.regexp_extract(key, pattern, 1)])
    # an unlisted name is an attribute of its own, under its normalised spelling
    base = F.coalesce(known, F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}%]", ""), F.lit("")))
    tail = F.when(whole.isNull(), F.regexp_extract(key, pattern, 2)).otherwise("")
    return base, tail


def unit_of(key: Column) -> Column:
    """The unit that a normalised spelling means; null for an unknown one."""
    return literal_map({u: c for c, keys in UNIT_ALIASES.items() for u in keys})[key]


def to_number(text: Column) -> Column:
    """A number text with a decimal point or comma; with both, the last one is the decimal mark."""
    t = F.translate(text, "−", "-")
    comma, point = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    us = F.regexp_replace(t, ",", "")
    eu = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    return F.when((comma > 0) & ((point == 0) | (comma < point)), eu).otherwise(us).try_cast("double")


def to_date(text: Column) -> Column:
    """A date in ISO, slashed, dotted (day first) or named-month form; null where none fits."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d"))
        .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), F.try_to_date(F.regexp_extract(t, r"^(\d{4}/\d{1,2}/\d{1,2})", 1), "yyyy/M/d"))
        .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy"))
        .when(t.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(t), "d MMM yyyy"))
    )


def parse_observations(observations):
    """One row per row of ``observations`` with what its value, unit and name say.

    Added columns: ``property`` (canonical name, or the normalised spelling of an unlisted one; null for a blank name), ``common_unit`` (null for descriptive
    properties), ``value_text`` (the scalar text, null for JSON null, broken JSON and "no value" stand-ins),
    ``number`` (null where the value has none), ``stated_unit`` (from the value, else the unit column, else
    the name; null where none is known). Nulls in any column give nulls; extra columns pass through.
    """
    value = F.trim("value_json")
    first = F.substring(value, 1, 1)
    is_number, is_text, is_object = first.rlike("[-0-9]"), first == '"', first == "{"
    # most values are bare numbers: only the others are parsed as JSON and searched for numbers and units
    base, tail = property_and_unit(F.col("property_name"))
    out = observations.withColumns({"property": base, "_tail": tail, "_fields": F.when(is_object, F.from_json(value, "value string, result string, val string, unit string, units string, uom string"))})
    fields = F.col("_fields")
    text = F.when(is_number, value).when(is_text, F.trim(F.get_json_object(value, "$"))).when(is_object, F.trim(F.coalesce(fields["value"], fields["result"], fields["val"]))).otherwise(F.get_json_object(value, "$"))
    out = out.withColumn("_text", text)
    out = out.withColumn("value_text", F.when(~F.lower("_text").isin(NO_VALUE), F.col("_text")))
    bare = F.when(is_number, F.col("value_text").try_cast("double"))
    out = out.withColumn("_digits", F.when(bare.isNull(), F.regexp_extract("value_text", NUMBER, 1)))
    around = F.regexp_replace(F.replace(F.col("value_text"), F.col("_digits")), r"(?i)\([a-z ]*\)|^\s*[<>~]=?|^\s*(?:ca\.?|approx\.?|about)\s", "")
    out = out.withColumns({
        "number": F.coalesce(bare, F.when(F.col("_digits") != "", to_number(F.col("_digits")))),
        "common_unit": literal_map(COMMON_UNIT)[F.col("property")],
        "_in_text": F.when(is_object, F.coalesce(fields["unit"], fields["units"], fields["uom"])).when(is_text & (F.col("_digits") != ""), around),
    })
    stated = F.coalesce(unit_of(plain_key(F.col("_in_text"))), unit_of(plain_key(F.col("unit"))), unit_of(F.col("_tail")))
    return out.withColumn("stated_unit", stated).drop("_tail", "_fields", "_text", "_digits", "_in_text")


def common_value(number: Column, unit: Column, common: Column) -> Column:
    """``number`` on scale ``unit`` converted to the unit ``common``; null for units of another kind."""
    kind = literal_map(DIMENSION_OF_UNIT)[common]
    key = F.concat_ws("|", kind, unit)
    factor = literal_map({f"{k}|{u}": f for (k, u), (f, _) in TO_COMMON.items()})[key]
    offset = literal_map({f"{k}|{u}": o for (k, u), (_, o) in TO_COMMON.items()})[key]
    return number * factor + offset
