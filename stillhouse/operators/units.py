"""Bringing one measured quantity, recorded on several scales, to a common unit.

A random forest trained on rows with a stated unit predicts the scale of every row from magnitude, source,
category and neighbouring fields; where the number would stand in the property's known range on each scale is
one of its features. Its confidence is calibrated on held-out rows. Confident assignments decide, whether the
number lies inside or outside that range, for rows with no unit and with the common one; unsure ones keep the
common unit and go to review, as do rows whose stated other unit the forest contradicts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stillhouse.functions.measures import COMMON_UNIT, DIMENSION_OF_UNIT, TO_COMMON, common_value, parse_observations
from stillhouse.sources.tables import shared_dir, stage


@dataclass(frozen=True)
class UnitParams:
    """sample_rows bounds the labelled rows that the forest is fitted on (a documented bound: a few
    thousand rows per property suffice); all rows are scored and all rows give the ranges. confident: calibrated
    probability from which a scale is assigned where none or the common one is stated. doubtful: examples of the
    common unit lie in the property's range widened by this factor, as that unit is sometimes written beside
    numbers of another scale. buckets: sources, groups and methods are hashed to so many categories,
    however many there are."""

    sample_rows: int = 24_000
    trees: int = 12
    depth: int = 9
    confident: float = 0.8
    doubtful: float = 1.5
    buckets: int = 24
    seed: int = 11


_KINDS = sorted(set(DIMENSION_OF_UNIT.values()))
_CLASSES = sorted({u for _, u in TO_COMMON})
_COMMON_OF = {kind: unit for unit, kind in DIMENSION_OF_UNIT.items()}
#: The scales of each kind, the common one first.
_SCALES = {kind: [_COMMON_OF[kind], *sorted(u for k, u in TO_COMMON if k == kind and u != _COMMON_OF[kind])] for kind in _KINDS}
_SLOTS = max(len(x) for x in _SCALES.values())
_CATEGORIES = ("source", "property_group", "method")


def _constants(spark: SparkSession, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    """One row per property of the fixed list (so its size is bounded): its known range, and per scale of its kind the unit (u),
    its class (c) and how a number becomes the common unit (f, o)."""
    log = lambda x: math.log10(max(abs(x), 1e-12))
    rows = []
    for name, common in COMMON_UNIT.items():
        kind = DIMENSION_OF_UNIT[common]
        low, middle, high = ranges.get(name, (None, None, None))
        known = low is not None
        row = [name, float(_KINDS.index(kind)), low, high, known and (common == "degC" or low <= 0), log(low) if known else None, max(log(high) - log(low), 1e-9) if known else None, log(middle) if known else 0.0]
        for j in range(_SLOTS):
            unit = _SCALES[kind][j] if j < len(_SCALES[kind]) else None
            row += [unit, _CLASSES.index(unit) if unit else None, *(TO_COMMON[kind, unit] if unit else (None, None))]
        rows.append(tuple(row))
    per = ", ".join(f"u{j} string, c{j} int, f{j} double, o{j} double" for j in range(_SLOTS))
    return spark.createDataFrame(rows, f"property string, c_kind double, low double, high double, additive boolean, log_low double, log_span double, log_middle double, {per}")


def _by_unit(unit: Column, what: str) -> Column:
    """The constant ``what`` of the scale ``unit`` among those of the row's kind; null for a unit of another kind."""
    out = F.when(unit == F.col("u0"), F.col(f"{what}0"))
    for j in range(1, _SLOTS):
        out = out.when(unit == F.col(f"u{j}"), F.col(f"{what}{j}"))
    return out


def _nominal(column: Column, name: str, values: int) -> Column:
    return column.alias(name, metadata={"ml_attr": {"type": "nominal", "name": name, "vals": [str(i) for i in range(values)]}})


def _features(rows: DataFrame, params: UnitParams) -> tuple[DataFrame, list[str]]:
    """``rows`` (with the constants) and columns that the forest sees, and their names: where the number stands on each scale of its
    kind (0 and 1 are the ends of the property's range), its magnitude, its form, and the hashed categories."""
    log = lambda x: F.log10(F.greatest(x, F.lit(1e-12)))

    def place(j: int) -> Column:
        v = F.col("number") * F.col(f"f{j}") + F.col(f"o{j}")
        at = F.when(F.col("additive"), (v - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))).otherwise((log(v) - F.col("log_low")) / F.col("log_span"))
        at = F.greatest(F.lit(-5.0), F.least(F.lit(6.0), at))
        return F.when(v.isNull(), -9.0).otherwise(F.coalesce(at, F.lit(0.5 if j == 0 else -9.0)))

    size = log(F.abs("number"))
    numeric = {
        **{f"f_place_{j}": place(j) for j in range(_SLOTS)}, "f_size": size, "f_relative": size - F.col("log_middle"),
        "f_negative": (F.col("number") < 0).cast("double"), "f_is_text": F.coalesce(F.ltrim("value_json").startswith('"'), F.lit(False)).cast("double"),
    }
    hashed = [_nominal(F.pmod(F.xxhash64(F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit(params.buckets)).cast("double"), f"h_{c}", params.buckets) for c in _CATEGORIES]
    wide = rows.select("*", *[x.alias(n) for n, x in numeric.items()], *hashed, _nominal(F.col("c_kind"), "h_kind", len(_KINDS)))
    return wide, [*numeric, *[f"h_{c}" for c in _CATEGORIES], "h_kind"]


def _assembled(rows: DataFrame, params: UnitParams) -> DataFrame:
    wide, names = _features(rows, params)
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


class Forest:
    """A fitted forest as arrays, with one entry per node of all trees; a leaf leads to itself."""

    def __init__(self, model: RandomForestClassificationModel, spark: SparkSession):
        path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        model.save(path)
        nodes = [(r["treeID"], r["nodeData"]) for r in spark.read.parquet(f"{path}/data").collect()]  # trees x 2^(depth + 1) at most
        nodes.sort(key=lambda x: (x[0], x[1]["id"]))
        first: dict[int, int] = {}
        for i, (tree, _) in enumerate(nodes):
            first.setdefault(tree, i)
        inner = np.array([n["leftChild"] >= 0 for _, n in nodes])
        self.roots, self.depth = [first[t] for t in sorted(first)], model.getMaxDepth()
        self.left, self.right = (np.array([first[t] + n[c] if n["leftChild"] >= 0 else i for i, (t, n) in enumerate(nodes)]) for c in ("leftChild", "rightChild"))
        splits = [n["split"] for _, n in nodes]
        self.feature = np.where(inner, [s["featureIndex"] for s in splits], 0)
        self.nominal = inner & np.array([s["numCategories"] >= 0 for s in splits])
        self.threshold = np.array([s["leftCategoriesOrThreshold"][0] if i and not c else 0.0 for s, i, c in zip(splits, inner, self.nominal)])
        self.lefts = np.zeros((len(nodes), max([1, *[s["numCategories"] for s in splits]])), bool)
        for i in np.flatnonzero(self.nominal):
            self.lefts[i, np.array(splits[i]["leftCategoriesOrThreshold"], int)] = True
        stats = np.array([n["impurityStats"] for _, n in nodes])
        total = stats.sum(axis=1, keepdims=True)
        self.share = np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row per row of ``x``, one column per class."""
        votes, start, flat = np.zeros((len(x), self.share.shape[1])), np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                value = flat[start + self.feature[node]]
                left = value <= self.threshold[node]
                named = np.flatnonzero(self.nominal[node])
                left[named] = self.lefts[node[named], value[named].astype(int)]
                node = np.where(left, self.left[node], self.right[node])
            votes += self.share[node]
        return votes / votes.sum(axis=1, keepdims=True)


def _scored(rows: DataFrame, params: UnitParams, model: RandomForestClassificationModel, keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` (with the constants) and what ``_choice`` says of them: ``slot``, the scale's place among those of the row's
    kind, and ``sure``. The trees are walked in tasks, a batch of rows at a time."""
    wide, names = _features(rows, params)
    shared = rows.sparkSession.sparkContext.broadcast(Forest(model, rows.sparkSession))
    classes = {p: [_CLASSES.index(u) for u in _SCALES[DIMENSION_OF_UNIT[c]]] for p, c in COMMON_UNIT.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            property_ = batch.column("property").dictionary_encode()
            own = [classes[p] for p in property_.dictionary.to_pylist()]
            at = np.array([[*x, *[-1] * (_SLOTS - len(x))] for x in own], dtype=int).reshape(-1, _SLOTS)[property_.indices.to_numpy()]
            p = forest.probabilities(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1))
            p = np.concatenate([p, np.zeros((len(p), max(1, len(_CLASSES) - p.shape[1] + 1)))], axis=1)  # classes that no example has, and -1
            each = np.take_along_axis(p, at, axis=1)
            top, total = each.max(axis=1), each.sum(axis=1)
            sure = np.divide(top, total, out=np.zeros(len(top)), where=total > 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(each.argmax(axis=1), pa.int32()), pa.array(sure)], [*keep, "slot", "sure"])

    schema = StructType([*rows.select(*keep).schema.fields, StructField("slot", IntegerType()), StructField("sure", DoubleType())])
    return wide.select(*keep, *names).mapInArrow(run, schema)


def physical_ranges(parsed: DataFrame) -> DataFrame:
    """Per property the span (in the common unit) of values whose stated unit is another than the common one,
    counted over all rows: 0.05 % cut off at each end. Labels of the common unit are sometimes wrong, so they
    don't count. One row per property of the fixed list: the size is bounded by it."""
    known = parsed.filter(F.col("stated_unit") != F.col("common_unit")).withColumn("v", common_value(F.col("number"), F.col("stated_unit"), F.col("common_unit")))
    return known.filter("v is not null").groupBy("property").agg(F.percentile_approx("v", [0.0005, 0.5, 0.9995], 20_000).alias("q")).select("property", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def recorded_scales(observations: DataFrame, params: UnitParams = UnitParams(), stated_too: bool = True) -> DataFrame:
    """Every numeric observation with its recorded scale and its value in the common unit.

    Columns: observation_id, property, number, recorded_unit, confidence, common_unit, common_value, review.
    The forest's calibrated choice is the recorded scale where it is sure enough; otherwise the stated (or the
    common) unit stays. ``review`` is true where the forest is unsure of a row without unit, or would rather
    have another scale than the one that stays. With ``stated_too`` false the forest isn't asked about rows that state
    another unit: their scale is the same, but none of them is sent to review. Rows with null property, null or "no value" values don't come out;
    repeated deliveries of one observation come out once each (one_per_observation picks one). An empty table gives an
    empty result; without rows in other units nothing is reassigned and nothing reviewed.
    """
    keep = ["observation_id", "property", "number", "common_unit", "stated_unit", "value_json", "source", "property_group", "method", "ingested_at"]
    parsed = stage(parse_observations(observations).filter("common_unit is not null and number is not null").select(*keep))
    ranges = {r["property"]: (r["low"], r["middle"], r["high"]) for r in physical_ranges(parsed).collect()}  # one row per property of the fixed list
    constants = F.broadcast(_constants(observations.sparkSession, ranges))
    per_scale = [f"{x}{j}" for j in range(_SLOTS) for x in "ufo"]
    base = ["observation_id", "property", "number", "common_unit", "stated_unit", "ingested_at", *per_scale]
    # a stated unit of another kind says nothing about the scale
    stated = F.when(_by_unit(F.col("stated_unit"), "f").isNotNull(), F.col("stated_unit"))
    wide, number = F.lit(params.doubtful), F.col("number")
    slack = (F.col("high") - F.col("low")) * (wide - 1)
    inside = F.when(F.col("additive"), number.between(F.col("low") - slack, F.col("high") + slack)).otherwise(number.between(F.col("low") / wide, F.col("high") * wide))
    use = F.when(F.col("stated_unit") != F.col("common_unit"), "other").when(F.col("stated_unit").isNotNull(), F.when(F.coalesce(inside, F.lit(True)), "common").otherwise("wrong"))
    rows = parsed.join(constants, "property").withColumn("stated_unit", stated).withColumn("_use", use)
    uses = {r["_use"]: r["count"] for r in rows.groupBy("_use").count().collect()}
    n = uses.get("other", 0) + uses.get("common", 0)
    if not ranges or n == 0:
        scored = rows.select(*base).withColumns({"guess": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        share = min(1.0, 1.1 * params.sample_rows / n)
        drawn = rows.filter(F.col("_use").isin("other", "common") & (F.pmod(F.xxhash64("observation_id"), F.lit(1_000_000)) < int(share * 1_000_000))).limit(params.sample_rows)
        # other scales weigh as often as they stand beside the common unit, not as often as they are named
        weight = max(uses.get("wrong", 0), 1) / max(uses.get("common", 0), 1) / (uses.get("other", 0) / max(uses.get("common", 0), 1))
        weigh = F.when(F.col("_use") == "other", min(1.0, weight)).otherwise(1.0).alias("weight")
        label = _by_unit(F.col("stated_unit"), "c").cast("double")
        classes = [f"{x}{j}" for j in range(_SLOTS) for x in "uc"]
        sample = stage(_assembled(drawn, params).select("observation_id", "stated_unit", "features", *classes, weigh, _nominal(label, "label", len(_CLASSES))).coalesce(2))
        fold = F.pmod(F.xxhash64("observation_id", F.lit(params.seed)), F.lit(5))
        forest = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, maxBins=max(64, params.buckets), featureSubsetStrategy="0.7", subsamplingRate=0.7, seed=params.seed, probabilityCol="p", weightCol="weight")
        model = forest.fit(sample.filter(fold != 0).select("features", "label", "weight"))
        told = _choice(model.transform(sample.filter(fold == 0))).select(_step(F.col("sure")).alias("b"), F.col("weight"), (F.col("guess") == F.col("stated_unit")).cast("double").alias("right"))
        seen = {int(r["b"]): (r["right"], r["n"]) for r in told.groupBy("b").agg(F.sum(F.col("right") * F.col("weight")).alias("right"), F.sum("weight").alias("n")).collect()}
        curve = F.array(*[F.lit(x) for x in _calibrate(seen)])
        asked = rows if stated_too else rows.filter("stated_unit is null or stated_unit = common_unit")
        guess = F.when(F.col("slot") == 0, F.col("u0"))
        for j in range(1, _SLOTS):
            guess = guess.when(F.col("slot") == j, F.col(f"u{j}"))
        scored = _scored(asked, params, model, base[:6]).join(constants, "property").select(*base, guess.alias("guess"), curve[_step(F.col("sure"))].alias("confidence"))
        if not stated_too:
            scored = scored.unionByName(rows.filter("stated_unit <> common_unit").select(*base).withColumns({"guess": F.col("stated_unit"), "confidence": F.lit(None).cast("double")}))
    assumed = F.coalesce("stated_unit", "common_unit")
    moved = F.coalesce((assumed == F.col("common_unit")) & (F.col("guess") != assumed) & (F.col("confidence") >= params.confident), F.lit(False))
    unit = F.when(moved, F.col("guess")).otherwise(assumed)
    unsure = F.col("stated_unit").isNull() & (F.col("confidence") < params.confident)
    return scored.select(
        "observation_id", "property", "number", unit.alias("recorded_unit"), "confidence", "common_unit",
        (F.col("number") * _by_unit(unit, "f") + _by_unit(unit, "o")).alias("common_value"),
        F.coalesce((F.col("guess") != unit) | unsure, F.lit(False)).alias("review"), "ingested_at",
    )


def _step(sure: Column) -> Column:
    return F.least(F.floor(sure * 20), F.lit(19)).cast("int")


def _choice(out: DataFrame) -> DataFrame:
    """``guess``: the likeliest of the scales that the row's kind has; ``sure``: its share of their probabilities."""
    each = {f"_p{j}": F.coalesce(F.get("_p", F.coalesce(f"c{j}", F.lit(-1))), F.lit(0.0)) for j in range(_SLOTS)}
    out = out.withColumn("_p", vector_to_array("p")).withColumns(each)
    out = out.withColumns({"_top": F.greatest(*each), "_total": sum((F.col(c) for c in each), F.lit(0.0))})
    guess = F.when(F.col("_p0") == F.col("_top"), F.col("u0"))
    for j in range(1, _SLOTS):
        guess = guess.when(F.col(f"_p{j}") == F.col("_top"), F.col(f"u{j}"))
    return out.withColumns({"guess": guess, "sure": F.when(F.col("_total") > 0, F.col("_top") / F.col("_total")).otherwise(0.0)})


def _calibrate(seen: dict[int, tuple[float, int]]) -> list[float]:
    """Share of right answers by twentieth of the forest's top probability, made monotone by pooling neighbours."""
    blocks: list[list[float]] = []
    for b in range(20):
        right, n = seen.get(b, (0.0, 0))
        prior = (b + 0.5) / 20
        blocks.append([right + prior, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            r, m, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r, blocks[-1][1] + m, blocks[-1][2] + k]
    return [r / m for r, m, k in blocks for _ in range(k)]


def one_per_observation(scales: DataFrame) -> DataFrame:
    """The last delivery of each observation (later ingested_at, then larger number)."""
    cols = [c for c in scales.columns if c != "observation_id"]
    pick = F.max(F.struct("ingested_at", "number", *[c for c in cols if c not in ("ingested_at", "number")])).alias("x")
    return scales.groupBy("observation_id").agg(pick).select("observation_id", *[F.col("x")[c].alias(c) for c in cols])
