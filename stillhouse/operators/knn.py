"""Sparse profiles in long form: shared-feature distances, weights, inverse-distance estimates, error measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.operators.block_search import Found, Measure, search, search_all
from stillhouse.sources.tables import stage

#: Up to this many features profiles are compared as dense rows, whose names the driver reads; with more, by a join on the feature.
DENSE_FEATURES = 2_000


def long_profiles(profiles: DataFrame, id_col: str = "profile_id", map_col: str = "features") -> DataFrame:
    """(id, feature, value): one row per finite feature; keys trimmed, lower-cased, blanks as underscores.

    Absent, null and NaN features have no row. Of keys that become the same, the largest value counts.
    """
    x = profiles.select(F.col(id_col).alias("id"), F.explode(map_col).alias("k", "value")).filter(F.col("id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return x.groupBy("id", F.regexp_replace(F.lower(F.trim("k")), " ", "_").alias("feature")).agg(F.max("value").alias("value"))


def feature_scales(train: DataFrame, by_size: bool = False) -> DataFrame:
    """(feature, scale): population deviation of the training values; where it is 0, the largest size (at least 1), or 1."""
    g = train.groupBy("feature").agg(F.stddev_pop("value").alias("sd"), F.max(F.abs("value")).alias("size"))
    other = F.greatest("size", F.lit(1.0)) if by_size else F.lit(1.0)
    return g.select("feature", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(other).alias("scale"))


def shared_feature_distance(queries: DataFrame, history: DataFrame, scales: DataFrame | None = None, weights: DataFrame | None = None, default_weight: float = 1.0) -> DataFrame:
    """(query_id, id, distance, shared): root of the weighted mean squared difference over shared features, plus 1 / shared.

    ``queries`` and ``history`` are long (id, feature, value); a join on the feature, aggregated per pair. Without
    scales the difference is relative to the larger size (at least 1).
    """
    q = queries.select(F.col("id").alias("query_id"), "feature", F.col("value").alias("qv"))
    pairs = history.join(q, "feature").filter(F.col("id") != F.col("query_id"))
    diff = F.col("qv") - F.col("value")
    if scales is None:
        part = diff / F.greatest(F.abs("qv"), F.abs("value"), F.lit(1.0))
    else:
        pairs = pairs.join(scales, "feature")
        part = diff / F.col("scale")
    if weights is not None:
        pairs = pairs.join(weights, "feature", "left").withColumn("w", F.coalesce("weight", F.lit(default_weight)))
    else:
        pairs = pairs.withColumn("w", F.lit(1.0))
    g = pairs.withColumn("p", part).groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("p") * F.col("p")).alias("s"), F.sum("w").alias("sw"), F.count("*").alias("shared"))
    return g.filter("sw > 0").select("query_id", "id", (F.sqrt(F.col("s") / F.col("sw")) + 1.0 / F.col("shared")).alias("distance"), "shared")


def _dense(long: DataFrame, names: list[str]) -> DataFrame:
    """(id, x): one row per profile, null where it lacks a feature; a profile's own features are what is collected."""
    m = long.filter(F.col("feature").isin(names)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return m.select("id", F.transform(F.array(*map(F.lit, names)), lambda n: F.col("m")[n]).alias("x"))


@dataclass(frozen=True)
class Profiles:
    """Staged profiles: dense rows (id, x) over ``names``; beyond DENSE_FEATURES features ``names`` is None and rows are long."""

    names: list[str] | None
    rows: DataFrame

    def long(self) -> DataFrame:
        """(id, feature, value), without a shuffle."""
        if self.names is None:
            return self.rows
        each = self.rows.select("id", F.posexplode("x").alias("at", "value")).filter("value is not null")
        return each.select("id", F.element_at(F.array(*map(F.lit, self.names)), F.col("at") + 1).alias("feature"), "value")


def staged_profiles(parts: list[DataFrame], id_col: str = "profile_id", map_col: str = "features") -> list[Profiles]:
    """Each of ``parts`` as ``long_profiles`` gives it, staged as dense rows over the features of all of them.

    Rows without a finite feature stay, with nulls only. Only rows of an id that stands there several times are shuffled.
    """
    spelled = None
    for p in parts:
        keys = p.select(F.explode(F.map_keys(map_col)).alias("k"))
        spelled = keys if spelled is None else spelled.unionByName(keys)
    plain = F.regexp_replace(F.lower(F.trim("k")), " ", "_").alias("feature")
    found = {r["k"]: r["feature"] for r in spelled.distinct().select("k", plain).limit(8 * DENSE_FEATURES + 1).collect()}
    names = sorted(set(found.values()))
    if len(names) > DENSE_FEATURES or len(found) > 8 * DENSE_FEATURES:
        return [Profiles(None, stage(long_profiles(p, id_col, map_col))) for p in parts]
    place = {n: i for i, n in enumerate(names)}
    place = {k: place[n] for k, n in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, n = batch.column("m"), batch.num_rows
            dense = np.full((n, max(1, len(names))), np.nan)
            offsets = maps.offsets.to_numpy()
            rows = np.repeat(np.arange(n), np.diff(offsets))
            inside = offsets[0], offsets[-1] - offsets[0]
            keys = maps.keys.slice(*inside).dictionary_encode()
            at = np.array([place[k] for k in keys.dictionary.to_pylist()], dtype=np.int64)[keys.indices.to_numpy()]
            values = np.asarray(maps.items.slice(*inside).to_numpy(zero_copy_only=False), dtype=float)
            np.fmax.at(dense, (rows, at), values)  # of several spellings the largest value counts
            x = pa.array(dense.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, dense.shape[1]), pa.int32()), x)], ["id", "x"])

    out = []
    for p in parts:
        p = p.filter(F.col(id_col).isNotNull())
        kind = dict(p.dtypes)[id_col]
        source = p.select(F.col(id_col).alias("id"), F.coalesce(F.col(map_col), F.expr("cast(map() as map<string,double>)")).alias("m"))
        rows = source.mapInArrow(run, f"id {kind}, x array<double>")
        again = source.groupBy("id").count().filter("count > 1").select("id")
        if again.limit(1).count():
            merged = _dense(long_profiles(p.join(again, p[id_col] == again["id"], "left_semi"), id_col, map_col), names)
            rows = rows.join(again, "id", "left_anti").unionByName(merged)
        out.append(Profiles(names, stage(rows)))
    return out


def nearest_profiles(queries: Profiles, history: Profiles, k: int, scales: DataFrame | None = None, weights: DataFrame | None = None, default_weight: float = 1.0, hidden: Callable[[str | Column], bool | Column] | None = None, query_rows: int = 1 << 20, history_rows: int = 65_536) -> DataFrame:
    """The k nearest per query as of ``nearest(shared_feature_distance(...), k)``; features for which ``hidden`` holds aren't compared.

    Blocks of dense rows are read from the shared folder, so that no profile is sent, however many blocks there are. Work is
    queries x history, as for any exact search. Beyond DENSE_FEATURES features the join does it.
    """
    if history.names is None or queries.names != history.names:
        q, h = (x.long() if hidden is None else x.long().filter(~hidden(F.col("feature"))) for x in (queries, history))
        return nearest(shared_feature_distance(q, h, scales, weights, default_weight), k)
    measure = _measure(history.names, scales, weights, default_weight)
    seen = None if hidden is None else np.array([not hidden(n) for n in history.names], dtype=bool)
    return search(queries.rows, history.rows, k, measure, seen, query_rows, history_rows)


def _measure(names: list[str], scales: DataFrame | None, weights: DataFrame | None = None, default_weight: float = 1.0) -> Measure:
    spread = np.ones(len(names))
    if scales is not None:
        by = {r["feature"]: r["scale"] for r in scales.collect()}  # one row per feature
        spread = np.array([by.get(n, np.nan) for n in names], dtype=float)
    heavy = np.full(len(names), default_weight if weights is not None else 1.0)
    if weights is not None:
        by = {r["feature"]: r["weight"] for r in weights.collect()}
        heavy = np.array([by.get(n, default_weight) for n in names], dtype=float)
    return Measure(spread, heavy, relative=scales is None)


def _supported(v: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    """low, high and the estimates of each method per row; ``v`` is NaN where a neighbour has no value, each row has one at least."""
    there = ~np.isnan(v)
    n = there.sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        w = np.where(there, 1.0 / np.maximum(d, 1e-6), 0.0)
        x = np.where(there, v, 0.0)
        in_order = np.sort(v, axis=1)  # NaN last
        middle = [np.take_along_axis(in_order, at[:, None], axis=1)[:, 0] for at in ((n - 1) // 2, n // 2)]
        median = np.where(middle[0] == middle[1], middle[0], (middle[0] + middle[1]) / 2)
        return {"low": in_order[:, 0], "high": np.take_along_axis(in_order, n[:, None] - 1, axis=1)[:, 0], "idw": np.where(w > 0, w * x, 0.0).sum(axis=1) / w.sum(axis=1), "mean": x.sum(axis=1) / n, "median": median}


def supported_values(queries: Profiles, history: Profiles, k: int, scales: DataFrame, scenarios: list[tuple[str, list[str], Callable[[str | Column], bool | Column]]]) -> DataFrame:
    """(scenario, target, actual, low, high, idw, mean, median): for each profile of ``queries`` that has a target's value, what its k
    nearest in ``history`` that have one say; a scenario's hidden features aren't compared.

    All scenarios are searched for in one pass, and neighbours' values are taken where they are found: neither profiles nor
    neighbours are sent. Needs dense profiles of the same features.
    """
    names = history.names
    carry = sorted({names.index(t) for _, targets, _ in scenarios for t in targets if t in names})
    seen = np.array([[not hidden(n) for n in names] for _, _, hidden in scenarios], dtype=bool)
    numbers = ["actual", "low", "high", "idw", "mean", "median"]

    def finish(f: Found) -> pa.RecordBatch:
        out = {c: [] for c in ("scenario", "target", *numbers)}
        for best, (scenario, targets, _) in zip(f.best, scenarios):
            for target in targets:
                if target in names:
                    at = carry.index(names.index(target))
                    v = np.where(np.isfinite(best.key), best.v[:, :, at], np.nan)
                    actual = f.carried[:, at]
                    rows = ~np.isnan(actual) & ~np.isnan(v).all(axis=1)
                    found = {"actual": actual[rows]} | _supported(v[rows], best.d[rows])
                    out["scenario"].append(np.repeat(scenario, rows.sum()))
                    out["target"].append(np.repeat(target, rows.sum()))
                    for c in numbers:
                        out[c].append(found[c])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).tolist(), pa.string()) if c not in numbers else pa.array(np.concatenate(x)) for c, x in out.items()], list(out))

    schema = "scenario string, target string, " + ", ".join(f"{c} double" for c in numbers)
    if not carry:
        return history.rows.sparkSession.createDataFrame([], schema)
    return search_all(queries.rows, history.rows, k, _measure(names, scales), seen, finish, schema, carry)


def block_nearest(queries: DataFrame, history: DataFrame, k: int, scales: DataFrame | None = None, weights: DataFrame | None = None, default_weight: float = 1.0, query_rows: int = 512, history_rows: int = 8_192) -> DataFrame:
    """``nearest_profiles`` of long (id, feature, value) tables, whose rows are made dense first."""
    names = sorted(r[0] for r in history.select("feature").distinct().limit(DENSE_FEATURES + 1).collect())
    if len(names) > DENSE_FEATURES or not names:
        return nearest(shared_feature_distance(queries, history, scales, weights, default_weight), k)
    q, h = (Profiles(names, stage(_dense(x, names))) for x in (queries, history))
    return nearest_profiles(q, h, k, scales, weights, default_weight, None, query_rows, history_rows)


def standard_neighbours(profiles: Profiles, k: int, decimals: int = 6, every: int = 50) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of each id divisible by ``every``. Features are standardised over all
    profiles, absent ones 0; Euclid's distance, ranked as rounded to ``decimals``, ties to the smaller id. Profiles that share no feature don't meet."""
    x = profiles.long()
    st = x.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0))
    if profiles.names is not None:
        by = {r["feature"]: (r["m"], r["sd"]) for r in st.collect()}  # one row per feature
        centre, spread = np.array([by.get(n, (0.0, np.nan)) for n in profiles.names], dtype=float).reshape(-1, 2).T
        return search(stage(profiles.rows.filter(F.col("id") % every == 0)), profiles.rows, k, Measure(spread, np.ones(len(spread)), zeros=True, centre=centre, decimals=decimals)).drop("shared")
    z = x.join(st, "feature").select("id", "feature", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))
    sq = z.groupBy("id").agg(F.sum(F.col("z") * F.col("z")).alias("sq"))
    q = z.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "feature", F.col("z").alias("qz"))
    cross = q.join(z, "feature").groupBy("query_id", "id").agg(F.sum(F.col("qz") * F.col("z")).alias("dot"))
    r = cross.join(sq, "id").join(sq.select(F.col("id").alias("query_id"), F.col("sq").alias("qsq")), "query_id").filter("id <> query_id")
    r = r.withColumn("distance", F.sqrt(F.greatest(F.col("sq") + F.col("qsq") - 2 * F.col("dot"), F.lit(0.0))))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", decimals), "id")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest per query: smaller distance (9 decimals), more shared features, smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), F.desc("shared"), "id")
    return distances.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def idw_estimates(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, target, estimate, low, high, mid, supporters) from neighbours that have a value; weight 1 / max(d, 1e-6)."""
    v = values.select("id", F.col("feature").alias("target"), "value")
    w = 1.0 / F.greatest("distance", F.lit(1e-6))
    return neighbours.join(v, "id").groupBy("query_id", "target").agg(
        (F.sum(w * F.col("value")) / F.sum(w)).alias("estimate"), F.min("value").alias("low"), F.max("value").alias("high"), F.expr("percentile(value, 0.5)").alias("mid"), F.count("*").alias("supporters")
    )


def error_measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, MAE, RMSE, MAPE %, bias, median and largest absolute error, share within the range, per group of ``keys``.

    ``rows`` has actual, estimate, low, high. The relative error leaves actual values of 0 out.
    """
    e = F.col("estimate") - F.col("actual")
    return rows.withColumn("e", e).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (100.0 * F.avg(F.when(F.col("actual") != 0, F.abs("e") / F.abs("actual")))).alias("mape"),
        F.avg("e").alias("bias"), F.expr("percentile(abs(e), 0.5)").alias("median_ae"), F.max(F.abs("e")).alias("max_ae"), F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("double")).alias("range_hit"),
    )


def average_ranks(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Ranks within groups, ties at their average."""
    w = Window.partitionBy(*group)
    ties = Window.partitionBy(*group, value)
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0)


def target_weights(train: DataFrame, targets: list[str], least: int = 8) -> DataFrame:
    """(target, feature, n, pearson, spearman, coverage, weight) of features against targets over shared profiles.

    weight = 0.05 + mean absolute correlation x coverage; pairs with fewer than ``least`` profiles or constant values are left out.
    """
    t = train.filter(F.col("feature").isin(targets)).select("id", F.col("feature").alias("target"), F.col("value").alias("y"))
    pairs = t.join(train, "id").filter(F.col("feature") != F.col("target"))
    total = t.groupBy("target").agg(F.count("*").alias("total"))
    ranked = average_ranks(average_ranks(pairs, ["target", "feature"], "value", "rx"), ["target", "feature"], "y", "ry")
    g = ranked.groupBy("target", "feature").agg(F.count("*").alias("n"), F.corr("value", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.countDistinct("value").alias("dx"), F.countDistinct("y").alias("dy"))
    g = g.filter((F.col("n") >= least) & (F.col("dx") >= 2) & (F.col("dy") >= 2)).join(total, "target")
    mean = (F.abs("pearson") + F.abs("spearman")) / 2.0
    return g.select("target", "feature", "n", "pearson", "spearman", (F.col("n") / F.col("total")).alias("coverage"), (0.05 + mean * F.col("n") / F.col("total")).alias("weight"))


def rank_spaced(rows: DataFrame, group: str, by: list[str], wanted: int) -> DataFrame:
    """``wanted`` rows of each group at evenly spaced ranks (first and last included, halves to even), in the order of ``by``.

    Ranks come from a range sort over group and ``by``, so that no group is held in one task: rows are counted per
    partition of the sort, and a row's rank is its place in its partition plus the group's rows in earlier ones. Groups of
    fewer rows come out whole.
    """
    place = rows.repartitionByRange(*[group, *by]).sortWithinPartitions(group, *by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = place.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(group).orderBy("_part")  # one row per partition of the sort
    before = sizes.select(group, "_part", "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    ranked = place.join(F.broadcast(before), [group, "_part"]).withColumn("rank", (F.col("_at") - F.col("_first") + F.col("_before")).cast("bigint"))
    step = (F.col("_total") - 1) / F.lit(float(max(1, wanted - 1)))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * step).cast("bigint")))
    return ranked.filter((F.col("_total") <= wanted) | F.array_contains(chosen, F.col("rank"))).drop("_part", "_at", "_first", "_before", "_total")
