"""Queries on sample profiles: neighbours, weights, estimates and their errors."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from stillhouse.operators import knn as K
from stillhouse.operators import latent as L
from stillhouse.sources.tables import stage, table

TARGETS = ["bulk_property:density_20c", "bulk_property:saturates", "bulk_property:bp_50", "bulk_property:sulfur"]


def _long(spark, d):
    return K.long_profiles(table(spark, d, "sample_profiles"))


def _split(spark, d):
    """Long profiles of the training split, and of the stated query set: other splits' ids divisible by 50."""
    p = table(spark, d, "sample_profiles")
    train = F.lower(F.trim(F.coalesce("split", F.lit("")))) == "train"
    return K.long_profiles(p.filter(train)), K.long_profiles(p.filter(~train & (F.col("profile_id") % 50 == 0)))


def _held_out(spark, d):
    """Staged profiles of the training split, and of all others: errors are measured over every profile held out."""
    p = table(spark, d, "sample_profiles")
    train = F.lower(F.trim(F.coalesce("split", F.lit("")))) == "train"
    return K.staged_profiles([p.filter(train), p.filter(~train)])


def _is_bulk(feature):
    return feature.startswith("bulk_property:")


_LONG = """fl as (select profile_id as id, lower(trim(coalesce(split, ''))) = 'train' as train, unnest(map_entries(features)) as e from sample_profiles),
 lp as (select id, train, feature, max(value) as value from (select id, train, replace(lower(trim(e.key)), ' ', '_') as feature, e.value as value from fl) where value is not null and not isnan(value) group by all),
 h as (select id, feature, value from lp where train), q as (select id, feature, value from lp where not train and id % 50 = 0)"""
_SC = "sc as (select feature, case when stddev_pop(value) > 1e-12 then stddev_pop(value) else greatest(max(abs(value)), 1) end as scale from h group by 1)"
_NEAR = "select * from (select *, row_number() over (partition by query_id order by round(distance, 9), shared desc, id) as rank from {0}) where rank <= {1}"


def profile_features(spark, d):
    g = _long(spark, d).groupBy("feature")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def knn_shared_features(spark, d):
    h, q = _split(spark, d)
    n = K.block_nearest(q, h, 8)
    return n.select("query_id", "id", "rank", "shared", F.round("distance", 6).alias("distance"))


_RELD = "rd as (select q.id as query_id, h.id, sqrt(avg(power((q.value - h.value) / greatest(abs(q.value), abs(h.value), 1), 2))) + 1.0::double / count(*) as distance, count(*) as shared from q join h using (feature) where q.id <> h.id group by 1, 2)"


def knn_scaled(spark, d):
    h, q = _split(spark, d)
    n = K.block_nearest(q, h, 8, K.feature_scales(h, by_size=True))
    return n.select("query_id", "id", "rank", "shared", F.round("distance", 6).alias("distance"))


_SCD = "sd as (select q.id as query_id, h.id, sqrt(avg(power((q.value - h.value) / scale, 2))) + 1.0::double / count(*) as distance, count(*) as shared from q join h using (feature) join sc using (feature) where q.id <> h.id group by 1, 2)"


def feature_target_weights(spark, d):
    h, _ = _split(spark, d)
    w = K.target_weights(h, TARGETS)
    return w.select("target", "feature", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "coverage", "weight")])


_TGT = ", ".join(f"'{t}'" for t in TARGETS)
_W = f"""tt as (select id, feature as target, value as y from h where feature in ({_TGT})), pr as (select tt.id, target, h.feature, h.value, y from tt join h using (id) where h.feature <> target),
 rk as (select *, rank() over (partition by target, feature order by value) + (count(*) over (partition by target, feature, value) - 1) / 2.0::double as rx, rank() over (partition by target, feature order by y) + (count(*) over (partition by target, feature, y) - 1) / 2.0::double as ry from pr),
 tot as (select target, count(*) as total from tt group by 1), wt as (select target, feature, count(*) as n, corr(value, y) as pearson, corr(rx, ry) as spearman, count(*)::double / max(total) as coverage, 0.05::double + (abs(corr(value, y)) + abs(corr(rx, ry))) / 2 * count(*) / max(total) as weight
 from rk join tot using (target) group by 1, 2 having count(*) >= 8 and count(distinct value) >= 2 and count(distinct y) >= 2)"""


def knn_weighted(spark, d):
    """Neighbours with features weighted by their largest correlation with a target, 0.05 where none is known."""
    h, q = _split(spark, d)
    w = K.target_weights(h, TARGETS).groupBy("feature").agg(F.max("weight").alias("weight"))
    n = K.block_nearest(q, h, 8, K.feature_scales(h, by_size=True), w, 0.05)
    return n.select("query_id", "id", "rank", "shared", F.round("distance", 6).alias("distance"))


_WD = "mw as (select feature, max(weight) as weight from wt group by 1), wd as (select q.id as query_id, h.id, sqrt(sum(coalesce(weight, 0.05) * power((q.value - h.value) / scale, 2)) / sum(coalesce(weight, 0.05))) + 1.0::double / count(*) as distance, count(*) as shared from q join h using (feature) join sc using (feature) left join mw using (feature) where q.id <> h.id group by 1, 2)"


def _estimates(spark, d):
    """Targets of the query profiles estimated from neighbours found without the targets."""
    h, q = _split(spark, d)
    hidden = ~F.col("feature").isin(TARGETS)
    n = K.block_nearest(q.filter(hidden), h.filter(hidden), 6, K.feature_scales(h, by_size=True))
    return K.idw_estimates(n, h.filter(~hidden)), q.filter(~hidden)


def idw_property_estimates(spark, d):
    e, _ = _estimates(spark, d)
    return e.select("query_id", "target", "supporters", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high", "mid")])


_EST = f"""md as (select q.id as query_id, h.id, sqrt(avg(power((q.value - h.value) / scale, 2))) + 1.0::double / count(*) as distance, count(*) as shared from q join h using (feature) join sc using (feature) where q.id <> h.id and feature not in ({_TGT}) group by 1, 2), nn as ({_NEAR.format('md', 6)}),
 es as (select query_id, feature as target, sum(value / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)) as estimate, min(value) as low, max(value) as high, quantile_cont(value, 0.5) as mid, count(*) as supporters from nn join h on nn.id = h.id where feature in ({_TGT}) group by 1, 2)"""


def _errors(e, actual, keys):
    return _measured(e.join(actual.select(F.col("id").alias("query_id"), F.col("feature").alias("target"), F.col("value").alias("actual")), ["query_id", "target"]), keys)


def _measured(rows, keys):
    m = K.error_measures(rows, keys)
    return m.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "bias", "median_ae", "max_ae", "range_hit")])


def _is_target(feature):
    return feature.isin(TARGETS) if isinstance(feature, Column) else feature in TARGETS


def holdout_errors(spark, d):
    h, q = _held_out(spark, d)
    known, actual = h.long(), q.long()
    n = K.nearest_profiles(q, h, 6, K.feature_scales(known, by_size=True), hidden=_is_target)
    return _errors(K.idw_estimates(n, known.filter(_is_target(F.col("feature")))), actual.filter(_is_target(F.col("feature"))), ["target"])


def _scenarios():
    """(scenario, target, features that are hidden): the target, or every bulk property."""
    for t in TARGETS:
        yield "other_bulk", [t], lambda feature, t=t: feature == t
    yield "analysis_only", TARGETS, _is_bulk


METHODS = ("idw", "mean", "median")


def _methods():
    """One row per method: inverse distance, mean and median of the supporters."""
    return F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("estimate")) for m in METHODS]))


def _by_method(neighbours, values, scenario, targets):
    """Estimates of each method from one set of neighbours."""
    v = values.filter(F.col("feature").isin(targets)).select("id", F.col("feature").alias("target"), "value")
    w = 1.0 / F.greatest("distance", F.lit(1e-6))
    g = neighbours.join(v, "id").groupBy("query_id", "target").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(w * F.col("value")) / F.sum(w)).alias("idw"), F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median")
    )  # at most six supporters each
    return g.select("query_id", "target", "low", "high", _methods()).withColumn("scenario", F.lit(scenario))


def _grid_errors(h, q, scenarios, keys):
    """Errors over every profile of ``q``, estimated from ``h``, by ``keys``."""
    known = h.long()
    scales = stage(K.feature_scales(known, by_size=True))
    if h.names is not None:
        return _measured(K.supported_values(q, h, 6, scales, scenarios).select("scenario", "target", "actual", "low", "high", _methods()), keys)
    out = None
    for scenario, targets, hidden in scenarios:
        part = _by_method(K.nearest_profiles(q, h, 6, scales, hidden=hidden), known, scenario, targets)
        out = part if out is None else out.unionByName(part)
    return _errors(out, q.long(), keys)


def holdout_grid(spark, d):
    """Errors over all held-out profiles by scenario, method and target."""
    h, q = _held_out(spark, d)
    return _grid_errors(h, q, list(_scenarios()), ["scenario", "method", "target"])


def leave_one_out(spark, d):
    """Errors over all training profiles, each estimated from the others, by method and target, without bulk properties."""
    h, _ = _held_out(spark, d)
    return _grid_errors(h, h, [("analysis_only", TARGETS, _is_bulk)], ["method", "target"])


def top_target_features(spark, d):
    """The 25 heaviest features of each target."""
    h, _ = _split(spark, d)
    w = Window.partitionBy("target").orderBy(F.desc(F.round("weight", 9)), "feature")
    return K.target_weights(h, TARGETS).withColumn("rank", F.row_number().over(w)).filter("rank <= 25").select("target", "rank", "feature", F.round("weight", 6).alias("weight"))


def spaced_holdout(spark, d):
    """Eleven profiles per split spread evenly over the ranks of their density."""
    x = _long(spark, d).filter(F.col("feature") == TARGETS[0]).select(F.col("id").alias("profile_id"), "value")
    p = table(spark, d, "sample_profiles").select("profile_id", F.lower(F.trim(F.coalesce("split", F.lit("")))).alias("split")).distinct().join(x, "profile_id")
    return K.rank_spaced(p, "split", ["value", "profile_id"], 11).select("split", "rank", "profile_id", F.round("value", 6).alias("value"))


def feature_redundancy(spark, d):
    """Pairs of training features with an absolute rank correlation of 0.3 or more over eight profiles or more."""
    h, _ = _split(spark, d)
    a, b = h.select("id", F.col("feature").alias("feature_a"), F.col("value").alias("va")), h.select("id", F.col("feature").alias("feature_b"), F.col("value").alias("vb"))
    p = a.join(b, "id").filter("feature_a < feature_b")
    g = ["feature_a", "feature_b"]
    r = K.average_ranks(K.average_ranks(p, g, "va", "ra"), g, "vb", "rb")
    s = r.groupBy(*g).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("s")).filter("n >= 8 and abs(round(s, 9)) >= 0.3")
    return s.select(*g, "n", F.round("s", 6).alias("spearman"))


def zscore_neighbours(spark, d):
    """Dense neighbours: features standardised over all profiles, absent ones 0, Euclid, five per query."""
    (p,) = K.staged_profiles([table(spark, d, "sample_profiles")])
    r = K.standard_neighbours(p, 5)
    return r.select("query_id", "id", "rank", F.round("distance", 5).alias("distance"))


def property_inventory(spark, d):
    """Profiles with a value per channel and feature."""
    x = _long(spark, d).withColumn("channel", F.substring_index("feature", ":", 1))
    return x.groupBy("channel").agg(F.count("*").alias("values"), F.countDistinct("feature").alias("features"), F.countDistinct("id").alias("profiles"))


def masked_features(spark, d):
    """Features left for each target when it and, in the second scenario, all bulk properties are hidden."""
    x = _long(spark, d)
    out = None
    for t in TARGETS:
        for scenario, keep in (("other_bulk", F.col("feature") != t), ("analysis_only", ~F.col("feature").startswith("bulk_property:"))):
            part = x.filter(keep).agg(F.count("*").alias("values"), F.countDistinct("feature").alias("features")).select(F.lit(t).alias("target"), F.lit(scenario).alias("scenario"), "values", "features")
            out = part if out is None else out.unionByName(part)
    return out


def pca_scores(spark, d):
    """Five principal components of the profiles, fitted on the training split."""
    x = _long(spark, d)
    train, _ = _split(spark, d)
    names = L.feature_list(x)
    t = L.standard_vectors(train, train, names)
    return L.pca_scores(t, L.standard_vectors(x, train, names), 5).withColumn("score", F.round("score", 5))


def pls_scores(spark, d):
    """Four components of the other features towards density, fitted on the training split."""
    target = TARGETS[0]
    x = _long(spark, d)
    train, _ = _split(spark, d)
    rest = x.filter(F.col("feature") != target)
    base = train.filter(F.col("feature") != target)
    names = L.feature_list(rest)
    y = train.filter(F.col("feature") == target).select("id", F.col("value").alias("y"))
    t = L.standard_vectors(base, base, names).join(y, "id")
    return L.pls_scores(t, L.standard_vectors(rest, base, names), 4).withColumn("score", F.round("score", 5))


_ERRORS = "count(*) as n, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(100 * avg(case when actual <> 0 then abs(e) / abs(actual) end), 6) as mape, round(avg(e), 6) as bias, round(quantile_cont(abs(e), 0.5), 6) as median_ae, round(max(abs(e)), 6) as max_ae, round(avg((actual between low and high)::int::double), 6) as range_hit"


def _grid_sql(other: str, cases: list[tuple[str, list[str], str]]) -> str:
    """Estimates of the profiles of ``other`` by (scenario, targets, condition on features)."""
    parts = []
    for scenario, targets, seen in cases:
        names = ", ".join(f"'{t}'" for t in targets)
        dist = f"(select q.id as query_id, h.id, sqrt(avg(power((q.value - h.value) / scale, 2))) + 1.0::double / count(*) as distance, count(*) as shared from {other} q join h using (feature) join sc using (feature) where q.id <> h.id and {seen} group by 1, 2)"
        parts.append(f"select '{scenario}' as scenario, query_id, feature as target, sum(value / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)) as idw, avg(value) as mean, quantile_cont(value, 0.5) as median, min(value) as low, max(value) as high from ({_NEAR.format(dist, 6)}) nn join h on nn.id = h.id where feature in ({names}) group by query_id, feature")
    methods = " union all ".join(f"select scenario, '{m}' as method, query_id, target, {m} as estimate, low, high from g" for m in ("idw", "mean", "median"))
    return f"g as ({' union all '.join(parts)}), es as ({methods}), r as (select es.*, q.value as actual, estimate - q.value as e from es join {other} q on q.id = query_id and q.feature = target)"


_ALL = _LONG.replace(" and id % 50 = 0", "")
_ANALYSIS = "not starts_with(feature, 'bulk_property:')"
_GRID_CASES = [("other_bulk", [t], f"feature <> '{t}'") for t in TARGETS] + [("analysis_only", TARGETS, _ANALYSIS)]

QUERIES = {f.__name__: f for f in (pca_scores, pls_scores, profile_features, knn_shared_features, knn_scaled, knn_weighted, feature_target_weights, feature_redundancy, idw_property_estimates, holdout_errors, holdout_grid, leave_one_out, top_target_features, spaced_holdout, zscore_neighbours, property_inventory, masked_features)}
_OUT = "select query_id, id, rank, shared, round(distance, 6) as distance from ({0})"
SQL = {
    "profile_features": f"with {_LONG} select feature, count(*) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as sd, round(min(value), 6) as low, round(max(value), 6) as high from lp group by 1",
    "knn_shared_features": f"with {_LONG}, {_RELD} " + _OUT.format(_NEAR.format("rd", 8)),
    "knn_scaled": f"with {_LONG}, {_SC}, {_SCD} " + _OUT.format(_NEAR.format("sd", 8)),
    "knn_weighted": f"with {_LONG}, {_SC}, {_W}, {_WD} " + _OUT.format(_NEAR.format("wd", 8)),
    "feature_target_weights": f"with {_LONG}, {_W} select target, feature, n, round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(coverage, 6) as coverage, round(weight, 6) as weight from wt",
    "feature_redundancy": f"with {_LONG}, p as (select a.feature as feature_a, b.feature as feature_b, a.value as va, b.value as vb from h a join h b using (id) where a.feature < b.feature), r as (select *, rank() over (partition by feature_a, feature_b order by va) + (count(*) over (partition by feature_a, feature_b, va) - 1) / 2.0::double as ra, rank() over (partition by feature_a, feature_b order by vb) + (count(*) over (partition by feature_a, feature_b, vb) - 1) / 2.0::double as rb from p) select feature_a, feature_b, count(*) as n, round(corr(ra, rb), 6) as spearman from r group by 1, 2 having count(*) >= 8 and abs(round(corr(ra, rb), 9)) >= 0.3",
    "idw_property_estimates": f"with {_LONG}, {_SC}, {_EST} select query_id, target, supporters, round(estimate, 6) as estimate, round(low, 6) as low, round(high, 6) as high, round(mid, 6) as mid from es",
    "holdout_errors": f"with {_LONG.replace(' and id % 50 = 0', '')}, {_SC}, {_EST}, r as (select es.*, q.value as actual, estimate - q.value as e from es join q on q.id = query_id and q.feature = target) select target, count(*) as n, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(100 * avg(case when actual <> 0 then abs(e) / abs(actual) end), 6) as mape, round(avg(e), 6) as bias, round(quantile_cont(abs(e), 0.5), 6) as median_ae, round(max(abs(e)), 6) as max_ae, round(avg((actual between low and high)::int::double), 6) as range_hit from r group by 1",
    "holdout_grid": f"with {_ALL}, {_SC}, {_grid_sql('q', _GRID_CASES)} select scenario, method, target, {_ERRORS} from r group by 1, 2, 3",
    "leave_one_out": f"with {_ALL}, {_SC}, {_grid_sql('h', _GRID_CASES[-1:])} select method, target, {_ERRORS} from r group by 1, 2",
    "top_target_features": f"with {_LONG}, {_W} select target, rank, feature, round(weight, 6) as weight from (select *, row_number() over (partition by target order by round(weight, 9) desc, feature) as rank from wt) where rank <= 25",
    "spaced_holdout": f"with {_LONG}, p as (select distinct profile_id, lower(trim(coalesce(split, ''))) as split from sample_profiles), r as (select split, profile_id, value, row_number() over (partition by split order by value, profile_id) - 1 as rank, count(*) over (partition by split) as n from p join lp on lp.id = profile_id where feature = '{TARGETS[0]}') select split, rank, profile_id, round(value, 6) as value from r where n <= 11 or exists (select 1 from (select unnest(generate_series(0, 10)) as i) where round_even(i * ((n - 1) / 10.0::double), 0)::bigint = rank)",
    "zscore_neighbours": f"with {_LONG}, st as (select feature, avg(value) as m, stddev_pop(value) as sd from lp group by 1), z as (select id, feature, (value - m) / case when sd > 1e-12 then sd else 1 end as z from lp join st using (feature)), sq as (select id, sum(z * z) as sq from z group by 1), c as (select a.id as query_id, b.id, sum(a.z * b.z) as dot from z a join z b using (feature) where a.id % 50 = 0 and a.id <> b.id group by 1, 2), e as (select query_id, c.id, sqrt(greatest(s.sq + t.sq - 2 * dot, 0)) as distance from c join sq s on s.id = c.id join sq t on t.id = query_id) select query_id, id, rank, round(distance, 5) as distance from (select *, row_number() over (partition by query_id order by round(distance, 6), id) as rank from e) where rank <= 5",
    "property_inventory": f"with {_LONG} select string_split(feature, ':')[1] as channel, count(*) as \"values\", count(distinct feature) as features, count(distinct id) as profiles from lp group by 1",
    "masked_features": f"with {_LONG}, t as (select unnest([{_TGT}]) as target) select target, 'other_bulk' as scenario, count(*) as \"values\", count(distinct feature) as features from lp, t where feature <> target group by 1 union all select target, 'analysis_only', count(*), count(distinct feature) from lp, t where not starts_with(feature, 'bulk_property:') group by 1",
}
