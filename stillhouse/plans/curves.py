"""Queries that read the events of a user as a curve: x the hour since the first of January 2024, y the value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillhouse.operators import curves as V
from stillhouse.sources.tables import table


def _points(spark, d, kind: str | None = None):
    e = table(spark, d, "events")
    if kind:
        e = e.filter(F.col("event_type") == kind)
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select(F.col("user_id").alias("sample"), F.round(us / 3.6e9, 3).alias("x"), F.col("value").cast("double").alias("y"))


def _clean(spark, d, kind=None):
    return V.clean_points(_points(spark, d, kind))


_PTS = "pts as (select user_id as sample, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9::double, 3) as x, value::double as y, event_type from events), cv as (select sample, x, avg(y) as y from pts where x is not null and y is not null group by all)"


def curve_statistics(spark, d):
    s = V.curve_statistics(_clean(spark, d))
    return s.select("sample", "n", *[F.round(c, 4).alias(c) for c in ("x_min", "x_max", "total", "x_mean", "x_peak", "y_q50", "y_q90", "y_q99")])


def curve_weighted_quantiles(spark, d):
    return V.weighted_quantiles(_clean(spark, d), [0.1, 0.25, 0.5, 0.75, 0.9])


def curve_histogram(spark, d):
    return V.weighted_histogram(_clean(spark, d), 32).withColumn("share", F.round("share", 6))


def solvent_excluded(spark, d):
    """Points per sample without a window around hour 100 (8 hours to each side, ends included)."""
    p = V.clean_points(_points(spark, d), (92.0, 108.0))
    return p.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


def peaks_nearest(spark, d):
    """For every purchase the three nearest views of the user within 12 hours."""
    left = _clean(spark, d, "purchase").select("sample", "x")
    right = _clean(spark, d, "view").select("sample", F.col("x").alias("rx"), F.round("y", 6).alias("ry"))
    return V.nearest_within(left, right, 12.0, 3).select("sample", "x", "rx", "ry", F.round("delta", 3).alias("delta"), "rank")


_WINDOWS = [("early", 0.0, 120.0), ("middle", 100.0, 400.0), ("late", 400.0, 720.0)]


def peaks_in_windows(spark, d):
    return V.peaks_in_windows(_clean(spark, d), _WINDOWS, 6).select("sample", "window", "x", F.round("y", 6).alias("y"), "rank")


def peak_pair_gaps(spark, d):
    """Of each sample's two largest peaks in a window: their distance and the ratio of their sizes."""
    p = V.peaks_in_windows(_clean(spark, d), _WINDOWS, 2)
    w = Window.partitionBy("sample", "window").orderBy("x")
    q = p.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).filter("x2 is not null and y > 0")
    return q.select("sample", "window", F.round(F.col("x2") - F.col("x"), 3).alias("gap"), F.round(F.col("y2") / F.col("y"), 6).alias("ratio"))


def curve_on_grid(spark, d):
    """Curves at every twelfth hour from 0 to 720."""
    grid = spark.range(0, 61).select((F.col("id") * 12.0).alias("gx"))
    return V.interpolate(_clean(spark, d), grid).withColumn("gy", F.round("gy", 4))


def channel_shift(spark, d):
    """Mean distance of each user's clicks to the nearest view within 6 hours."""
    left = _clean(spark, d, "click").select("sample", "x")
    right = _clean(spark, d, "view").select("sample", F.col("x").alias("rx"), F.col("y").alias("ry"))
    n = V.nearest_within(left, right, 6.0, 1)
    return n.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rx") - F.col("x")), 4).alias("shift"))


def last_events(spark, d):
    """The last twelve events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 12").select("user_id", "event_id", "r")


def hourly_rollup(spark, d):
    """Events and mean value per hour and type."""
    h = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.date_format(h, "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def session_rollup(spark, d):
    """Sessions of a user that end with a pause of six hours."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) > 6 * 3_600_000_000, 1).otherwise(0)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_us"))


def json_numbers(spark, d):
    """Numbers taken out of the JSON properties, per event type; broken JSON gives none."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.round(F.avg(k), 6).alias("mean_k"), F.max(k).alias("max_k"))


QUERIES = {f.__name__: f for f in (curve_statistics, curve_weighted_quantiles, curve_histogram, solvent_excluded, peaks_nearest, peaks_in_windows, peak_pair_gaps, curve_on_grid, channel_shift, last_events, hourly_rollup, session_rollup, json_numbers)}
_WSQL = "wn as (select * from (values " + ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _WINDOWS) + ') t("window", lo, hi)), pk as (select sample, "window", x, y, row_number() over (partition by sample, "window" order by y desc, x) as rank from cv, wn where x between lo and hi)'
_NEARSQL = "l as (select sample, x from pts where event_type = '{0}' group by all), r as (select sample, x as rx, avg(y) as ry from pts where event_type = 'view' group by all), n as (select l.sample, l.x, rx, ry, abs(l.x - rx) as delta, row_number() over (partition by l.sample, l.x order by abs(l.x - rx), rx) as rank from l join r on l.sample = r.sample and abs(l.x - rx) <= {1})"
SQL = {
    "curve_statistics": f"with {_PTS}, g as (select sample, count(*) as n, min(x) as x_min, max(x) as x_max, sum(abs(y)) as total, sum(x * abs(y)) / sum(abs(y)) as x_mean, first(x order by abs(y) desc, x) as x_peak, quantile_cont(abs(y), 0.5) as y_q50, quantile_cont(abs(y), 0.9) as y_q90, quantile_cont(abs(y), 0.99) as y_q99 from cv group by 1) select sample, n, round(x_min, 4) as x_min, round(x_max, 4) as x_max, round(total, 4) as total, round(x_mean, 4) as x_mean, round(x_peak, 4) as x_peak, round(y_q50, 4) as y_q50, round(y_q90, 4) as y_q90, round(y_q99, 4) as y_q99 from g where total > 0",
    "curve_weighted_quantiles": f"with {_PTS}, p as (select sample, x, sum(abs(y)) over (partition by sample order by x rows unbounded preceding) as upto, sum(abs(y)) over (partition by sample) as total from cv) select sample, " + ", ".join(f"min(case when round(upto - {q}::double * total, 9) >= 0 then x end) as q{round(q * 100):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from p where total > 0 group by 1",
    "curve_histogram": f"with {_PTS}, e as (select sample, min(x) as lo, max(x) as hi, sum(abs(y)) as total from cv group by 1) select sample, least(31, floor((x - lo) / (hi - lo) * 32))::int as bin, round(sum(abs(y)) / max(total), 6) as share from cv join e using (sample) where hi > lo and total > 0 group by 1, 2",
    "solvent_excluded": f"with {_PTS} select sample, count(*) as n, round(sum(y), 4) as total from cv where not (x between 92 and 108) group by 1",
    "peaks_nearest": f"with {_PTS}, {_NEARSQL.format('purchase', 12)} select sample, x, rx, round(ry, 6) as ry, round(delta, 3) as delta, rank from n where rank <= 3",
    "peaks_in_windows": f'with {_PTS}, {_WSQL} select sample, "window", x, round(y, 6) as y, rank from pk where rank <= 6',
    "peak_pair_gaps": f'with {_PTS}, {_WSQL}, q as (select *, lead(x) over w as x2, lead(y) over w as y2 from pk where rank <= 2 window w as (partition by sample, "window" order by x)) select sample, "window", round(x2 - x, 3) as gap, round(y2 / y, 6) as ratio from q where x2 is not null and y > 0',
    "curve_on_grid": f"with {_PTS}, g as (select unnest(generate_series(0, 60)) * 12.0::double as gx), s as (select distinct sample from cv), lo as (select s.sample, gx, max(x) as lx from s, g left join cv on cv.sample = s.sample and cv.x <= gx group by all), hi as (select s.sample, gx, min(x) as rx from s, g left join cv on cv.sample = s.sample and cv.x >= gx group by all) select sample, gx, round(case when lx is null then r.y when rx is null or rx = lx then l.y else l.y + (r.y - l.y) * (gx - lx) / (rx - lx) end, 4) as gy from lo join hi using (sample, gx) left join cv l on l.sample = lo.sample and l.x = lx left join cv r on r.sample = lo.sample and r.x = rx",
    "channel_shift": f"with {_PTS}, {_NEARSQL.format('click', 6)} select sample, count(*) as n, round(avg(rx - x), 4) as shift from n where rank = 1 group by 1",
    "last_events": "select user_id, event_id, r from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 12",
    "hourly_rollup": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2",
    "session_rollup": "with e as (select user_id, event_id, epoch_us(ts) as t from events), n as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) > 21600000000 then 1 else 0 end as new from e), s as (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as session from n) select user_id, session, count(*) as n, max(t) - min(t) as span_us from s group by 1, 2",
    "json_numbers": "select event_type, count(*) as n, count(k) as with_k, round(avg(k), 6) as mean_k, max(k) as max_k from (select event_type, try_cast(json_extract_string(props, '$.k') as double) as k from events) group by 1",
}
