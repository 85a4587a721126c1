"""Latent features of wide profiles: principal components and partial least squares from distributed moments."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature lists are read by the driver and give a square table of moments, so their length is checked.
MAX_FEATURES = 2_000


def feature_list(long: DataFrame) -> list[str]:
    names = sorted(r[0] for r in long.select("feature").distinct().limit(MAX_FEATURES + 1).collect())
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    return names


def standard_vectors(long: DataFrame, train: DataFrame, names: list[str]) -> DataFrame:
    """(id, x): features in the order of ``names``, standardised by the training rows' mean and population deviation; absent ones 0."""
    s = train.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = long.join(s, "feature").select("id", "feature", ((F.col("value") - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)).alias("z"))
    m = z.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("m"))
    return m.select("id", F.array(*[F.coalesce(F.col("m")[n], F.lit(0.0)) for n in names]).alias("x"))


def pca_scores(train: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, component, score) of ``rows`` on the ``k`` first components of the training vectors (id, x).

    The sign of a component is that of its largest loading. Fewer than two training rows give no rows.
    """
    if train.limit(2).count() < 2:
        return rows.select("id", F.lit(0).alias("component"), F.lit(0.0).alias("score")).limit(0)
    width = train.select(F.size("x")).first()[0]
    model = PCA(k=min(k, width), inputCol="v", outputCol="p").fit(train.select(array_to_vector("x").alias("v")))
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loads.shape[1])]
    out = model.transform(rows.select("id", array_to_vector("x").alias("v"))).select("id", F.posexplode(vector_to_array("p")).alias("component", "s"))
    sign = F.array(*[F.lit(s) for s in signs])
    return out.select("id", (F.col("component") + 1).alias("component"), (F.col("s") * sign[F.col("component")]).alias("score"))


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of (x, y), summed per partition and then over partitions."""

    def run(batches):
        import pandas as pd

        g, c = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                g += x.T @ x
                c += x.T @ b["y"].to_numpy(float)
        yield pd.DataFrame({"i": np.arange(width), "row": list(g), "c": c})

    parts = rows.select("x", "y").mapInPandas(run, "i int, row array<double>, c double")
    summed = parts.select("i", "c", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).collect()
    g, c = np.zeros((width, width)), np.zeros(width)
    for r in summed:
        g[r["i"], r["j"]] = r["v"]
        if r["j"] == 0:
            c[r["i"]] = r["c"]
    return g, c


def pls_rotation(g: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Weights R of PLS1 with scores X R, from X'X and X'y alone (deflating the moments instead of the rows)."""
    g, c = g.copy(), c.copy()
    ws, ps = [], []
    for _ in range(k):
        n = np.linalg.norm(c)
        if n < 1e-9:
            break
        w = c / n
        tt = w @ g @ w
        if tt < 1e-9:
            break
        p = g @ w / tt
        q = c @ w / tt
        g = g - tt * np.outer(p, p)
        c = c - tt * q * p
        ws.append(w)
        ps.append(p)
    if not ws:
        return np.zeros((len(c), 0))
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.inv(p.T @ w)


def pls_scores(train: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, component, score) of ``rows`` (id, x) on components fitted on ``train`` (id, x, y), y centred by its mean."""
    first = train.select(F.size("x").alias("n")).first()
    if first is None:
        return rows.select("id", F.lit(0).alias("component"), F.lit(0.0).alias("score")).limit(0)
    mean = train.agg(F.avg("y")).first()[0]
    r = pls_rotation(*_moments(train.withColumn("y", F.col("y") - F.lit(mean)), first["n"]), k)
    score = lambda j: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in r[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    if not r.shape[1]:
        return rows.select("id", F.lit(0).alias("component"), F.lit(0.0).alias("score")).limit(0)
    return rows.select("id", F.posexplode(F.array(*[score(j) for j in range(r.shape[1])])).alias("component", "score")).select("id", (F.col("component") + 1).alias("component"), "score")
