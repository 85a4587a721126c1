"""Making this package importable in Python workers, wherever the session runs."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the session's workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    # in the cluster's shared folder where it is a mounted one; otherwise Spark itself hands the file to the workers
    folder = Path(shared.removeprefix("file://").removeprefix("file:")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp(prefix="stillhouse-"))
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"stillhouse_modules_{app}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package sent to the workers before."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
