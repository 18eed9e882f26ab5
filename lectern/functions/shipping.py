"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

import lectern

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(lectern.__file__).parent
    to = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern_sources.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
