"""Helpers that several operators of the package share."""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domicilia.session import materialize as store

_ROOT = Path(__file__).resolve().parents[2]


@lru_cache(maxsize=4)
def _shipped(application: str) -> None:
    spark = SparkSession.getActiveSession()
    folder = Path(tempfile.mkdtemp(prefix="domicilia-code-"))
    shutil.copytree(_ROOT / "domicilia", folder / "domicilia", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "domicilia"), "zip", folder, "domicilia"))


def ship(spark: SparkSession) -> None:
    """Let the executors import the package, once an application; the driver serves the archive."""
    _shipped(spark.sparkContext.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator uses, under its own names; others cannot clash."""
    return frame.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def input_bytes(frame: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it, without running a job."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


__all__ = ["input_bytes", "own", "read", "ship", "store"]
