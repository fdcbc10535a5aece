"""All registered queries."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["retrieval", "evaluation", "construction", "cataloguing", "files"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package (they do not inherit the caller's import path)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="resona-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "resona"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def _shipping(run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    query.__doc__ = run.__doc__
    return query


def _modules():
    return [importlib.import_module(f"resona.workload.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _shipping(run) for m in _modules() for key, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for m in _modules() for key, sql in m.SQL.items()}
