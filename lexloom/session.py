"""What a session needs so that Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_import(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path, as ``spark.executorEnv.PYTHONPATH`` does.

    On a cluster the package is shipped with the job; a path that is absent there is ignored.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
