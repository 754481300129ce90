"""This package on the Python workers of a cluster, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once an application, unless the workers find it by themselves: by PYTHONPATH, or in the folder that they start in."""
    known = os.environ.get("PYTHONPATH", "").split(":")
    if str(ROOT) in known or os.path.realpath(os.getcwd()) == str(ROOT):
        return
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        base = tempfile.mkdtemp(prefix="skylattice-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{base}/skylattice_code", "zip", ROOT, "skylattice"))
        shutil.rmtree(base)
