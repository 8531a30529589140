"""Puts this package on the executors' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, so that Python workers can import them there."""
    sc = spark.sparkContext
    if getattr(sc, "_qm_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="qm-src-"), "quaymaster_src.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(to)
    sc._qm_shipped = True
