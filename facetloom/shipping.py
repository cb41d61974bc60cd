"""Makes this package importable for Python workers, wherever executors run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    d = tempfile.mkdtemp(prefix="facetloom-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # executors fetch it while the application runs
    name = Path(d) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)
