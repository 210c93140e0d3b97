"""Make this package importable for Spark's Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    target = os.path.join(tempfile.mkdtemp(prefix="quill-py-"), f"{root.name}.zip")
    Path(target).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
