"""The package on executors: workers import it by name, so it goes to them once per application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files; again for the same application it does nothing."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="plexum-code-")) / "plexum.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        context.addPyFile(str(target))
    return spark
