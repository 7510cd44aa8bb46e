"""Making the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        fd, path = tempfile.mkstemp(prefix="strandlake-", suffix=".zip")
        with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
            for source in sorted(_PACKAGE.rglob("*.py")):
                z.write(source, str(source.relative_to(_PACKAGE.parent)))
        context.addPyFile(path)
        atexit.register(Path(path).unlink, missing_ok=True)
        _shipped.add(context.applicationId)
    return spark
