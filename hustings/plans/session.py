"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: sends the package's sources to the executors. Returns the session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="hustings-src-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(p for p in _PACKAGE.rglob("*") if p.suffix in (".py", ".npz", ".json") and "__pycache__" not in p.parts):
                z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
