"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package's source to the executors once for each application, by Spark's own file service."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "paperweir.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark
