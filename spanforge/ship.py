"""Makes the package importable on the executors, however the application was started."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _done:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        path = Path(tempfile.mkdtemp(prefix="spanforge-")) / "spanforge_src.zip"
        path.write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(str(path))  # the driver serves it to the executors
        _done.add(app)
    return spark
