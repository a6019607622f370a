"""Making the package known to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers, once a session, unless their path already holds it."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(_ROOT.parent) in paths or app in _shipped:
        return
    bundle = Path(tempfile.mkdtemp(prefix="veilspan-code-")) / "veilspan.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for file in sorted(_ROOT.rglob("*.py")):
            out.write(file, file.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _shipped.add(app)
