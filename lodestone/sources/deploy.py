"""Sending this package to the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Executors get the package's modules once a session, as a zip file by ``addPyFile``."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    context.addPyFile(str(target))
