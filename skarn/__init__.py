"""Spark-native code-graph, merge, diff and semantic-search engine, and training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the session's Python workers, once; where PYTHONPATH has it they find it anyway."""
    here = os.path.dirname(os.path.abspath(__file__))
    context = spark.sparkContext
    if os.path.dirname(here) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_skarn_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="skarn-"), "skarn.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)  # served by the driver: nothing is read from its disk by executors
    context._skarn_shipped = True
