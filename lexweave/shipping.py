"""Makes this package importable in Python workers, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends the package's source files to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexweave_shipped", False) or not os.path.isdir(_HERE):
        return
    path = os.path.join(tempfile.mkdtemp(), "lexweave_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_HERE)))
    sc.addPyFile(path)
    sc._lexweave_shipped = True
