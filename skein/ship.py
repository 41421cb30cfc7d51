"""Sends this package to a cluster's executors, where the driver's folders aren't there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def archive(folder: str) -> str:
    """A zip of the package's modules in a folder; its path."""
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, folders, names in os.walk(package):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for name in sorted(names):
                if name.endswith((".py", ".txt")):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path


def ship(spark: SparkSession) -> None:
    """Adds the package to the files of the application, once; Spark copies it to every executor, new ones too.

    Workers of a local session get the package's folder on their path instead.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master == "local" or sc.master.startswith("local["):
        path = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, path)]))
    elif sc.applicationId not in _shipped:
        sc.addPyFile(archive(os.path.realpath(tempfile.mkdtemp(prefix="skein-"))))
        _shipped.add(sc.applicationId)
