"""Session upkeep: the package on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it wherever the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # workers on this machine, stateful ones too, find it by path
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), sc.environment.get("PYTHONPATH"), os.environ.get("PYTHONPATH")]))
    target = Path(tempfile.mkdtemp(prefix="skysift-ship-")) / "skysift_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
