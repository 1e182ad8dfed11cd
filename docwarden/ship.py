"""Taking the package to the executors of a cluster that does not have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession, *more: str) -> None:
    """Add the package (and ``more`` package folders) to the Python path of all executors, as one zip file.

    Needed once per session where the package is not installed on the executors: functions that run there are
    pickled by name. ``spark-submit --py-files`` or an installed wheel serve as well.
    """
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for root in map(Path, (Path(__file__).parent, *more)):
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="docwarden-")) / "docwarden.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
