"""Ships this package to the executors of a session."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from codexa.staging import shared_dir


def ship(spark: SparkSession) -> str:
    """Writes the package as a zip file to the shared folder and adds it to the session, so that Python workers that have it neither installed nor on their path find it. Returns
    its path; it goes when the session ends."""
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/codexa.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(bytearray(held.getvalue()))
    out.close()
    fs.deleteOnExit(at.getParent())
    spark.sparkContext.addPyFile(str(fs.makeQualified(at)))
    return path
