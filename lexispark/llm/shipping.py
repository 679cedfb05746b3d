"""Makes this package importable for the Python workers of a session."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

import lexispark
from lexispark.session import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package's sources into the shared folder, once for an application, from where Spark gives them to all workers.

    Functions of a module are sent by name, so that what a worker holds (tokenizers, encoded parts) outlives a task.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(lexispark.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_folder(spark), "lexispark", f"code-{uuid.uuid4().hex}", "lexispark.zip"))
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    context.addPyFile(target.toString())
    _shipped.add(context.applicationId)
