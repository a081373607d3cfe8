"""Getting the library's code to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, once for each context; they need no install or shared folder."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._millrace_shipped = True


def work_folder(spark: SparkSession) -> str:
    """A new folder's place below the one that the driver and all executors share; a session on one machine may use its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="millrace-")
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"
