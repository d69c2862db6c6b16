"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import stallbook

_SHIPPED = "stallbook.shipped"


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once per session.

    Only the model calls and the corpus operators run Python on executors.
    """
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(stallbook.__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="stallbook-code-"), "stallbook")
    path = shutil.make_archive(archive, "zip", root, "stallbook")
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
