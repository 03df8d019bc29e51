"""The folder that all executors share."""

import re
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Where the setting is missing, a temporary folder stands in for it, in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[[^,]*\]|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tunelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
