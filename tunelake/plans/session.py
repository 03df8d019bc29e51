"""Session helpers."""

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..sources.shared import shared_root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def conf(spark: SparkSession, **settings):
    """Set session settings (`_` for `.`) for a while."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
