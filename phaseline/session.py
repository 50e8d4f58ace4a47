"""A session with the settings that this engine is written for."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# what workers run is pickled by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def build(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; anything else comes from the cluster or ``conf``."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
