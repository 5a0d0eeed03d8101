"""Readers and writers of survey files.  register(spark) makes the formats known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .las import LasSource
from .sbet import SbetSource
from .sdc import SdcSource


def register(spark: SparkSession) -> None:
    for source in (LasSource, SbetSource, SdcSource):
        spark.dataSource.register(source)
