"""Species counts of a running simulation, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(stream: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, name, n) from a stream of molecules (time, name).

    Rows later than `late` behind the newest time are dropped, so the state holds no more
    windows than fit into that delay.
    """
    windows = stream.withWatermark("time", late).groupBy(F.window("time", every).alias("w"), "name").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), "name", "n")
