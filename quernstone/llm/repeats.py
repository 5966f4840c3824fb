"""Rows delivered twice, made one without a shuffle of long columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: Hashes of repeated rows that may be broadcast (8 bytes each).
BROADCAST_REPEATS = 1_000_000


def once(df: DataFrame) -> DataFrame:
    """The distinct rows: hashes are counted, and only rows whose hash comes twice are compared whole."""
    keyed = df.withColumn("_hash", F.xxhash64(*[f"`{c}`" for c in df.columns]))
    again = cut(keyed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    if again.count() > BROADCAST_REPEATS:
        return df.distinct()
    again = F.broadcast(again)
    rest = keyed.join(again, "_hash", "left_anti").drop("_hash")
    return rest.unionAll(keyed.join(again, "_hash", "left_semi").drop("_hash").distinct())
