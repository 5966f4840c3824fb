"""Structured Streaming over event and crawl streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..tables import remove


def stream_of(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder (or file name pattern) of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, late: str, by: str, value: str) -> DataFrame:
    """window_start, by, n, total of each window; rows later than ``late`` behind the watermark are left out."""
    out = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, time: str, size: str, step: str, late: str, by: str) -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.window(time, size, step).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_within(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Rows delivered again within the watermark are dropped; state is forgotten beyond it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def presence_stream(sightings: DataFrame) -> DataFrame:
    """board_id, posting_id, first_crawl_id, last_crawl_id, version: runs as they grow, from (board_id, posting_id, seq, id, extends_to).

    State is the list of a posting's runs (as many as it was gone and came back).  A sighting joins the runs
    next to it, whenever it comes: a late one closes a gap or opens a run before those known, one delivered
    again changes nothing but how far its crawl extends.  Each trigger gives the runs it touched and, with a
    null last crawl, those that were joined to an earlier one: of each (posting, first crawl) the row of the
    greatest version holds.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        board, posting = key
        version, flat = state.get if state.exists else (0, [])
        version += 1
        runs = [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]  # first and last seq, first crawl, last crawl
        before = set(runs)
        new = [(int(s), int(s), int(i), int(e)) for p in parts for s, i, e in zip(p["seq"], p["id"], p["extends_to"])]
        joined: list[tuple] = []
        for run in sorted(runs + new):
            if joined and run[0] <= joined[-1][1] + 1:
                last = joined[-1]
                joined[-1] = (last[0], max(last[1], run[1]), min(last[2], run[2]), max(last[3], run[3]))
            else:
                joined.append(run)
        state.update((version, [x for run in joined for x in run]))
        rows = [(r[2], r[3]) for r in joined if r not in before] + [(r[2], None) for r in runs if r[2] not in {j[2] for j in joined}]
        if rows:
            first, last = zip(*rows)
            yield pd.DataFrame({"board_id": board, "posting_id": posting, "first_crawl_id": pd.array(first, "Int64"), "last_crawl_id": pd.array(last, "Int64"), "version": version})

    schema = "board_id string, posting_id string, first_crawl_id bigint, last_crawl_id bigint, version bigint"
    return sightings.groupBy("board_id", "posting_id").applyInPandasWithState(step, schema, "version bigint, runs array<bigint>", "append", GroupStateTimeout.NoTimeout)


def latest_runs(grown: DataFrame) -> DataFrame:
    """The runs as the last versions of ``presence_stream`` have them."""
    last = grown.groupBy("board_id", "posting_id", "first_crawl_id").agg(F.max_by("last_crawl_id", "version").alias("last_crawl_id"))
    return last.where("last_crawl_id IS NOT NULL")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs the stream over what is there into files below ``path`` (a shared folder), and reads them.

    Rows are appended, so a window comes out when the watermark has passed its end.
    """
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
