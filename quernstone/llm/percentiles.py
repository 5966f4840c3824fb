"""Problem 3: percentiles per group by exact bisection.

Each group and quantile keeps an interval of values.  A pass counts the rows below the interval's
midpoints (several halvings a pass) and narrows it to where the target rank lies; when an interval
is one value, that value is the nearest-rank percentile.  The counts add up, so any rows or
summaries of days or partitions may be combined before or between passes.

A summary keeps counts of values rounded down to ``resolution``; a percentile of summaries is
within one resolution of the exact one, and exact at resolution 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut

#: Halvings a pass does at once.
LEVELS = 11
#: Intervals that may be broadcast; with more, intervals and values meet in a shuffle.
BROADCAST_INTERVALS = 200_000


def summarise(df: DataFrame, groups: Sequence[str], value: str, resolution: int = 1) -> DataFrame:
    """groups, value (rounded down to ``resolution``), n: counts that add up across days and partitions.

    Null values are left out, negative ones count as 0; a null group is a group.
    """
    v = F.greatest(F.col(f"`{value}`"), F.lit(0)).cast("bigint")
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(*groups, (v - v % resolution).alias("value"))
    return rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], quantiles: dict[str, float], value: str = "value", n: str = "n") -> DataFrame:
    """groups, timed, and a column for each of ``quantiles``: nearest rank, over the counted values.

    ``counts`` may hold a value of a group any number of times.  Groups without a value have no row;
    an empty table gives an empty table.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rows = cut(counts.where(F.col(value).isNotNull() & (F.col(n) > 0)).select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("bigint").alias("v"), F.col(n).cast("bigint").alias("n")))
    totals = cut(rows.groupBy(*keys).agg(F.sum("n").alias("timed"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    widest = totals.agg(F.max(F.col("hi") - F.col("lo") + 1), F.count("*")).first()
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("timed") - 1e-9)).cast("bigint").alias("rank")) for name, q in quantiles.items()]))
    state = totals.select(*keys, "lo", "hi", each.alias("x")).select(*keys, "lo", "hi", "x.q", "x.rank")
    small = (widest[1] or 0) * len(quantiles) <= BROADCAST_INTERVALS
    passes = -(-max((widest[0] or 1) - 1, 1).bit_length() // LEVELS)
    for _ in range(passes):
        state = _narrow(rows, state, keys, small)
    wide = state.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == name, F.col("lo"))).alias(name) for name in quantiles])
    same = [wide[k].eqNullSafe(totals[k]) for k in keys]
    out = wide.join(totals, same) if same else wide.crossJoin(totals)  # without groups there is one row
    return out.select(*[wide[k].alias(g) for g, k in zip(groups, keys)], "timed", *quantiles)


def _narrow(rows: DataFrame, state: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """One pass: the rows of each interval are counted between its midpoints, partial counts first."""
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / (1 << LEVELS))).cast("bigint")
    state = state.withColumn("width", width)
    side = F.broadcast(state) if small else state
    other = [F.col(k).alias(f"s_{k}") for k in keys]
    joined = rows.join(side.select(*other, "lo", "hi", "width", "q", "rank"), [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")])
    slots = joined.groupBy(*keys, "q", "lo", "hi", "width", "rank", F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("bigint").alias("slot")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "q").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** LEVELS rows
    slots = slots.withColumn("below", F.sum("n").over(w))
    hit = slots.where((F.col("below") >= F.col("rank")) & (F.col("below") - F.col("n") < F.col("rank")))
    lo = F.col("lo") + F.col("slot") * F.col("width")
    return hit.select(*keys, lo.alias("lo"), F.least(F.col("hi"), lo + F.col("width") - 1).alias("hi"), "q", (F.col("rank") - (F.col("below") - F.col("n"))).alias("rank"))


def samples(df: DataFrame) -> DataFrame:
    """Each sample once: run_id, source, day (of the first sighting), latency_ms.

    Rows delivered twice are one by sample_id; rows without an id are left out.  Where repeats differ the latest sighting counts.
    """
    last = F.max_by(F.struct("run_id", "source", "first_seen_at", "latency_ms"), F.struct("first_seen_at", "latency_ms", "run_id", "source")).alias("s")
    one = df.where("sample_id IS NOT NULL").groupBy("sample_id").agg(last).select("s.*")
    return one.select("run_id", "source", F.to_date("first_seen_at").alias("day"), "latency_ms")


def hours(column: str) -> F.Column:
    """Milliseconds as hours to one decimal, halves up."""
    return (F.floor(F.col(column) / 360000.0 + 0.5) / 10).cast("double").alias(f"{column}_hours")


QUANTILES = {"p50": 0.5, "p95": 0.95}


def by(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, timed, p50_hours, p95_hours of the samples."""
    found = percentiles(summarise(samples(df), groups, "latency_ms"), groups, QUANTILES)
    return found.select(*groups, "timed", hours("p50"), hours("p95"))


def windows(df: DataFrame, days: int = 7, resolution: int = 60_000) -> DataFrame:
    """source, window_end, timed, p50_hours, p95_hours over the ``days`` days that end on each day with samples.

    Days are summarised once, at ``resolution``; windows only combine summaries.
    """
    daily = cut(summarise(samples(df), ["source", "day"], "latency_ms", resolution))
    ends = daily.select("source", F.col("day").alias("window_end")).distinct()
    last = daily.withColumn("window_end", F.explode(F.sequence("day", F.date_add("day", days - 1))))
    last = last.join(ends, [last["source"].eqNullSafe(ends["source"]), last["window_end"] == ends["window_end"]], "left_semi")
    found = percentiles(last, ["source", "window_end"], QUANTILES)
    return found.select("source", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "timed", hours("p50"), hours("p95"))


_ONE = """WITH s AS (
  SELECT sample_id, arg_max(run_id, first_seen_at) AS run_id, arg_max(source, first_seen_at) AS source, max(first_seen_at) AS first_seen_at, greatest(arg_max(latency_ms, first_seen_at), 0) AS v
  FROM freshness_samples WHERE latency_ms IS NOT NULL GROUP BY sample_id
)"""
_HOURS = "count(*) AS timed, floor(quantile_disc(v, 0.5) / 360000.0 + 0.5) / 10 AS p50_hours, floor(quantile_disc(v, 0.95) / 360000.0 + 0.5) / 10 AS p95_hours"
SQL = {
    "p3_by_run": f"{_ONE} SELECT run_id, {_HOURS} FROM s GROUP BY run_id",
    "p3_by_source": f"{_ONE} SELECT source, {_HOURS} FROM s GROUP BY source",
    "p3_overall": f"{_ONE} SELECT {_HOURS} FROM s",
    "p3_windows": f"""{_ONE}, d AS (SELECT source, CAST(first_seen_at AS DATE) AS day, v - v % 60000 AS v FROM s),
  e AS (SELECT DISTINCT source, day AS window_end FROM d)
SELECT e.source, CAST(e.window_end AS VARCHAR) AS window_end, {_HOURS} FROM e JOIN d ON d.source IS NOT DISTINCT FROM e.source AND d.day BETWEEN e.window_end - 6 AND e.window_end GROUP BY e.source, e.window_end""",
}
