"""From crawl observations to presence, openness, changes and run reports.

Crawls are ordered by id, never by clock.  A not-modified crawl re-sights what the listing before
it held; it extends presence and is a success, but only listed crawls are evidence of absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import latest

LISTED, SUCCESS = "listed", ("listed", "not-modified")
GONE_AFTER, GONE_SPAN_MS = 3, 48 * 3_600_000
GRACE = 2


def once(df: DataFrame, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """Each key once: of rows that differ the last in ``order``, then that of the greatest hash."""
    return latest(df.where(F.col(key).isNotNull()), [key], list(order))


def listings(crawls: DataFrame) -> DataFrame:
    """id, board_id, seq, extends_to of each listed crawl: the last successful crawl before the next listing."""
    by = Window.partitionBy("board_id").orderBy("id")
    done = once(crawls).where(F.col("outcome").isin(*SUCCESS)).select("id", "board_id", "outcome")
    done = done.withColumn("seq", F.count_if(F.col("outcome") == LISTED).over(by)).where("seq > 0")
    return done.groupBy("board_id", "seq").agg(F.min("id").alias("id"), F.max("id").alias("extends_to"))


def sightings(items: DataFrame, crawls: DataFrame) -> DataFrame:
    """board_id, posting_id, seq, id, extends_to, content_hash: each posting once a listing.

    An invalid item is a sighting of a posting that was known before, without content.  Of several
    contents in one listing the one recorded last counts, of equally late ones the greatest.
    """
    rows = items.where("posting_id IS NOT NULL").select(F.col("crawl_id").alias("id"), "posting_id", F.when(F.col("kind") == "posting", F.col("content_hash")).alias("hash"), F.coalesce("recorded_at", F.lit(-(1 << 62))).alias("t"))
    rows = rows.join(listings(crawls), "id").groupBy("board_id", "posting_id", "seq", "id", "extends_to").agg(F.max(F.when(F.col("hash").isNotNull(), F.struct("t", "hash")))["hash"].alias("content_hash"))
    known = Window.partitionBy("board_id", "posting_id")
    first = F.min(F.when(F.col("content_hash").isNotNull(), F.col("seq"))).over(known)
    return rows.withColumn("known", first).where("seq >= known").drop("known")


def presence_runs(items: DataFrame, crawls: DataFrame) -> DataFrame:
    """board_id, posting_id, first_crawl_id, last_crawl_id: islands over a board's listings, with the crawls that extend them."""
    by = Window.partitionBy("board_id", "posting_id").orderBy("seq")
    islands = sightings(items, crawls).withColumn("island", F.col("seq") - F.row_number().over(by))
    runs = islands.groupBy("board_id", "posting_id", "island").agg(F.min("id").alias("first_crawl_id"), F.max("extends_to").alias("last_crawl_id"))
    return runs.drop("island")


def content_changes(items: DataFrame, crawls: DataFrame) -> DataFrame:
    """board_id, posting_id, crawl_id, content_hash where the content differs from the last known; going back is a change too."""
    by = Window.partitionBy("board_id", "posting_id").orderBy("seq")
    rows = sightings(items, crawls).where("content_hash IS NOT NULL").withColumn("before", F.lag("content_hash").over(by))
    return rows.where("before <> content_hash").select("board_id", "posting_id", F.col("id").alias("crawl_id"), "content_hash")


def open_postings(items: DataFrame, crawls: DataFrame, boards: DataFrame, grace: int = GRACE) -> DataFrame:
    """board_id, posting_id, last_seen of postings of active boards seen in the last ``grace`` listings."""
    last = listings(crawls)
    recency = F.row_number().over(Window.partitionBy("board_id").orderBy(F.col("id").desc()))
    since = last.withColumn("recency", recency).where(F.col("recency") <= grace).groupBy("board_id").agg(F.min("id").alias("since"))
    seen = presence_runs(items, crawls).groupBy("board_id", "posting_id").agg(F.max("last_crawl_id").alias("last_seen"))
    active = once(boards).where("status = 'active'").select(F.col("id").alias("board_id"))
    return seen.join(since.join(active, "board_id"), "board_id").where("last_seen >= since").select("board_id", "posting_id", "last_seen")


def latest_only(items: DataFrame, crawls: DataFrame, boards: DataFrame) -> DataFrame:
    """The stricter notion: present at the board's last successful crawl."""
    last = once(crawls).where(F.col("outcome").isin(*SUCCESS)).groupBy("board_id").agg(F.max("id").alias("at"))
    active = once(boards).where("status = 'active'").select(F.col("id").alias("board_id"))
    runs = presence_runs(items, crawls)
    return runs.join(last.join(active, "board_id"), "board_id").where("last_crawl_id = at").select("board_id", "posting_id")


def failure_state(crawls: DataFrame) -> DataFrame:
    """board_id, consecutive_failures, not_found_count, not_found_since, gone of each board, since its last success.

    Other failures keep the count of not-found answers; gone is the third of them spanning 48 hours.
    """
    one = once(crawls)
    last = one.withColumn("ok", F.max(F.when(F.col("outcome").isin(*SUCCESS), F.col("id"))).over(Window.partitionBy("board_id")))
    since = (F.col("id") > F.coalesce("ok", F.lit(-1)))
    missing = since & (F.col("outcome") == "not-found")
    state = last.groupBy("board_id").agg(
        F.count_if(since).alias("consecutive_failures"), F.count_if(missing).alias("not_found_count"),
        F.min_by(F.when(missing, F.col("started_at")), F.when(missing, F.col("id"))).alias("not_found_since"),
        F.max_by(F.when(missing, F.col("started_at")), F.when(missing, F.col("id"))).alias("until"),
    )
    gone = (F.col("not_found_count") >= GONE_AFTER) & (F.col("until") - F.col("not_found_since") >= GONE_SPAN_MS)
    return state.withColumn("gone", F.coalesce(gone, F.lit(False))).drop("until")


def gone_boards(crawls: DataFrame, outcome: str = "not-found", after: int = GONE_AFTER, span_ms: int = GONE_SPAN_MS) -> DataFrame:
    """board_id, crawl_id at which a board first counts as gone: run lengths within stretches without success."""
    by = Window.partitionBy("board_id").orderBy("id")
    one = once(crawls).withColumn("stretch", F.count_if(F.col("outcome").isin(*SUCCESS)).over(by)).where(F.col("outcome") == outcome)
    inside = Window.partitionBy("board_id", "stretch").orderBy("id")
    run = one.withColumns({"n": F.row_number().over(inside), "since": F.first("started_at").over(inside)})
    hit = run.where((F.col("n") >= after) & (F.col("started_at") - F.col("since") >= span_ms))
    return hit.groupBy("board_id").agg(F.min("id").alias("crawl_id"))


def first_sightings(items: DataFrame, crawls: DataFrame) -> DataFrame:
    """board_id, posting_id, first_seen_crawl of postings a board did not have in its very first listing."""
    first = sightings(items, crawls).groupBy("board_id", "posting_id").agg(F.min("id").alias("first_seen_crawl"))
    start = listings(crawls).where("seq = 1").select("board_id", F.col("id").alias("start"))
    return first.join(start, "board_id").where("start < first_seen_crawl").drop("start")


_SUMS = {"new_postings": "new_count", "changed_postings": "changed_count", "invalid": "invalid_count", "bytes": "bytes", "attempts": "attempts"}


def run_summary(crawls: DataFrame, boards: DataFrame) -> DataFrame:
    """run_id, source, outcome and sums over its crawls."""
    joined = once(crawls).join(once(boards).select(F.col("id").alias("board_id"), "source"), "board_id")
    return joined.groupBy("run_id", "source", "outcome").agg(F.count("*").alias("crawls"), *[F.sum(c).alias(n) for n, c in _SUMS.items()])


def run_margin(crawls: DataFrame, boards: DataFrame) -> DataFrame:
    """run_id, source ("All" for the margin), crawls, new and changed postings."""
    joined = once(crawls).join(once(boards).select(F.col("id").alias("board_id"), "source"), "board_id")
    total = joined.rollup("run_id", "source").agg(F.grouping("run_id").alias("g"), F.grouping("source").alias("s"), F.count("*").alias("crawls"), F.sum("new_count").alias("new_postings"), F.sum("changed_count").alias("changed_postings"))
    return total.where("g = 0").select("run_id", F.when(F.col("s") == 1, "All").otherwise(F.col("source")).alias("source"), "crawls", "new_postings", "changed_postings")


def run_failures(crawls: DataFrame) -> DataFrame:
    return once(crawls).where(~F.col("outcome").isin(*SUCCESS)).select("run_id", "board_id", "id", "outcome", "http_status", "error_code")


def etags(boards: DataFrame, items: DataFrame, crawls: DataFrame) -> DataFrame:
    """board_id, etag to send next: none where the last listing held an invalid item, so that it is read again."""
    last = once(crawls).where(F.col("outcome") == LISTED).groupBy("board_id").agg(F.max("id").alias("crawl_id"))
    bad = items.where("kind = 'invalid'").select("crawl_id").distinct().join(last, "crawl_id", "left_semi").withColumn("bad", F.lit(True))
    both = once(boards).select(F.col("id").alias("board_id"), "etag").join(last, "board_id", "left").join(bad, "crawl_id", "left")
    return both.select("board_id", F.when(F.col("bad").isNull(), F.col("etag")).alias("etag"))


def success_rate(crawls: DataFrame) -> DataFrame:
    """run_id, rate of listed and not-modified crawls; null without any."""
    ok = F.sum(F.col("outcome").isin(*SUCCESS).cast("int"))
    return once(crawls).groupBy("run_id").agg(F.try_divide(ok, F.count("*")).alias("rate"))


def totals(boards: DataFrame, items: DataFrame) -> DataFrame:
    active = once(boards).where("status = 'active'").agg(F.count("*").alias("active"), F.coalesce(F.sum("last_listed_count"), F.lit(0)).alias("listed"))
    return active.crossJoin(items.agg(F.count_distinct("posting_id").alias("postings")))  # one row each


def claimed_counts(items: DataFrame, crawls: DataFrame) -> DataFrame:
    """id, listed_count, found of listed crawls whose claim is missing or differs from their rows."""
    found = items.where("posting_id IS NOT NULL").groupBy(F.col("crawl_id").alias("id")).agg(F.count_distinct("posting_id").alias("found"))
    claims = once(crawls).where(F.col("outcome") == LISTED).select("id", "listed_count")
    both = claims.join(found, "id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where(~F.col("listed_count").eqNullSafe(F.col("found")))


#: Values of a bucket of the first count; no task numbers more than this many, or one a bucket.
BUCKET = 1 << 16


def nearest_ranks(counts: DataFrame, groups: list[str], quantiles: dict[str, float]) -> DataFrame:
    """groups and a column a quantile: nearest rank over (groups, v, n), found by counting.

    Buckets of values are counted first; only the values of the bucket a rank falls in are counted
    one by one.  Counts are partial before each shuffle, so no group is ever held in one place.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.lit(q).alias("p")) for name, q in quantiles.items()]))
    keyed = counts.withColumn("bucket", F.floor(F.col("v") / BUCKET))

    def hit(rows: DataFrame, by: str, rank: Column) -> DataFrame:
        up_to = F.sum("n").over(Window.partitionBy(*groups, "q").orderBy(by))
        found = rows.withColumn("up_to", up_to).withColumn("rank", rank)
        return found.where((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("n") < F.col("rank")))

    total = F.sum("n").over(Window.partitionBy(*groups, "x.q"))
    buckets = keyed.groupBy(*groups, "bucket").agg(F.sum("n").alias("n")).withColumn("x", each)
    buckets = buckets.withColumn("total", total).select(*groups, "x.q", "x.p", "bucket", "n", "total")
    first = hit(buckets, "bucket", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total") - 1e-9)))
    first = first.select(*[F.col(g).alias(f"_{g}") for g in groups], "q", F.col("bucket").alias("_bucket"), (F.col("rank") - F.col("up_to") + F.col("n")).alias("left"))
    inside = keyed.join(first, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("bucket") == F.col("_bucket")])
    inside = inside.groupBy(*groups, "q", "left", "v").agg(F.sum("n").alias("n"))
    return hit(inside, "v", F.col("left")).groupBy(*groups).agg(*[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in quantiles])


def freshness(samples: DataFrame) -> DataFrame:
    """source ("All" for the margin), postings, timed, p50_hours, p95_hours by nearest rank."""
    last = [c for c in ("first_seen_at",) if c in samples.columns]
    one = once(samples.select("sample_id", "source", "latency_ms", *last), "sample_id", tuple(last))
    v = F.when(F.col("latency_ms").isNotNull(), F.greatest("latency_ms", F.lit(0)))
    counts = one.groupBy("source", v.alias("v")).agg(F.count("*").alias("n"))
    margin = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("source").alias("of")), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("of"))))
    both = counts.withColumn("m", margin).select("m.all", "m.of", "v", "n")
    sums = both.groupBy("all", "of").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("timed"))
    ranks = nearest_ranks(both.where("v IS NOT NULL"), ["all", "of"], {"p50": 0.5, "p95": 0.95}).withColumnsRenamed({"all": "_all", "of": "_of"})
    stats = sums.join(ranks, (F.col("all") == F.col("_all")) & F.col("of").eqNullSafe(F.col("_of")), "left")
    hours = lambda c: (F.floor(F.col(c) / 360000.0 + 0.5) / 10).cast("double").alias(f"{c}_hours")
    return stats.select(F.when(F.col("all"), "All").otherwise(F.col("of")).alias("source"), "postings", "timed", hours("p50"), hours("p95"))


def retained(snapshots: DataFrame, daily: int = 14, weekly: int = 12) -> DataFrame:
    """Of (name, seq, created_at): the newest ``daily`` and the newest of each of ``weekly`` weeks."""
    newest = F.row_number().over(Window.orderBy(F.col("seq").desc()))  # one row a snapshot of the store: a small list
    week = F.floor(F.col("created_at") / 604_800_000)
    ranked = snapshots.withColumns({"newest": newest, "week": week})
    first = ranked.withColumn("of_week", F.row_number().over(Window.partitionBy("week").orderBy(F.col("seq").desc())))
    weeks = first.where("of_week = 1").withColumn("nth", F.row_number().over(Window.orderBy(F.col("seq").desc()))).where(F.col("nth") <= weekly)
    kept = ranked.where(F.col("newest") <= max(1, daily)).select("seq").unionAll(weeks.select("seq")).distinct()
    return snapshots.join(kept, "seq", "left_semi")
