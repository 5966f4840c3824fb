"""What changed between consecutive full snapshots (problem 5).

A snapshot's rows, sorted by key, are cut into content-defined chunks: a row whose key hash falls
on a boundary opens a chunk, so equal stretches of two snapshots are cut alike wherever rows were
added or removed.  A chunk whose digest also stands in the neighbouring snapshot is discarded
whole; only rows of unmatched chunks are joined and classified.

Everything hangs on one shuffle by (entity, split): duplicates, carried contents, chunking,
matching and classification all find their rows in that partition.  An entity has one split for
each SPLIT_ROWS of its rows, chosen by a hash of the key, so one that holds most rows is spread out
and small ones keep whole chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk on average.
CHUNK_ROWS = 16
#: Rows of an entity, over all its snapshots, that a split holds on average.
SPLIT_ROWS = 500_000


def listed_crawls(crawls: DataFrame) -> DataFrame:
    """id, board_id, seq, next_id of each listed crawl, once; seq counts a board's listings by id."""
    own = crawls.where("outcome = 'listed' AND id IS NOT NULL AND board_id IS NOT NULL").groupBy("id").agg(F.min("board_id").alias("board_id"))
    by = Window.partitionBy("board_id").orderBy("id")
    return own.select("id", "board_id", F.row_number().over(by).alias("seq"), F.lead("id").over(by).alias("next_id"))


def _digest(key: str, content: str) -> tuple[Column, Column, Column]:
    """Of a chunk, whatever the order in which its rows are met: count, sum and xor of two row hashes."""
    h = F.xxhash64(key, F.coalesce(F.col(content), F.lit("")), F.col(content).isNull())
    wide = F.sum((F.xxhash64(F.lit(7), h) / 4).cast("bigint").cast("decimal(38,0)"))
    return F.count("*").alias("n"), F.bit_xor(h).alias("xor"), wide.alias("sum")


def changes(listings: DataFrame, crawls: DataFrame, chunk_rows: int = CHUNK_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """board_id, crawl_id, posting_id, change_kind for each listed crawl of a board but its first.

    ``added``: in this listing, not in the board's previous one.  ``removed``: the reverse; the id is
    the later crawl's.  ``changed``: in both, and the content differs from the last one known; an
    item without content says nothing and carries the last one known on (across listings it is
    missing from, too).  A listed crawl without rows is an empty listing.  Rows of crawls that
    are not listed, and rows with a null crawl or posting id, say nothing.  Rows delivered twice
    count once; of two contents of a posting in one listing the one recorded last counts, then the
    greater.  Null times count as earliest.
    """
    at = listed_crawls(crawls)
    rows = listings.where("crawl_id IS NOT NULL AND posting_id IS NOT NULL").select(
        F.col("crawl_id").alias("id"), "posting_id", F.when(F.col("kind") == "posting", F.col("content_hash")).alias("hash"), "recorded_at"
    )
    sizes = rows.groupBy("id").agg(F.count("*").alias("size"))
    whole = F.coalesce(F.sum("size").over(Window.partitionBy("board_id")), F.lit(0))
    at = at.join(sizes, "id", "left").withColumn("splits", F.ceil((whole + 1) / split_rows)).drop("size")
    rows = rows.join(at, "id").withColumn("split", F.pmod(F.xxhash64(F.lit(5), "posting_id"), "splits")).drop("splits")
    place = ["board_id", "split"]
    rows = rows.repartition(*place)  # the one shuffle of the listings; what follows keeps to it
    latest = F.max(F.when(F.col("hash").isNotNull(), F.struct(F.coalesce("recorded_at", F.lit(-(1 << 62))).alias("t"), "hash")))
    rows = rows.groupBy(*place, "posting_id", "seq", "id", "next_id").agg(latest["hash"].alias("own"))
    before = Window.partitionBy(*place, "posting_id").orderBy("seq")
    rows = rows.withColumn("hash", F.last("own", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))

    opens = F.pmod(F.xxhash64("posting_id"), F.lit(chunk_rows)) == 0
    sorted_ = Window.partitionBy(*place, "seq").orderBy("posting_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.sum(opens.cast("int")).over(sorted_))
    chunks = rows.groupBy(*place, "seq", "id", "next_id", "chunk").agg(*_digest("posting_id", "hash"), F.collect_list(F.struct("posting_id", "hash")).alias("rows"))
    alike = Window.partitionBy(*place, "n", "xor", "sum").orderBy("seq")
    chunks = chunks.withColumns({
        "kept_on": F.coalesce(F.lead("seq").over(alike) == F.col("seq") + 1, F.lit(False)),
        "kept_from": F.coalesce(F.lag("seq").over(alike) == F.col("seq") - 1, F.lit(False)),
    })
    old = (~F.col("kept_on")) & F.col("next_id").isNotNull()
    new = (~F.col("kept_from")) & (F.col("seq") > 1)
    sides = F.array(F.when(old, F.struct(F.col("next_id").alias("crawl_id"), F.lit(False).alias("new"))), F.when(new, F.struct(F.col("id").alias("crawl_id"), F.lit(True).alias("new"))))
    left = chunks.where(old | new).select(*place, "rows", F.explode(F.array_compact(sides)).alias("side")).select(*place, "side.*", F.inline("rows"))
    pairs = left.groupBy(*place, "crawl_id", "posting_id").agg(
        F.count_if(F.col("new")).alias("n_new"), F.count_if(~F.col("new")).alias("n_old"), F.max(F.when(F.col("new"), F.col("hash"))).alias("after"), F.max(F.when(~F.col("new"), F.col("hash"))).alias("prior")
    )
    kind = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(F.col("after") != F.col("prior"), "changed")
    return pairs.select("board_id", "crawl_id", "posting_id", kind.alias("change_kind")).where("change_kind IS NOT NULL")


CHANGES_SQL = """
WITH listed AS (
  SELECT id, board_id, row_number() OVER (PARTITION BY board_id ORDER BY id) AS seq, lead(id) OVER (PARTITION BY board_id ORDER BY id) AS next_id
  FROM (SELECT id, min(board_id) AS board_id FROM board_crawls WHERE outcome = 'listed' GROUP BY id)
), r AS (
  SELECT a.board_id, a.seq, a.id, a.next_id, l.posting_id, arg_max(l.content_hash, coalesce(l.recorded_at, -9223372036854775807)) FILTER (l.kind = 'posting' AND l.content_hash IS NOT NULL) AS own
  FROM board_listings l JOIN listed a ON a.id = l.crawl_id GROUP BY ALL
), f AS (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY board_id, posting_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS h FROM r
)
SELECT n.board_id, n.id AS crawl_id, n.posting_id, CASE WHEN o.posting_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM f n LEFT JOIN f o ON o.board_id = n.board_id AND o.posting_id = n.posting_id AND o.seq = n.seq - 1
WHERE n.seq > 1 AND (o.posting_id IS NULL OR o.h <> n.h)
UNION ALL
SELECT o.board_id, o.next_id, o.posting_id, 'removed'
FROM f o LEFT JOIN f n ON o.board_id = n.board_id AND o.posting_id = n.posting_id AND n.seq = o.seq + 1
WHERE o.next_id IS NOT NULL AND n.posting_id IS NULL
"""
