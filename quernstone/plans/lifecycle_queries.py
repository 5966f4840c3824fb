"""Lifecycle queries over the crawl tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..tables import table

_C = "SELECT DISTINCT * FROM board_crawls WHERE id IS NOT NULL"
_OK = "outcome IN ('listed', 'not-modified')"
#: Presence the long way round: not-modified crawls re-sight each posting of the listing before them.
_SEEN = f"""WITH c AS ({_C}), ok AS (
  SELECT id, board_id, outcome, row_number() OVER (PARTITION BY board_id ORDER BY id) AS n, max(CASE WHEN outcome = 'listed' THEN id END) OVER (PARTITION BY board_id ORDER BY id) AS src FROM c WHERE {_OK}
), item AS (
  SELECT o.board_id, l.crawl_id, l.posting_id, max(CASE WHEN kind = 'posting' AND content_hash IS NOT NULL THEN {{'t': coalesce(recorded_at, -9000000000000000000), 'h': content_hash}} END).h AS h FROM board_listings l JOIN ok o ON o.id = l.crawl_id AND o.outcome = 'listed' GROUP BY ALL
), known AS (
  SELECT *, min(CASE WHEN h IS NOT NULL THEN crawl_id END) OVER (PARTITION BY board_id, posting_id) AS k FROM item
), s AS (
  SELECT ok.board_id, i.posting_id, ok.id, ok.n, ok.outcome, i.h FROM ok JOIN known i ON i.crawl_id = ok.src AND i.board_id = ok.board_id WHERE i.crawl_id >= i.k
), runs AS (
  SELECT board_id, posting_id, min(id) AS first_crawl_id, max(id) AS last_crawl_id
  FROM (SELECT *, n - row_number() OVER (PARTITION BY board_id, posting_id ORDER BY n) AS island FROM s) GROUP BY board_id, posting_id, island
), active AS (SELECT DISTINCT id FROM boards WHERE status = 'active')"""
_BS = "(SELECT DISTINCT id, source FROM boards)"
_SUMS = "count(*) AS crawls, sum(new_count)::BIGINT AS new_postings, sum(changed_count)::BIGINT AS changed_postings"


def register(query) -> None:
    t = lambda spark, sf: {n: table(spark, sf, n) for n in ("board_listings", "board_crawls", "boards")}.values()

    @query(f"{_SEEN} SELECT * FROM runs")
    def presence_runs(spark: SparkSession, sf: str):
        items, crawls, _ = t(spark, sf)
        return L.presence_runs(items, crawls)

    @query(f"{_SEEN} SELECT board_id, posting_id, id AS crawl_id, h AS content_hash FROM (SELECT *, lag(h) OVER (PARTITION BY board_id, posting_id ORDER BY id) AS b FROM s WHERE h IS NOT NULL AND outcome = 'listed') WHERE b <> h")
    def content_changes(spark: SparkSession, sf: str):
        items, crawls, _ = t(spark, sf)
        return L.content_changes(items, crawls)

    @query(f"""{_SEEN} SELECT r.board_id, r.posting_id, max(r.last_crawl_id) AS last_seen FROM runs r JOIN active a ON a.id = r.board_id
JOIN (SELECT board_id, min(id) AS since FROM (SELECT board_id, id, row_number() OVER (PARTITION BY board_id ORDER BY id DESC) AS k FROM c WHERE outcome = 'listed') WHERE k <= 2 GROUP BY board_id) x USING (board_id)
GROUP BY r.board_id, r.posting_id, x.since HAVING max(r.last_crawl_id) >= x.since""")
    def open_postings_within_2(spark: SparkSession, sf: str):
        return L.open_postings(*t(spark, sf))

    @query(f"{_SEEN} SELECT r.board_id, r.posting_id FROM runs r JOIN active a ON a.id = r.board_id JOIN (SELECT board_id, max(id) AS m FROM ok GROUP BY board_id) x ON x.board_id = r.board_id AND r.last_crawl_id = x.m")
    def open_postings_latest_only(spark: SparkSession, sf: str):
        return L.latest_only(*t(spark, sf))

    @query(f"""WITH c AS ({_C}), l AS (SELECT *, coalesce(max(CASE WHEN {_OK} THEN id END) OVER (PARTITION BY board_id), -1) AS ok FROM c), s AS (
  SELECT board_id, count(*) FILTER (id > ok) AS consecutive_failures, count(*) FILTER (id > ok AND outcome = 'not-found') AS not_found_count,
    arg_min(started_at, id) FILTER (id > ok AND outcome = 'not-found') AS not_found_since, arg_max(started_at, id) FILTER (id > ok AND outcome = 'not-found') AS u FROM l GROUP BY board_id)
SELECT board_id, consecutive_failures, not_found_count, not_found_since, coalesce(not_found_count >= 3 AND u - not_found_since >= 172800000, false) AS gone FROM s""")
    def consecutive_failures(spark: SparkSession, sf: str):
        return L.failure_state(table(spark, sf, "board_crawls"))

    @query(f"""WITH c AS ({_C}), x AS (SELECT *, count(*) FILTER ({_OK}) OVER (PARTITION BY board_id ORDER BY id) AS st FROM c), n AS (
  SELECT *, row_number() OVER w AS k, first_value(started_at) OVER w AS since FROM x WHERE outcome = 'not-found' WINDOW w AS (PARTITION BY board_id, st ORDER BY id))
SELECT board_id, min(id) AS crawl_id FROM n WHERE k >= 3 AND started_at - since >= 172800000 GROUP BY board_id""")
    def board_gone(spark: SparkSession, sf: str):
        return L.gone_boards(table(spark, sf, "board_crawls"))

    @query(f"""WITH c AS ({_C}), x AS (SELECT *, count(*) FILTER ({_OK}) OVER (PARTITION BY board_id ORDER BY id) AS st FROM c), n AS (
  SELECT *, row_number() OVER w AS k, first_value(started_at) OVER w AS since FROM x WHERE outcome = 'failed' WINDOW w AS (PARTITION BY board_id, st ORDER BY id))
SELECT board_id, min(id) AS crawl_id FROM n WHERE k >= 2 AND started_at - since >= 3600000 GROUP BY board_id""")
    def board_failing(spark: SparkSession, sf: str):
        """Boards with two failures in a row over an hour: the rule for gone boards with other bounds."""
        return L.gone_boards(table(spark, sf, "board_crawls"), "failed", 2, 3_600_000)

    @query(f"""{_SEEN} SELECT f.board_id, f.posting_id, f.m AS first_seen_crawl FROM (SELECT board_id, posting_id, min(id) AS m FROM s GROUP BY ALL) f
WHERE EXISTS (SELECT 1 FROM c WHERE c.board_id = f.board_id AND c.outcome = 'listed' AND c.id < f.m)""")
    def freshness_excludes_first_listing(spark: SparkSession, sf: str):
        items, crawls, _ = t(spark, sf)
        return L.first_sightings(items, crawls)

    @query(f"WITH c AS ({_C}) SELECT run_id, source, outcome, {_SUMS}, sum(invalid_count)::BIGINT AS invalid, sum(bytes)::BIGINT AS bytes, sum(attempts)::BIGINT AS attempts FROM c JOIN {_BS} b ON b.id = c.board_id GROUP BY run_id, source, outcome")
    def run_summary_by_source(spark: SparkSession, sf: str):
        _, crawls, boards = t(spark, sf)
        return L.run_summary(crawls, boards)

    @query(f"WITH c AS ({_C}) SELECT run_id, coalesce(source, 'All') AS source, {_SUMS} FROM c JOIN {_BS} b ON b.id = c.board_id GROUP BY GROUPING SETS ((run_id, source), (run_id))")
    def run_summary_rollup(spark: SparkSession, sf: str):
        _, crawls, boards = t(spark, sf)
        return L.run_margin(crawls, boards)

    @query(f"WITH c AS ({_C}) SELECT run_id, board_id, id, outcome, http_status, error_code FROM c WHERE NOT ({_OK})")
    def run_failures(spark: SparkSession, sf: str):
        return L.run_failures(table(spark, sf, "board_crawls"))

    @query(f"WITH c AS ({_C}) SELECT run_id, count(*) FILTER ({_OK}) / count(*)::DOUBLE AS rate FROM c GROUP BY run_id")
    def success_rate(spark: SparkSession, sf: str):
        return L.success_rate(table(spark, sf, "board_crawls"))

    @query("SELECT count(*) AS active, coalesce(sum(last_listed_count), 0)::BIGINT AS listed, (SELECT count(DISTINCT posting_id) FROM board_listings) AS postings FROM (SELECT DISTINCT * FROM boards) WHERE status = 'active'")
    def run_totals(spark: SparkSession, sf: str):
        items, _, boards = t(spark, sf)
        return L.totals(boards, items)

    @query(f"""WITH c AS ({_C}), l AS (SELECT board_id, max(id) AS m FROM c WHERE outcome = 'listed' GROUP BY 1), b AS (SELECT DISTINCT id, etag FROM boards)
SELECT b.id AS board_id, CASE WHEN NOT EXISTS (SELECT 1 FROM board_listings i WHERE i.crawl_id = l.m AND i.kind = 'invalid') THEN etag END AS etag FROM b LEFT JOIN l ON l.board_id = b.id""")
    def etags_to_send(spark: SparkSession, sf: str):
        items, crawls, boards = t(spark, sf)
        return L.etags(boards, items, crawls)

    @query("SELECT status, count(DISTINCT id) AS boards FROM boards GROUP BY status")
    def boards_by_status(spark: SparkSession, sf: str):
        return L.once(table(spark, sf, "boards")).groupBy("status").agg(F.count("*").alias("boards"))

    @query("SELECT run_id, min(started_at) AS started_at FROM board_crawls GROUP BY run_id ORDER BY 2 DESC, 1 DESC LIMIT 1")
    def last_run(spark: SparkSession, sf: str):
        runs = table(spark, sf, "board_crawls").groupBy("run_id").agg(F.min("started_at").alias("started_at"))
        return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)

    @query(f"WITH c AS ({_C}) SELECT c.id, listed_count, coalesce(n, 0) AS found FROM c LEFT JOIN (SELECT crawl_id, count(DISTINCT posting_id) AS n FROM board_listings GROUP BY 1) l ON l.crawl_id = c.id WHERE outcome = 'listed' AND listed_count IS DISTINCT FROM coalesce(n, 0)")
    def claimed_counts(spark: SparkSession, sf: str):
        items, crawls, _ = t(spark, sf)
        return L.claimed_counts(items, crawls)

    @query(f"WITH c AS ({_C}) SELECT b.id, max(c.started_at) AS last_attempt, row_number() OVER (ORDER BY max(c.started_at) NULLS FIRST, b.id) AS place FROM (SELECT DISTINCT id FROM boards WHERE status = 'active') b LEFT JOIN c ON c.board_id = b.id GROUP BY b.id QUALIFY place <= 40")
    def crawl_queue(spark: SparkSession, sf: str):
        """The next 40 active boards to crawl: never crawled first, then the least recent."""
        from pyspark.sql import Window

        _, crawls, boards = t(spark, sf)
        last = L.once(crawls).groupBy(F.col("board_id").alias("id")).agg(F.max("started_at").alias("last_attempt"))
        order = [F.col("last_attempt").asc_nulls_first(), F.col("id")]
        top = L.once(boards).where("status = 'active'").select("id").join(last, "id", "left").orderBy(*order).limit(40)
        return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))

    _v = "CASE WHEN latency_ms IS NOT NULL THEN greatest(latency_ms, 0) END"

    @query(f"""WITH s AS (SELECT DISTINCT * FROM freshness_samples WHERE sample_id IS NOT NULL), g AS (SELECT source, {_v} AS v FROM s UNION ALL SELECT 'All', {_v} FROM s)
SELECT source, count(*) AS postings, count(v) AS timed, floor(quantile_disc(v, 0.5) / 360000.0 + 0.5) / 10 AS p50_hours, floor(quantile_disc(v, 0.95) / 360000.0 + 0.5) / 10 AS p95_hours FROM g GROUP BY source""")
    def freshness_by_source(spark: SparkSession, sf: str):
        return L.freshness(table(spark, sf, "freshness_samples"))

    @query("""WITH r AS (SELECT run_id AS name, min(started_at) AS created_at FROM board_crawls GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY name) AS seq FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS newest, floor(created_at / 604800000) AS week FROM n),
w AS (SELECT max(seq) AS seq FROM k GROUP BY week ORDER BY 1 DESC LIMIT 12)
SELECT name, seq, created_at FROM k WHERE newest <= 14 OR seq IN (SELECT seq FROM w)""")
    def snapshot_retention(spark: SparkSession, sf: str):
        from pyspark.sql import Window

        runs = table(spark, sf, "board_crawls").groupBy(F.col("run_id").alias("name")).agg(F.min("started_at").alias("created_at"))
        return L.retained(runs.withColumn("seq", F.row_number().over(Window.orderBy("name")))).select("name", "seq", "created_at")
