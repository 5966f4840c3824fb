"""Further queries: assembly, reports, set operations, validators, asking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, numbers, text
from ..operators import asking, lifecycle
from ..tables import latest, table
from .search import QUESTIONS

_P = "p AS (SELECT DISTINCT id, content_hash, title, company, description, board_id FROM criterion_postings)"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"])


def register(query) -> None:
    @query("""WITH r AS (SELECT id, any_value(places) AS places, any_value(anywhere) AS anywhere, any_value(inferred) AS inferred, any_value(answers) AS answers FROM index_rows GROUP BY id)
SELECT count(*) AS postings, count(*) FILTER (len(places) > 0) AS placed, count(*) FILTER (len([1 FOR p IN places IF p.city IS NOT NULL]) > 0) AS with_city, count(*) FILTER (anywhere) AS anywhere, count(*) FILTER (inferred) AS inferred,
count(*) FILTER (len(answers['arrangement']) = 4) AS arrangement, count(*) FILTER (len(answers['on_call']) = 2) AS on_call, count(*) FILTER (len(answers['on_call']) <> 2 OR len(answers['arrangement']) <> 4) AS unreadable FROM r""")
    def search_build_report(spark: SparkSession, sf: str):
        width = lambda q: F.size(F.try_element_at("answers", F.lit(q)))
        wrong = sum((F.coalesce(width(q) != len(o), F.lit(False)).cast("int") for q, o in QUESTIONS.items()), F.lit(0)) > 0
        return _index(spark, sf).agg(
            F.count("*").alias("postings"), F.count_if(F.size("places") > 0).alias("placed"), F.count_if(F.exists("places", lambda p: p["city"].isNotNull())).alias("with_city"), F.count_if("anywhere").alias("anywhere"),
            F.count_if("inferred").alias("inferred"), *[F.count_if(width(q) == len(o)).alias(q) for q, o in QUESTIONS.items()], F.count_if(wrong).alias("unreadable"),
        )

    @query(f"WITH {_P} SELECT id, sha256(id || coalesce(title, '')) AS mark FROM p WHERE starts_with(id, 'a') OR starts_with(id, 'b2')")
    def prefix_range(spark: SparkSession, sf: str):
        """Postings whose id has one of two prefixes: pushed down to the scan."""
        own = table(spark, sf, "criterion_postings").where(F.startswith("id", F.lit("a")) | F.startswith("id", F.lit("b2")))
        return own.select("id", F.sha2(F.concat("id", F.coalesce("title", F.lit(""))), 256).alias("mark")).distinct()

    @query("SELECT count(*) FILTER (NOT regexp_matches(posting_id, '^[a-z2-7]{16}$')) AS bad_posting_id, count(*) FILTER (NOT regexp_matches(content_hash, '^[0-9a-f]{64}$')) AS bad_hash, count(*) FILTER (kind NOT IN ('posting', 'invalid')) AS bad_kind, count(*) FILTER (kind = 'posting' AND title IS NULL) AS no_title FROM board_listings")
    def listing_violations(spark: SparkSession, sf: str):
        return table(spark, sf, "board_listings").agg(
            F.count_if(~F.col("posting_id").rlike(ids.POSTING_ID)).alias("bad_posting_id"), F.count_if(~F.col("content_hash").rlike("^[0-9a-f]{64}$")).alias("bad_hash"),
            F.count_if(~F.col("kind").isin("posting", "invalid")).alias("bad_kind"), F.count_if((F.col("kind") == "posting") & F.col("title").isNull()).alias("no_title"),
        )

    @query("SELECT company, row_number() OVER (ORDER BY m) - 1 AS code FROM (SELECT company, min(id) AS m FROM index_rows GROUP BY company)")
    def dictionary_codes(spark: SparkSession, sf: str):
        """Codes of companies in order of first appearance by id: the window runs over distinct values only."""
        first = table(spark, sf, "index_rows").groupBy("company").agg(F.min("id").alias("m"))
        return first.select("company", (F.row_number().over(Window.orderBy("m")) - 1).cast("bigint").alias("code"))

    tags = "WITH r AS (SELECT id, any_value(answers['arrangement']) AS d FROM index_rows GROUP BY id), s AS (SELECT id, ['remote', 'hybrid', 'onsite', 'not_stated'][list_position(d, list_max(d))] AS option, list_max(d) AS share FROM r WHERE len(d) = 4)"

    @query(f"{tags} SELECT id, option, CASE WHEN share >= 70 THEN 'likely' ELSE 'maybe' END AS band FROM s WHERE share >= 40")
    def answer_tags(spark: SparkSession, sf: str):
        """The likeliest arrangement of each posting, hidden where it is unlikely."""
        d = F.try_element_at("answers", F.lit("arrangement"))
        best = numbers.likeliest(d)
        rows = _index(spark, sf).where(F.size(d) == 4).select("id", F.get(F.array(*map(F.lit, QUESTIONS["arrangement"])), best).alias("option"), F.get(d, best).alias("share"))
        return rows.select("id", "option", text.confidence_band(F.col("share")).alias("band")).where("band <> 'unlikely'")

    @query(f"{tags} SELECT option, count(*) AS n FROM s GROUP BY option")
    def criterion_facet(spark: SparkSession, sf: str):
        d = F.try_element_at("answers", F.lit("arrangement"))
        option = F.get(F.array(*map(F.lit, QUESTIONS["arrangement"])), numbers.likeliest(d))
        return _index(spark, sf).where(F.size(d) == 4).groupBy(option.alias("option")).agg(F.count("*").alias("n"))

    @query("SELECT source, count(*) AS requests, sum(attempts - 1)::BIGINT AS retries, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM board_crawls) c JOIN (SELECT DISTINCT id, source FROM boards) b ON b.id = c.board_id GROUP BY source")
    def host_stats(spark: SparkSession, sf: str):
        both = lifecycle.once(table(spark, sf, "board_crawls")).join(lifecycle.once(table(spark, sf, "boards")).select(F.col("id").alias("board_id"), "source"), "board_id")
        return both.groupBy("source").agg(F.count("*").alias("requests"), F.sum(F.col("attempts") - 1).alias("retries"), F.sum("bytes").alias("bytes"))

    @query("SELECT 'listed only' AS side, count(*) AS n FROM (SELECT board_id FROM board_listings EXCEPT SELECT board_id FROM criterion_postings) UNION ALL SELECT 'both', count(*) FROM (SELECT board_id FROM board_listings INTERSECT SELECT board_id FROM criterion_postings) UNION ALL SELECT 'any', count(*) FROM (SELECT board_id FROM board_listings UNION SELECT board_id FROM criterion_postings)")
    def board_sets(spark: SparkSession, sf: str):
        a, b = (table(spark, sf, t).select("board_id").distinct() for t in ("board_listings", "criterion_postings"))
        parts = {"listed only": a.join(b, "board_id", "left_anti"), "both": a.join(b, "board_id", "left_semi"), "any": a.unionAll(b).distinct()}
        out = [df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n") for side, df in parts.items()]
        return out[0].unionAll(out[1]).unionAll(out[2])

    @query("SELECT p.id, l.posting_id IS NOT NULL AS listed, l.last_crawl FROM (SELECT DISTINCT id FROM criterion_postings) p LEFT JOIN (SELECT posting_id, max(crawl_id) AS last_crawl FROM board_listings GROUP BY 1) l ON l.posting_id = p.id")
    def postings_with_listing(spark: SparkSession, sf: str):
        last = table(spark, sf, "board_listings").groupBy(F.col("posting_id").alias("id")).agg(F.max("crawl_id").alias("last_crawl"))
        return table(spark, sf, "criterion_postings").select("id").distinct().join(last, "id", "left").select("id", F.col("last_crawl").isNotNull().alias("listed"), "last_crawl")

    @query("SELECT CAST(make_timestamp(started_at * 1000)::DATE AS VARCHAR) AS day, count(DISTINCT id) AS crawls, floor(min(started_at) / 604800000)::BIGINT AS week FROM board_crawls GROUP BY 1")
    def crawls_by_day(spark: SparkSession, sf: str):
        day = F.date_from_unix_date(F.floor(F.col("started_at") / 86_400_000).cast("int"))
        rows = lifecycle.once(table(spark, sf, "board_crawls")).groupBy(day.alias("d")).agg(F.count("*").alias("crawls"), F.floor(F.min("started_at") / 604_800_000).alias("week"))
        return rows.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "crawls", "week")

    @query("SELECT run_id, CASE min(CASE outcome WHEN 'not-found' THEN 1 WHEN 'failed' THEN 2 WHEN 'not-modified' THEN 3 ELSE 4 END) WHEN 1 THEN 'budget' WHEN 2 THEN 'deadline' WHEN 3 THEN 'errors' ELSE 'finished' END AS reason FROM board_crawls GROUP BY run_id")
    def stop_reasons(spark: SparkSession, sf: str):
        """The weightiest reason a run stopped for; outcomes stand for reasons here."""
        reason = F.when(F.col("outcome") == "not-found", "budget").when(F.col("outcome") == "failed", "deadline").when(F.col("outcome") == "not-modified", "errors").otherwise("finished")
        return asking.stop_reason(table(spark, sf, "board_crawls").select("run_id", reason.alias("reason")))

    @query("""WITH u AS (SELECT id, CAST(floor(posted_at / 86400000) AS BIGINT) AS day, len(title) AS cost FROM (SELECT id, any_value(posted_at) AS posted_at, any_value(title) AS title FROM index_rows GROUP BY id)),
s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY day DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM u) SELECT id, cost, spent FROM s WHERE spent + cost <= 3000""")
    def planned_within_allowance(spark: SparkSession, sf: str):
        units = _index(spark, sf).select("id", F.floor(F.col("posted_at") / 86_400_000).alias("day"), F.length("title").cast("bigint").alias("cost"))
        return asking.planned(units, "cost", ["day", "id"], 3000).select("id", "cost", "spent")

    @query(f"WITH {_P}, t AS (SELECT content_hash, min(description) AS d FROM p WHERE content_hash IS NOT NULL AND description IS NOT NULL GROUP BY 1) SELECT content_hash, 'on_call' AS question, (100 - least(100, length(d) // 50))::INT AS no, least(100, length(d) // 50)::INT AS yes FROM t")
    def asked_texts(spark: SparkSession, sf: str):
        """Each distinct text asked once, of a scorer that stands in for a model."""

        def scorer(texts: list[str]) -> list[list[int]]:
            return [[100 - min(100, len(t) // 50), min(100, len(t) // 50)] for t in texts]

        own = table(spark, sf, "criterion_postings").select("content_hash", F.col("description").alias("text"))
        out = asking.asked(own, asking.STANDARD[1], scorer)
        return out.select("content_hash", "question", F.col("distribution")[0].alias("no"), F.col("distribution")[1].alias("yes"))

    @query("SELECT unnest(['arrangement', 'arrangement', 'arrangement', 'arrangement', 'on_call', 'on_call']) AS question, unnest(['remote', 'hybrid', 'onsite', 'not_stated', 'no', 'yes']) AS option, unnest([0, 1, 2, 3, 0, 1])::INT AS place")
    def question_registry(spark: SparkSession, sf: str):
        return asking.registry(spark).select("question", "option", "place")

    @query(f"WITH {_P} SELECT id, length(title) + length(company) + coalesce(length(description), 0) AS chars FROM p")
    def model_states(spark: SparkSession, sf: str):
        """What a scorer is shown of each posting, measured by its parts after a round trip through JSON."""
        state = F.from_json("state", "title string, company string, locations array<string>, description string")
        out = asking.model_state(table(spark, sf, "criterion_postings").dropDuplicates(["id"])).withColumn("s", state)
        return out.select("id", (F.length("s.title") + F.length("s.company") + F.coalesce(F.length("s.description"), F.lit(0))).cast("bigint").alias("chars"))

    @query("SELECT id, answers['on_call'][2] AS yes, posted_at AS at FROM (SELECT id, any_value(answers) AS answers, any_value(posted_at) AS posted_at FROM index_rows GROUP BY id) WHERE answers['on_call'] IS NOT NULL AND posted_at IS NOT NULL")
    def held_answers_merge(spark: SparkSession, sf: str):
        own = _index(spark, sf).where("posted_at IS NOT NULL").select("id", F.try_element_at("answers", F.lit("on_call")).alias("distribution"), F.col("posted_at").alias("at")).where("distribution IS NOT NULL")
        older = own.select("id", F.array(F.lit(50), F.lit(50)).alias("distribution"), (F.col("at") - 1).alias("at"))
        return asking.merged(older, own).select("id", F.try_element_at("distribution", F.lit(2)).alias("yes"), "at")

    @query("SELECT question, count(*) AS asked, avg(tokens) AS mean_tokens FROM (SELECT unnest(['arrangement', 'on_call']) AS question, ceil((octet_length(encode(description)) + 1) / 4.0)::BIGINT AS tokens FROM (SELECT DISTINCT id, description FROM criterion_postings WHERE description IS NOT NULL)) GROUP BY question")
    def enrich_estimate(spark: SparkSession, sf: str):
        own = table(spark, sf, "criterion_postings").select("id", "description").where("description IS NOT NULL").dropDuplicates(["id"])
        each = own.select(F.explode(F.array(*map(F.lit, sorted(QUESTIONS)))).alias("question"), numbers.token_estimate(F.col("description")).alias("tokens"))
        return each.groupBy("question").agg(F.count("*").alias("asked"), F.avg("tokens").alias("mean_tokens"))

