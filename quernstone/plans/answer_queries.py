"""Queries over answers, asking, upserts and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, numbers, text
from ..operators import answers as A
from ..operators import asking
from ..tables import latest, table
from .search import QUESTIONS

WANTED = sorted(QUESTIONS)
OPTIONS = list(QUESTIONS["arrangement"])

_P = "p AS (SELECT DISTINCT id, content_hash FROM criterion_postings WHERE content_hash IS NOT NULL)"
_ANS = f"""{_P}, e AS (SELECT DISTINCT id, posted_at, 'arrangement' AS question, answers['arrangement'] AS d FROM index_rows WHERE answers['arrangement'] IS NOT NULL UNION SELECT id, posted_at, 'on_call', answers['on_call'] FROM index_rows WHERE answers['on_call'] IS NOT NULL),
c AS (SELECT content_hash, question, max({{'t': coalesce(posted_at, -4611686018427387904), 'd': d}}).d AS d FROM e JOIN p USING (id) GROUP BY 1, 2)"""
_UNITS = f"""{_ANS}, h AS (SELECT content_hash, list(question) AS qs FROM c GROUP BY 1), n AS (SELECT content_hash, count(*) AS postings FROM p GROUP BY 1),
u AS (SELECT n.content_hash, n.postings, list_filter(['arrangement', 'on_call'], lambda q: NOT coalesce(list_contains(h.qs, q), false)) AS missing FROM n LEFT JOIN h USING (content_hash))"""
_LABELS = """l AS (SELECT id, any_value(workplace) AS workplace, any_value(answers['arrangement']) AS d FROM index_rows GROUP BY id),
s AS (SELECT id AS posting, coalesce(workplace, '') AS label, d, list_position(['remote', 'hybrid', 'onsite', 'not_stated'], coalesce(workplace, '')) AS t, list_position(d, list_max(d)) AS k, list_max(d) AS confidence FROM l),
j AS (SELECT *, CASE WHEN label = '' THEN 'unlabelled' WHEN t IS NULL OR t = 0 THEN 'invalid' WHEN d IS NULL OR len(d) <> 4 THEN 'unanswered' ELSE 'compared' END AS state FROM s),
r AS (SELECT *, k = t AS ok, d[t] AS truth, list_sum([power(d[i] / 100.0 - CASE WHEN i = t THEN 1 ELSE 0 END, 2) FOR i IN range(1, 5)]) AS b FROM j WHERE state = 'compared')"""


def _postings(spark: SparkSession, sf: str):
    return table(spark, sf, "criterion_postings").select("id", "content_hash", "description")


def _contents(spark: SparkSession, sf: str):
    return A.by_content(_postings(spark, sf), table(spark, sf, "index_rows").select("id", "answers", F.col("posted_at").alias("at")))


def _judged(spark: SparkSession, sf: str):
    rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"])
    labels = rows.select(F.col("id").alias("posting"), F.coalesce("workplace", F.lit("")).alias("option"))
    return A.judged(labels, rows.select(F.col("id").alias("posting"), F.try_element_at("answers", F.lit("arrangement")).alias("distribution")), OPTIONS)


def register(query) -> None:
    @query(f"WITH {_ANS} SELECT content_hash, question, array_to_string(d, ',') AS distribution FROM c")
    def answers_by_content(spark: SparkSession, sf: str):
        maps = A.answer_maps(_contents(spark, sf))
        return maps.select("content_hash", F.explode("answers").alias("question", "d")).select("content_hash", "question", F.array_join(F.col("d").cast("array<string>"), ",").alias("distribution"))

    @query(f"WITH {_ANS} SELECT p.id, question, array_to_string(d, ',') AS distribution FROM p JOIN c USING (content_hash)")
    def repost_fanout(spark: SparkSession, sf: str):
        out = A.fan_out(_postings(spark, sf), _contents(spark, sf))
        return out.withColumn("distribution", F.array_join(F.col("distribution").cast("array<string>"), ","))

    @query(f"WITH {_ANS} SELECT count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.content_hash = p.content_hash AND question = 'arrangement') OR NOT EXISTS (SELECT 1 FROM c WHERE c.content_hash = p.content_hash AND question = 'on_call')")
    def unanswered_count(spark: SparkSession, sf: str):
        return A.unanswered(_postings(spark, sf), _contents(spark, sf), WANTED).agg(F.count("*").alias("n"))

    @query(f"""WITH {_ANS}, f AS (SELECT posting_id AS id, min(recorded_at) AS first_seen_at FROM board_listings WHERE posting_id IS NOT NULL GROUP BY 1)
SELECT p.id, f.first_seen_at FROM p LEFT JOIN f ON f.id = p.id WHERE (SELECT count(*) FROM c WHERE c.content_hash = p.content_hash) < 2 ORDER BY f.first_seen_at DESC NULLS LAST, p.id LIMIT 100""")
    def unanswered_queue(spark: SparkSession, sf: str):
        """The 100 newest postings that lack an answer."""
        seen = table(spark, sf, "board_listings").where("posting_id IS NOT NULL").groupBy(F.col("posting_id").alias("id")).agg(F.min("recorded_at").alias("first_seen_at"))
        todo = A.unanswered(_postings(spark, sf), _contents(spark, sf), WANTED).select("id")
        return todo.join(seen, "id", "left").orderBy(F.desc_nulls_last("first_seen_at"), "id").limit(100)

    @query(f"WITH {_UNITS} SELECT content_hash, postings, array_to_string(missing, ',') AS missing FROM u")
    def ask_units_by_text(spark: SparkSession, sf: str):
        return A.units(_postings(spark, sf), _contents(spark, sf), WANTED).withColumn("missing", F.array_join("missing", ","))

    @query(f"""WITH {_UNITS}, x AS (SELECT u.*, coalesce(ceil((octet_length(encode(t)) + 1) / 4.0)::BIGINT, 0) AS tokens FROM u LEFT JOIN (SELECT content_hash, min(description) AS t FROM criterion_postings GROUP BY 1) USING (content_hash))
SELECT sum(postings)::BIGINT AS postings, count(*) AS texts, (sum(postings) * 2)::BIGINT AS wanted, sum(postings * (2 - len(missing)))::BIGINT AS cached, count(*) FILTER (len(missing) > 0) AS to_ask, sum(tokens) FILTER (len(missing) > 0)::BIGINT AS tokens, sum(tokens * 42) FILTER (len(missing) > 0)::BIGINT AS cost FROM x""")
    def ask_estimate(spark: SparkSession, sf: str):
        own = _postings(spark, sf)
        texts = own.groupBy("content_hash").agg(F.min("description").alias("text"))
        return A.estimate(A.units(own, _contents(spark, sf), WANTED), texts, len(WANTED))

    _len = "least(100, length(t) // 50)::INT"

    @query(f"""WITH {_UNITS}, x AS (SELECT u.*, t FROM u JOIN (SELECT content_hash, min(description) AS t FROM criterion_postings GROUP BY 1) USING (content_hash) WHERE t IS NOT NULL), y AS (SELECT content_hash, unnest(missing) AS question, t FROM x)
SELECT content_hash, question, CASE WHEN question = 'on_call' THEN CAST(100 - {_len} AS VARCHAR) || ',' || CAST({_len} AS VARCHAR) WHEN {_len} < 90 THEN CAST(100 - {_len} AS VARCHAR) || ',' || CAST({_len} AS VARCHAR) || ',0,0' END AS distribution, false AS stopped FROM y""")
    def asked_missing(spark: SparkSession, sf: str):
        """Each text asked once for all it lacks, of a scorer that stands in for a model and gives some unreadable answers."""

        def scorer(text: str, questions: list[str]) -> dict[str, list[int]]:
            n = min(100, len(text) // 50)
            return {q: [100 - n, n] if q == "on_call" else [100 - n, n, 0, 0] if n < 90 else [100 - n, n] for q in questions}

        own = _postings(spark, sf)
        texts = own.groupBy("content_hash").agg(F.min("description").alias("text"))
        out = asking.asked_together(A.units(own, _contents(spark, sf), WANTED).join(texts, "content_hash"), asking.STANDARD, scorer)
        return out.withColumn("distribution", F.array_join(F.col("distribution").cast("array<string>"), ","))

    @query("""WITH u AS (SELECT id, any_value(floor(posted_at / 86400000))::BIGINT AS day, len(any_value(title)) AS cost, len(any_value(company)) AS used FROM index_rows WHERE posted_at IS NOT NULL GROUP BY id),
g AS (SELECT *, greatest(0, least(cost, 100 - coalesce(sum(cost) OVER (PARTITION BY day ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM u)
SELECT day, sum(granted)::BIGINT AS reserved, sum(least(granted, used))::BIGINT AS committed, sum(granted - least(granted, used))::BIGINT AS released FROM g GROUP BY day""")
    def daily_spend(spark: SparkSession, sf: str):
        """A limit of each day: what is reserved under it, what of that is used and what goes back."""
        rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"]).where("posted_at IS NOT NULL")
        units = rows.select("id", F.floor(F.col("posted_at") / 86_400_000).alias("day"), F.length("title").cast("bigint").alias("cost"), F.length("company").cast("bigint").alias("used"))
        return A.settled(A.grants(units, "day", "id", "cost", 100), "day", "used")

    @query("WITH q AS (SELECT DISTINCT left(id, 10) AS prefix FROM index_rows), i AS (SELECT DISTINCT id FROM criterion_postings) SELECT prefix, min(id) AS id FROM q JOIN i ON starts_with(id, prefix) GROUP BY prefix HAVING count(*) = 1")
    def prefix_resolution(spark: SparkSession, sf: str):
        asked = table(spark, sf, "index_rows").select(F.left("id", F.lit(10)).alias("prefix"))
        return A.resolve_prefixes(asked, table(spark, sf, "criterion_postings"))

    @query("SELECT min(n) AS length FROM (SELECT n, count(DISTINCT left(id, n)) AS k, count(DISTINCT id) AS d FROM (SELECT DISTINCT posting_id AS id FROM board_listings), range(10, 17) t(n) GROUP BY n) WHERE k = d")
    def shortest_unique_prefix(spark: SparkSession, sf: str):
        out = A.shortest_prefix(table(spark, sf, "board_listings").select(F.col("posting_id").alias("id")).where("id IS NOT NULL"))
        return out.select(F.col("length").cast("bigint").alias("length"))

    count = lambda s: f"(SELECT count(*) FROM j WHERE state = '{s}') AS {s}"

    @query(f"WITH {_LABELS} SELECT {', '.join(map(count, ('compared', 'unlabelled', 'invalid', 'unanswered')))}, round(avg(ok::INT), 9) AS accuracy, round(avg(truth) / 100, 9) AS mean_truth, round(avg(b), 9) AS brier FROM r")
    def accuracy_scores(spark: SparkSession, sf: str):
        out = A.scores(_judged(spark, sf))
        return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "mean_truth", "brier")})

    @query(f"WITH {_LABELS} SELECT least(floor(confidence / 10), 9)::INT AS bucket, count(*) AS n, round(avg(confidence) / 100, 9) AS confidence, round(avg(ok::INT), 9) AS accuracy FROM r GROUP BY 1")
    def calibration_buckets(spark: SparkSession, sf: str):
        return A.calibration(_judged(spark, sf)).withColumns({c: F.round(c, 9) for c in ("confidence", "accuracy")})

    @query(f"WITH {_LABELS}, k AS (SELECT count(*) AS n, avg(confidence) / 100 AS c, avg(ok::INT) AS a FROM r GROUP BY least(floor(confidence / 10), 9)) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS calibration_error FROM k")
    def calibration_error(spark: SparkSession, sf: str):
        return A.calibration_error(_judged(spark, sf)).withColumn("calibration_error", F.round("calibration_error", 9))

    @query(f"WITH {_LABELS} SELECT t AS threshold, round(count(*) FILTER (confidence >= t) / count(*)::DOUBLE, 9) AS coverage, round(coalesce(avg(ok::INT) FILTER (confidence >= t), 'nan'::DOUBLE), 9) AS accuracy FROM (SELECT confidence, ok FROM r), (SELECT unnest([50, 60, 70, 80, 90]) AS t) GROUP BY 1")
    def threshold_sweep(spark: SparkSession, sf: str):
        return A.threshold_sweep(_judged(spark, sf)).withColumns({c: F.round(c, 9) for c in ("coverage", "accuracy")})

    @query(f"WITH {_LABELS} SELECT posting, label, ['remote', 'hybrid', 'onsite', 'not_stated'][k] AS picked, confidence FROM r WHERE NOT ok")
    def disagreements(spark: SparkSession, sf: str):
        return A.disagreements(_judged(spark, sf), OPTIONS)

    @query("SELECT board_id, id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY id DESC) AS n FROM board_crawls) WHERE n = 1")
    def upsert_latest(spark: SparkSession, sf: str):
        """The last crawl of each board, as listed crawls are overwritten by later ones of any outcome."""
        crawls = table(spark, sf, "board_crawls").select("board_id", "id", "outcome")
        return A.upsert_latest(crawls.where("outcome = 'listed'"), crawls.where("outcome <> 'listed'"), ["board_id"], ["id"])

    @query("SELECT id, version, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, source) AS n FROM (SELECT DISTINCT id, CASE WHEN anywhere THEN 2 ELSE 1 END AS version, 'existing' AS source FROM index_rows UNION ALL SELECT DISTINCT id, CASE WHEN length(title) % 2 = 0 THEN 2 ELSE 1 END, 'incoming' FROM criterion_postings)) WHERE n = 1")
    def upsert_newer_version(spark: SparkSession, sf: str):
        old = table(spark, sf, "index_rows").select("id", F.when(F.col("anywhere"), 2).otherwise(1).alias("version"), F.lit("existing").alias("source")).distinct()
        new = table(spark, sf, "criterion_postings").select("id", F.when(F.length("title") % 2 == 0, 2).otherwise(1).alias("version"), F.lit("incoming").alias("source")).distinct()
        return A.upsert_newer(old, new, ["id"], "version")

    @query("SELECT run_id, min(started_at) AS started_at, max(finished_at) AS finished_at, sum(attempts)::BIGINT AS attempts, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM board_crawls) GROUP BY run_id")
    def accumulate_runs(spark: SparkSession, sf: str):
        return A.accumulate(table(spark, sf, "board_crawls").dropDuplicates(["id"]), ["run_id"], ["attempts", "bytes"], "started_at", "finished_at")

    @query("""WITH e AS (SELECT DISTINCT id, status AS was FROM boards), s AS (SELECT DISTINCT board_id AS id FROM board_listings WHERE kind = 'invalid' OR company LIKE '%Labs'), d AS (SELECT DISTINCT id FROM boards WHERE country IS NULL),
a AS (SELECT coalesce(e.id, s.id, d.id) AS id, was, s.id IS NOT NULL AS seed, d.id IS NOT NULL AS no FROM e FULL JOIN s ON s.id = e.id FULL JOIN d ON d.id = coalesce(e.id, s.id)),
x AS (SELECT *, CASE WHEN no THEN CASE WHEN was IS NULL THEN 'ignored' WHEN was = 'denied' THEN 'kept' ELSE 'denied' END WHEN seed THEN CASE WHEN was IS NULL THEN 'added' WHEN was = 'active' THEN 'kept' ELSE 'reactivated' END WHEN was = 'active' THEN 'retired' ELSE 'kept' END AS action FROM a)
SELECT id, action, CASE WHEN action IN ('added', 'reactivated') THEN 'active' WHEN action IN ('denied', 'retired') THEN action ELSE was END AS status FROM x WHERE action <> 'ignored'""")
    def board_sync(spark: SparkSession, sf: str):
        boards = table(spark, sf, "boards").select("id", "status", "country").distinct()
        seeds = table(spark, sf, "board_listings").where("kind = 'invalid' OR company LIKE '%Labs'").select(F.col("board_id").alias("id"))
        return A.sync(boards, seeds, boards.where("country IS NULL"))

    @query("""WITH c AS (SELECT DISTINCT * FROM board_crawls), b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT id, run_id, greatest(0, least(bytes, 5000000 - before))::BIGINT AS granted FROM b""")
    def capped_grants(spark: SparkSession, sf: str):
        crawls = table(spark, sf, "board_crawls").dropDuplicates(["id"]).select("id", "run_id", "bytes")
        return A.grants(crawls, "run_id", "id", "bytes", 5_000_000).select("id", "run_id", "granted")

    shares = "[(v * 1.0) / s * 100.0 FOR v IN vs]"

    @query(f"""WITH r AS (SELECT id, [pay.pay_min, pay.pay_max, length(title)::DOUBLE] AS vs FROM (SELECT DISTINCT * FROM index_rows) WHERE pay.pay_min > 0 AND pay.pay_max > 0), s AS (SELECT *, vs[1] + vs[2] + vs[3] AS s FROM r),
f AS (SELECT id, {shares} AS x FROM s), g AS (SELECT id, x, 100 - list_sum([floor(v) FOR v IN x]) AS spare FROM f),
o AS (SELECT id, i, x[i] AS v, spare, row_number() OVER (PARTITION BY id ORDER BY x[i] - floor(x[i]) DESC, i) AS k FROM g, range(1, 4) t(i))
SELECT id, string_agg(CAST(CAST(floor(v) + CASE WHEN k <= spare THEN 1 ELSE 0 END AS INT) AS VARCHAR), ',' ORDER BY i) AS shares FROM o GROUP BY id""")
    def distribution_hundredths(spark: SparkSession, sf: str):
        rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"]).where("pay.pay_min > 0 AND pay.pay_max > 0")
        return rows.select("id", F.array_join(numbers.hundredths(F.array("pay.pay_min", "pay.pay_max", F.length("title").cast("double"))).cast("array<string>"), ",").alias("shares"))

    @query("""SELECT event_id, CASE WHEN event_type <> 'error' AND k <= 100 THEN CAST(100 - k AS VARCHAR) || ',' || CAST(k AS VARCHAR) END AS shares FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
    def read_answer_yes_no(spark: SparkSession, sf: str):
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.when(F.col("event_type") == "error", "choice").otherwise("noul")
        answer = F.concat(F.lit('{"type":"'), kind, F.lit('","noul":'), (k / 100.0).cast("string"), F.lit("}"))
        return table(spark, sf, "events").select("event_id", F.array_join(numbers.read_yes_no(answer).cast("array<string>"), ",").alias("shares"))

    @query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN CAST(k AS VARCHAR) || ',' || CAST(100 - k AS VARCHAR) || ',0' END AS shares FROM e""")
    def read_answer_choice(spark: SparkSession, sf: str):
        """Of every seventh answer an option is missing, and every fifth sums to more than one: both are unreadable."""
        k = F.get_json_object("props", "$.k").cast("int")
        third = F.when(k % 7 == 0, "").when(k % 5 == 0, ',"onsite":0.5').otherwise(',"onsite":0.0')
        answer = F.concat(F.lit('{"type":"choice","probabilities":{"hybrid":'), ((100 - k) / 100.0).cast("string"), F.lit(',"remote":'), (k / 100.0).cast("string"), third, F.lit("}}"))
        return table(spark, sf, "events").select("event_id", F.array_join(numbers.read_choice(answer, ["remote", "hybrid", "onsite"]).cast("array<string>"), ",").alias("shares"))

    @query("SELECT id, floor(pay.pay_min * f + 0.5) AS low, floor(pay.pay_max * f + 0.5) AS high, greatest(floor(pay.pay_min * f + 0.5), floor(pay.pay_max * f + 0.5)) AS reach FROM (SELECT *, CASE pay.stated_per WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'hour' THEN 2080 END AS f FROM (SELECT DISTINCT * FROM index_rows)) WHERE pay IS NOT NULL")
    def annual_pay(spark: SparkSession, sf: str):
        rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"]).where("pay IS NOT NULL")
        low, high = (numbers.annual(F.col(f"pay.{c}"), F.col("pay.stated_per")) for c in ("pay_min", "pay_max"))
        return rows.select("id", low.alias("low"), high.alias("high"), numbers.pay_reach(low, high).alias("reach"))

    _WORDS = "' ' || lower(regexp_replace(regexp_replace(label, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z]+', ' ', 'g')) || ' '"
    _KINDS = {"full-time": " full ?time ", "part-time": " (part ?time|working student|werkstudent) ", "contract": " (contract|contractor|freelance|freelancer|project based) ", "internship": " (intern|internship|trainee|apprentice|apprenticeship|alternance|stage|stagiaire) ", "temporary": " (temporary|temp|fixed term|short term|cdd) "}
    _named = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(w, '{p}') THEN '{k}' END" for k, p in _KINDS.items()) + "], lambda x: x IS NOT NULL)"

    @query(f"""WITH t AS (SELECT DISTINCT id, unnest(employment_types) AS t, title FROM index_rows), l AS (SELECT id, CASE WHEN length(title) % 3 = 0 THEN replace(initcap_(t), '-', '') WHEN length(title) % 3 = 1 THEN 'Permanent Employee, ' || upper(t) ELSE title || ' (' || t || ')' END AS label FROM t),
w AS (SELECT id, label, {_WORDS} AS w FROM l), k AS (SELECT id, label, {_named} AS k, w FROM w) SELECT DISTINCT id, label, CASE WHEN len(k) > 0 THEN array_to_string(k, ',') WHEN regexp_matches(w, ' (permanent|employee|cdi|cadre) ') THEN 'full-time' ELSE '' END AS types FROM k""".replace("initcap_(t)", "array_to_string([upper(left(p, 1)) || p[2:] FOR p IN string_split(t, '-')], '-')"))
    def employment_words(spark: SparkSession, sf: str):
        """Stated labels in the ways systems write them."""
        rows = table(spark, sf, "index_rows").select("id", "title", F.explode("employment_types").alias("t")).distinct()
        camel = F.array_join(F.transform(F.split("t", "-"), F.initcap), "")
        n = F.length("title") % 3
        rows = rows.select("id", F.when(n == 0, camel).when(n == 1, F.concat(F.lit("Permanent Employee, "), F.upper("t"))).otherwise(F.concat("title", F.lit(" ("), "t", F.lit(")"))).alias("label"))
        return rows.select("id", "label", F.array_join(text.employment_types(F.col("label")), ",").alias("types")).distinct()

    @query(f"WITH l AS (SELECT DISTINCT id, title AS label FROM criterion_postings), w AS (SELECT id, {_WORDS} AS w FROM l), k AS (SELECT id, {_named} AS k, w FROM w) SELECT DISTINCT id, CASE WHEN len(k) > 0 THEN array_to_string(k, ',') WHEN regexp_matches(w, ' (permanent|employee|cdi|cadre) ') THEN 'full-time' ELSE '' END AS types FROM k")
    def employment_types(spark: SparkSession, sf: str):
        return table(spark, sf, "criterion_postings").select("id", F.array_join(text.employment_types(F.col("title")), ",").alias("types")).distinct()

    _word = "(^|[^A-Za-z0-9_])"
    _end = "($|[^A-Za-z0-9_])"

    @query(f"""WITH r AS (SELECT id, any_value(title) AS t, any_value(locations) AS l FROM index_rows GROUP BY id), x AS (SELECT id, CASE WHEN length(t) % 11 = 0 THEN '*** EXTERNAL Test Job: ' || t WHEN length(t) % 11 = 1 THEN t || ' - do not apply' ELSE t END AS t, CASE WHEN length(t) % 11 = 2 THEN list_append(l, 'Z-test ' || t) ELSE l END AS l FROM r)
SELECT id, coalesce(regexp_matches(t, '(?i)^[^A-Za-z0-9_]*((external|internal)\\s+)?(template|test (job|posting))\\s*[-:|\\]]|{_word}do not apply{_end}'), false) OR coalesce(list_bool_or([regexp_matches(x, '(?i){_word}(templates?|z-?test){_end}') FOR x IN l]), false) AS placeholder FROM x""")
    def placeholder_filter(spark: SparkSession, sf: str):
        """Titles and labels as they are, and some with the signs of a placeholder."""
        rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"])
        n = F.length("title") % 11
        title = F.when(n == 0, F.concat(F.lit("*** EXTERNAL Test Job: "), "title")).when(n == 1, F.concat("title", F.lit(" - do not apply"))).otherwise(F.col("title"))
        labels = F.when(n == 2, F.array_append("locations", F.concat(F.lit("Z-test "), "title"))).otherwise(F.col("locations"))
        return rows.select("id", text.is_placeholder(title, labels).alias("placeholder"))

    @query("SELECT event_id, CASE WHEN k >= 70 THEN 'likely' WHEN k >= 40 THEN 'maybe' ELSE 'unlikely' END AS band FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)")
    def confidence_bands(spark: SparkSession, sf: str):
        return table(spark, sf, "events").select("event_id", text.confidence_band(F.get_json_object("props", "$.k").cast("int")).alias("band"))

    @query("SELECT DISTINCT id, source || ':' || lower(slug) AS made FROM boards")
    def board_ids(spark: SparkSession, sf: str):
        return table(spark, sf, "boards").select("id", ids.board_id(F.col("source"), F.col("slug")).alias("made")).distinct()

    _bits = "array_to_string([lpad(bin(('0x' || c)::INT), 4, '0') FOR c IN string_split(left(h, 20), '')], '')"

    @query(f"""WITH r AS (SELECT DISTINCT board_id, external_id, sha256(board_id || ':' || external_id) AS h FROM board_listings WHERE external_id IS NOT NULL AND board_id IS NOT NULL), b AS (SELECT *, {_bits} AS bits FROM r)
SELECT board_id, external_id, array_to_string([substr('abcdefghijklmnopqrstuvwxyz234567', 1 + list_reduce(list_prepend(0, [c::INT FOR c IN string_split(substr(bits, 1 + 5 * i, 5), '')]), lambda a, x: 2 * a + x), 1) FOR i IN range(16)], '') AS posting_id FROM b""")
    def posting_ids(spark: SparkSession, sf: str):
        rows = table(spark, sf, "board_listings").select("board_id", "external_id").where("board_id IS NOT NULL AND external_id IS NOT NULL").distinct()
        return rows.withColumn("posting_id", ids.posting_id(F.col("board_id"), F.col("external_id")))

    @query("SELECT id, sha256('{\"company\":' || to_json(company) || ',\"title\":' || to_json(title) || '}') AS hash FROM (SELECT DISTINCT id, company, title FROM criterion_postings)")
    def content_hashes(spark: SparkSession, sf: str):
        rows = table(spark, sf, "criterion_postings").select("id", "company", "title").distinct()
        return rows.select("id", ids.content_hash(F.to_json(F.struct("title", "company"))).alias("hash"))

    fnv = "list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(id, '')]), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"
    mul = lambda h, f: f"(({h}::HUGEINT * {f}) % 4294967296)::BIGINT"

    @query(f"""WITH p AS (SELECT DISTINCT id FROM criterion_postings), a AS (SELECT id, {fnv} AS h FROM p), b AS (SELECT id, {mul('xor(h, h >> 16)', 2246822507)} AS h FROM a), c AS (SELECT id, {mul('xor(h, h >> 13)', 3266489909)} AS h FROM b)
SELECT id, lower(printf('%08x', xor(h, h >> 16))) AS key FROM c ORDER BY key, id LIMIT 200""")
    def stable_sample(spark: SparkSession, sf: str):
        """The 200 postings whose hash of the id comes first: the same ones whenever they exist."""
        own = table(spark, sf, "criterion_postings").select("id").distinct().withColumn("key", ids.shuffle_key(F.col("id")))
        return own.orderBy("key", "id").limit(200)

    @query()
    def html_to_text(spark: SparkSession, sf: str):
        """The text of every description: null is empty and escaped tags become text once, as in the export."""
        rows = table(spark, sf, "criterion_postings").select("id", F.coalesce("description", F.lit("")).alias("description")).distinct()
        return rows.select("id", text.html_to_text("description").alias("text"))

    @query("SELECT event_id, sha256('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS hash FROM events")
    def canonical_json_hash(spark: SparkSession, sf: str):
        return table(spark, sf, "events").select("event_id", ids.content_hash(F.col("props")).alias("hash"))

    @query("SELECT day, source, n, running FROM (SELECT CAST(CAST(first_seen_at AS DATE) AS VARCHAR) AS day, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY CAST(first_seen_at AS DATE))::BIGINT AS running FROM (SELECT DISTINCT * FROM freshness_samples) GROUP BY CAST(first_seen_at AS DATE), source)")
    def samples_by_day(spark: SparkSession, sf: str):
        """Daily buckets with a running total a source."""
        day = F.to_date("first_seen_at")
        daily = table(spark, sf, "freshness_samples").dropDuplicates(["sample_id"]).groupBy(day.alias("d"), "source").agg(F.count("*").alias("n"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("d"))
        return daily.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "source", "n", running.alias("running"))
