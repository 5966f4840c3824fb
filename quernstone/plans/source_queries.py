"""Queries over sources, the index format, places and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places
from ..operators import facets
from ..operators import lifecycle as L
from ..sources import index_io, listings, robots
from ..streaming import windows
from ..tables import cut, exists, latest, shared, stamp, table
from .lifecycle_queries import _SEEN
from .search import QUESTIONS

#: Events before the first time are early, those before the second come next.
_EARLY, _NEXT = "2024-01-15 00:00:00", "2024-01-20 00:00:00"
#: Countries here are codes of two letters; their first letter stands for a continent.
_ORDER = ["A", "Q", "X", "Z", "anywhere"]


def _parted(spark: SparkSession, sf: str, rows: int = index_io.PART_ROWS) -> DataFrame:
    own = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"])
    letters = {r["c"]: r["c"][:1] for r in table(spark, sf, "gazetteer_cities").select(F.col("country").alias("c")).distinct().collect()}  # one row a country
    return index_io.parts(own, index_io.regions(F.col("places"), F.col("anywhere"), letters, _ORDER), rows)


_ROWS = """r AS (SELECT id, any_value(posted_at) AS posted_at, any_value(anywhere) AS anywhere, any_value([p.country FOR p IN places]) AS cs FROM index_rows GROUP BY id),
known AS (SELECT DISTINCT country FROM gazetteer_cities),
g AS (SELECT id, posted_at, left(c, 1) AS region FROM (SELECT id, posted_at, unnest(list_distinct(cs)) AS c FROM r) JOIN known ON known.country = c GROUP BY ALL UNION SELECT id, posted_at, 'anywhere' FROM r WHERE anywhere),
f AS (SELECT * FROM g UNION ALL SELECT id, posted_at, 'unplaced' FROM r WHERE id NOT IN (SELECT id FROM g))"""


#: Intervals as the systems write them, and how ours are called (fixed values).
_LEVER_PER = {"year": "per-year-salary", "month": "per-month-salary", "week": "per-week-salary", "day": "per-day-wage", "hour": "per-hour-wage"}
_ASHBY_PER = {k: f"1 {k.upper()}" for k in _LEVER_PER}


def _bodies(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """Listings of several jobs each in the shape a system delivers them; the first job comes twice and once without a title.

    Jobs of a company are spread over listings by the first letters of their id, so no row holds a whole company.
    """
    rows = latest(table(spark, sf, "index_rows"), ["id"], ["posted_at"])
    label = lambda i: F.get("locations", F.lit(i))
    none, published = F.lit(None).cast("string"), F.date_format(F.timestamp_millis("posted_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rest = F.filter("locations", lambda x, i: i > 0)
    kinds = F.array_join("employment_types", ", ")
    per = lambda names: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.coalesce("pay.stated_per", F.lit("")))
    if source == "greenhouse":
        title = "title"
        offices = F.transform(rest, lambda x: F.struct(F.lit("Office").alias("name"), x.alias("location")))
        job = F.struct("id", "title", F.col("url").alias("absolute_url"), F.struct(label(0).alias("name")).alias("location"), offices.alias("offices"), F.array(F.struct(F.col("department").alias("name"))).alias("departments"), published.alias("first_published"), F.lit("&lt;p&gt;x &amp;amp; y&lt;/p&gt;").alias("content"))
    elif source == "lever":
        title = "text"
        pay = F.struct(F.col("pay.pay_min").alias("min"), F.col("pay.pay_max").alias("max"), F.col("pay.currency").alias("currency"), per(_LEVER_PER).alias("interval"))
        job = F.struct("id", F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct(F.col("locations").alias("allLocations"), kinds.alias("commitment"), "department", none.alias("team")).alias("categories"), F.col("workplace").alias("workplaceType"), F.col("posted_at").alias("createdAt"), pay.alias("salaryRange"), F.lit("<p>x</p>").alias("description"))
    else:
        title = "title"
        pay = F.struct(F.lit("Salary").alias("compensationType"), F.col("pay.pay_min").alias("minValue"), F.col("pay.pay_max").alias("maxValue"), F.col("pay.currency").alias("currencyCode"), per(_ASHBY_PER).alias("interval"))
        parts = F.array(F.struct(F.lit("Equity").alias("compensationType"), F.lit(1.0).alias("minValue"), F.lit(1.0).alias("maxValue"), none.alias("currencyCode"), none.alias("interval")), pay)
        job = F.struct("id", "title", F.col("url").alias("jobUrl"), label(0).alias("location"), F.transform(rest, lambda x: F.struct(x.alias("location"))).alias("secondaryLocations"), F.lit(True).alias("isListed"), F.col("workplace").alias("workplaceType"), kinds.alias("employmentType"), "department", published.alias("publishedAt"), F.struct(parts.alias("summaryComponents")).alias("compensation"), F.lit("<p>x</p>").alias("descriptionHtml"))
    jobs = rows.select("company", F.left("id", F.lit(2)).alias("part"), job.alias("job")).groupBy("company", "part").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    first = F.col("jobs")[0]
    bad = first.withField("id", F.concat(F.lit("bad-"), first["id"])).withField(title, F.lit("  "))
    jobs = jobs.withColumn("jobs", F.concat("jobs", F.array(first.withField(title, F.lit("twice")), bad)))
    return jobs.select(F.col("company").alias("board_id"), (F.to_json("jobs") if source == "lever" else F.to_json(F.struct("jobs"))).alias("body"))


def _listed(source: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        read = listings.READERS[source](_bodies(spark, sf, source))
        return read.select(
            "board_id", "external_id", "kind", "title", "url", F.array_join("locations", "|").alias("locations"), F.array_join(F.transform("places", lambda p: p["text"]), "|").alias("offices"), "workplace", "employment_type", "department", "published_at",
            F.col("salary.min").alias("pay_min"), F.col("salary.max").alias("pay_max"), F.col("salary.currency").alias("currency"), F.col("salary.interval").alias("per"), "description_html",
        )

    return run


_CLEAN = "nullif(trim(regexp_replace({}, '[\\s\\x{{00A0}}]+', ' ', 'g')), '')"
_DISTINCT = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"


def _listed_sql(source: str) -> str:
    ls = f"[{_CLEAN.format('x')} FOR x IN coalesce(locations, [])]"
    stated = source != "greenhouse"
    paid = "pay.currency IS NOT NULL AND regexp_matches(pay.currency, '^[A-Z]{3}$') AND pay.stated_per IN ('year', 'month', 'week', 'day', 'hour') AND (pay.pay_min >= 0 OR pay.pay_max >= 0)"
    one = lambda c, ok=stated: f"CASE WHEN {'true' if ok else 'false'} THEN {c} END"
    body = {"greenhouse": "<p>x &amp; y</p>"}.get(source, "<p>x</p>")
    return f"""WITH r AS (SELECT id, any_value(title) AS title, any_value(company) AS company, any_value(locations) AS locations, any_value(workplace) AS workplace, any_value(employment_types) AS types, any_value(department) AS department, any_value(pay) AS pay, any_value(posted_at) AS posted_at, any_value(url) AS url FROM index_rows GROUP BY id),
l AS (SELECT *, {ls} AS ls FROM r), d AS (SELECT *, {"ls[1:1]" if source == "greenhouse" else "ls"} AS own, {"ls[2:]" if source == "greenhouse" else "[]"} AS others FROM l),
j AS (SELECT company AS board_id, id AS external_id, {_CLEAN.format('title')} AS title, url, array_to_string({_DISTINCT.format('own')}, '|') AS locations, array_to_string({_DISTINCT.format('others')}, '|') AS offices, {one('workplace')} AS workplace, {one("nullif(array_to_string(types, ', '), '')")} AS employment_type, {_CLEAN.format('department')} AS department, posted_at AS published_at,
{one(f'CASE WHEN {paid} AND pay.pay_min >= 0 THEN pay.pay_min END')} AS pay_min, {one(f'CASE WHEN {paid} AND pay.pay_max >= 0 THEN pay.pay_max END')} AS pay_max, {one(f'CASE WHEN {paid} THEN pay.currency END')} AS currency, {one(f'CASE WHEN {paid} THEN pay.stated_per END')} AS per, '{body}' AS description_html FROM d),
b AS (SELECT * REPLACE ('bad-' || external_id AS external_id, NULL AS title) FROM j QUALIFY row_number() OVER (PARTITION BY board_id, left(external_id, 2) ORDER BY external_id) = 1)
SELECT *, CASE WHEN title IS NULL OR NOT regexp_matches(url, '^https?://[^\\s]+$') THEN 'invalid' ELSE 'posting' END AS kind FROM (SELECT * FROM j UNION ALL SELECT * FROM b)"""


def register(query) -> None:
    @query(f"WITH {_ROWS} SELECT region, count(*) AS n FROM f GROUP BY region")
    def region_fanout(spark: SparkSession, sf: str):
        return _parted(spark, sf).groupBy("region").agg(F.count("*").alias("n"))

    @query(f"WITH {_ROWS} SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY posted_at DESC NULLS LAST, id) - 1 AS place, ((row_number() OVER (PARTITION BY region ORDER BY posted_at DESC NULLS LAST, id) - 1) // 500)::INT AS part FROM f")
    def shard_parts(spark: SparkSession, sf: str):
        return _parted(spark, sf, 500).select("id", "region", F.col("place").cast("bigint").alias("place"), "part")

    @query(f"WITH {_ROWS}, k AS (SELECT region, (row_number() OVER (PARTITION BY region ORDER BY posted_at DESC NULLS LAST, id) - 1) // 500 AS part FROM f) SELECT region, part::INT AS part, count(*) AS n FROM k GROUP BY ALL")
    def manifest_counts(spark: SparkSession, sf: str):
        return index_io.manifest(_parted(spark, sf, 500)).select("region", "part", "n")

    @query("SELECT count(DISTINCT id) AS n FROM index_rows")
    def shard_union_dedupe(spark: SparkSession, sf: str):
        return _parted(spark, sf).select("id", "region").dropDuplicates(["id"]).agg(F.count("*").alias("n"))

    def written(spark: SparkSession, sf: str) -> str:
        """The index of this state of the table, written once."""
        path = shared(spark, f"parts-{stamp(spark, f'{sf}/index_rows.parquet')}")
        if not exists(spark, f"{path}/header/_SUCCESS"):
            index_io.write(cut(_parted(spark, sf, 500)), path, QUESTIONS)
        return path

    @query(f"WITH {_ROWS} SELECT DISTINCT f.id, r2.url FROM f JOIN (SELECT id, any_value(url) AS url FROM index_rows GROUP BY id) r2 USING (id) WHERE region IN ('A', 'anywhere')")
    def index_read_regions(spark: SparkSession, sf: str):
        """Two regions of the written index with the links kept beside it."""
        path = written(spark, sf)
        rows = index_io.read(spark, path, ["A"], QUESTIONS)
        return index_io.with_links(rows.select("id"), spark.read.parquet(f"{path}/links"))

    @query(f"WITH {_ROWS}, k AS (SELECT region, (row_number() OVER (PARTITION BY region ORDER BY posted_at DESC NULLS LAST, id) - 1) // 500 AS part FROM f) SELECT region, count(DISTINCT part) AS parts, count(*) AS n FROM k GROUP BY region")
    def index_manifest(spark: SparkSession, sf: str):
        """Parts and rows of each region as the written manifest has them."""
        entries = spark.read.schema(index_io.ENTRIES).json(f"{written(spark, sf)}/manifest", mode="FAILFAST")
        return entries.groupBy("region").agg(F.count("*").alias("parts"), F.sum("n").alias("n"))

    @query("SELECT 0 AS wrong")
    def index_check(spark: SparkSession, sf: str):
        wrong = index_io.check(spark, written(spark, sf), QUESTIONS)
        return spark.createDataFrame([(len([w for w in wrong if "budget" not in w]),)], "wrong int")

    @query("SELECT DISTINCT id, 'wrong width' AS problem FROM index_rows WHERE len(answers['arrangement']) <> 4 OR len(answers['on_call']) <> 2")
    def index_inconsistencies(spark: SparkSession, sf: str):
        return index_io.inconsistent(table(spark, sf, "index_rows"), QUESTIONS).distinct()

    for source in ("greenhouse", "lever", "ashby"):
        f = _listed(source)
        f.__name__ = f"listing_{source}"
        query(_listed_sql(source))(f)

    def derived(spark: SparkSession, sf: str) -> DataFrame:
        """Facets of what the second system's listings hold."""
        read = listings.READERS["lever"](_bodies(spark, sf, "lever")).where("kind = 'posting'").withColumn("id", F.col("external_id"))
        homes = table(spark, sf, "boards").groupBy(F.col("company").alias("board_id")).agg(F.min("country").alias("home"))
        return facets.derive(read, homes, table(spark, sf, "gazetteer_cities"))

    def seen(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "board_listings").select(F.col("posting_id").alias("id"), F.col("recorded_at").alias("first_seen_at"))

    _per = "CASE pay.stated_per WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END"

    @query(f"""WITH r AS (SELECT id, any_value(workplace) AS workplace, any_value(employment_types) AS types, any_value(department) AS department, any_value(pay) AS pay, any_value(posted_at) AS posted_at FROM index_rows GROUP BY id), f AS (SELECT posting_id AS id, min(recorded_at) AS t FROM board_listings GROUP BY 1)
SELECT r.id, workplace, array_to_string(list_filter(['full-time', 'part-time', 'contract', 'internship', 'temporary'], lambda x: list_contains(types, x)), ',') AS types, nullif(trim(regexp_replace(department, '\\s+', ' ', 'g')), '') AS department, coalesce(posted_at, t) AS posted_at, floor(pay.pay_min * {_per} + 0.5) AS pay_min, floor(pay.pay_max * {_per} + 0.5) AS pay_max, CASE WHEN pay.pay_min >= 0 OR pay.pay_max >= 0 THEN pay.currency END AS currency, CASE WHEN pay.pay_min >= 0 OR pay.pay_max >= 0 THEN pay.stated_per END AS per FROM r LEFT JOIN f ON f.id = r.id WHERE workplace IS NOT NULL""")
    def assembled_rows(spark: SparkSession, sf: str):
        """Index rows made of listings; those with a stated arrangement, as a label's is no matter of SQL."""
        rows = facets.index_rows(derived(spark, sf), seen(spark, sf)).join(table(spark, sf, "index_rows").where("workplace IS NOT NULL").select("id"), "id", "left_semi")
        return rows.select("id", "workplace", F.array_join("employment_types", ",").alias("types"), "department", "posted_at", F.col("pay.pay_min").alias("pay_min"), F.col("pay.pay_max").alias("pay_max"), F.col("pay.currency").alias("currency"), F.col("pay.stated_per").alias("per"))

    @query()
    def derived_facets(spark: SparkSession, sf: str):
        """Places, countries, arrangement and basis of each posting from its labels: each distinct label is read once."""
        return derived(spark, sf).select("id", F.array_join(F.array_sort("countries"), ",").alias("countries"), "workplace", "anywhere", "basis", F.array_join("unmatched", "|").alias("unmatched"))

    @query("SELECT count(DISTINCT id) AS postings, 0 AS placeholders FROM index_rows")
    def facets_report(spark: SparkSession, sf: str):
        report = facets.build_report(derived(spark, sf))
        return report.where("by_label + by_stated + by_home + by_none = postings").select("postings", "placeholders")

    @query("WITH l AS (SELECT DISTINCT unnest(locations) AS label FROM index_rows) SELECT count(*) AS labels FROM l WHERE label IS NOT NULL")
    def location_label_count(spark: SparkSession, sf: str):
        own = table(spark, sf, "index_rows").select(F.explode("locations").alias("label"))
        return places.read_labels(own, "label", table(spark, sf, "gazetteer_cities")).agg(F.count("*").alias("labels"))

    @query("""WITH c AS (SELECT DISTINCT country, country_name FROM gazetteer_cities), d AS (SELECT DISTINCT country, country_name, division, division_name FROM gazetteer_cities WHERE division IS NOT NULL)
SELECT canonical_label AS label, country, division, city_id AS city, NULL AS workplace FROM gazetteer_cities
UNION ALL SELECT canonical_label || ' (Hybrid)', country, division, city_id, 'hybrid' FROM gazetteer_cities
UNION ALL SELECT 'Remote - ' || country_name, country, NULL, NULL, 'remote' FROM c
UNION ALL SELECT division_name || ', ' || country_name, country, division, NULL, NULL FROM d WHERE division_name NOT IN (SELECT city_name FROM gazetteer_cities)""")
    def location_golden(spark: SparkSession, sf: str):
        """Labels whose reading is known, because they are made of the gazetteer's own names."""
        cities = table(spark, sf, "gazetteer_cities")
        towns = cities.select("city_name").distinct()
        made = cities.select(F.explode(F.array("canonical_label", F.concat("canonical_label", F.lit(" (Hybrid)")), F.concat(F.lit("Remote - "), "country_name"))).alias("label"))
        made = made.unionAll(cities.where("division IS NOT NULL").join(towns.withColumnRenamed("city_name", "division_name"), "division_name", "left_anti").select(F.concat_ws(", ", "division_name", "country_name").alias("label")))
        return places.read_labels(made, "label", cities).select("label", F.inline_outer("places"), "workplace")

    @query()
    def location_readings(spark: SparkSession, sf: str):
        own = table(spark, sf, "index_rows").select(F.explode("locations").alias("label"))
        read = places.read_labels(own, "label", table(spark, sf, "gazetteer_cities"))
        return read.select("label", F.to_json("places").alias("places"), "workplace", "anywhere", F.array_join("unmatched", "|").alias("unmatched"))

    @query()
    def unplaced_labels(spark: SparkSession, sf: str):
        """The 15 labels without a place that most postings have."""
        own = table(spark, sf, "index_rows").dropDuplicates(["id"]).select(F.explode("locations").alias("label"))
        read = places.read_labels(own, "label", table(spark, sf, "gazetteer_cities")).where("size(places) = 0 AND NOT anywhere")
        return own.groupBy("label").agg(F.count("*").alias("n")).join(read.select("label"), "label").orderBy(F.desc("n"), "label").limit(15)

    @query("SELECT DISTINCT board_id AS host, '/' || title AS path, NOT (title LIKE 'Senior%' AND NOT title LIKE 'Senior B%') AS allowed FROM criterion_postings")
    def robots_match(spark: SparkSession, sf: str):
        own = table(spark, sf, "criterion_postings").select(F.col("board_id").alias("host"), F.concat(F.lit("/"), "title").alias("path"))
        files = own.select("host").distinct().withColumn("body", F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /Senior\nAllow: /Senior B\nDisallow: /*.pdf$\n"))
        return robots.allowed(own, robots.rules_table(files, "host", "body"), "quernstone")

    n = iter(range(1 << 30))

    def drained(spark: SparkSession, df: DataFrame) -> DataFrame:
        return windows.drain(df, shared(spark, f"stream-{spark.sparkContext.applicationId}-{next(n)}"))

    def delivered(spark: SparkSession, df: DataFrame, name: str, stamped: str, parts: list[Column]) -> DataFrame:
        """A stream of the rows of ``df`` in the order of ``parts``, one delivery a trigger."""
        path = shared(spark, f"{name}-{stamped}")
        if not exists(spark, f"{path}/{len(parts) - 1}/_SUCCESS"):
            for i, part in enumerate(parts):
                df.where(part).coalesce(1).write.mode("overwrite").parquet(f"{path}/{i}")  # a delivery is a file: triggers take whole files
        return windows.stream_of(spark, f"{path}/*", df.schema)

    def events(spark: SparkSession, sf: str) -> DataFrame:
        """All events, a tenth of the early ones late: after the watermark has passed most of them."""
        own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        early, late, next_ = F.col("ts") < F.lit(_EARLY).cast("timestamp"), F.col("event_id") % 10 == 0, F.col("ts") < F.lit(_NEXT).cast("timestamp")
        return delivered(spark, own, "events", stamp(spark, f"{sf}/events.parquet"), [early & ~late, ~early & next_, early & late, ~next_])

    _hour = "time_bucket(INTERVAL '1 hour', ts)"
    #: Late rows are compared with the watermark of the trigger before; windows come out up to the last watermark.
    _taken = f"""WITH e AS (SELECT *, ts < TIMESTAMP '{_EARLY}' AS early, event_id % 10 = 0 AS late FROM events),
k AS (SELECT max(ts) FILTER (early AND NOT late) - INTERVAL '1 day' AS dropped, max(ts) - INTERVAL '1 day' AS closed FROM e)"""

    @query(f"{_taken} SELECT CAST({_hour} AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, k WHERE NOT (early AND late AND {_hour} + INTERVAL '1 hour' <= dropped) AND {_hour} + INTERVAL '1 hour' <= closed GROUP BY {_hour}, event_type")
    def stream_tumbling(spark: SparkSession, sf: str):
        out = windows.tumbling(events(spark, sf), "ts", "1 hour", "1 day", "event_type", "value")
        return drained(spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

    @query(f"{_taken}, w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * i) AS s, event_type, early AND late AS l FROM e, range(4) t(i)) SELECT CAST(s AS VARCHAR) AS window_start, event_type, count(*) AS n FROM w, k WHERE NOT (l AND s + INTERVAL '24 hours' <= dropped) AND s + INTERVAL '24 hours' <= closed GROUP BY s, event_type")
    def stream_sliding(spark: SparkSession, sf: str):
        out = windows.sliding(events(spark, sf), "ts", "24 hours", "6 hours", "1 day", "event_type")
        return drained(spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")

    #: Sessions of the first delivery that the watermark has passed are closed: a late row joins them no more.
    _numbered = "SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM {})"

    @query(f"""{_taken}, a AS ({_numbered.format("(SELECT * FROM e WHERE early AND NOT late)")}), c AS (SELECT *, max(ts) OVER (PARTITION BY user_id, i) + INTERVAL '6 hours' <= dropped AS closed_first FROM a, k),
r AS (SELECT user_id, ts FROM c WHERE NOT closed_first UNION ALL SELECT user_id, ts FROM e, k WHERE NOT (early AND NOT late) AND NOT (early AND ts + INTERVAL '6 hours' <= dropped)), n AS ({_numbered.format("r")}),
s AS (SELECT user_id, ts, i, closed_first FROM c WHERE closed_first UNION ALL SELECT user_id, ts, i, false FROM n)
SELECT user_id, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS session_start, count(*) AS n FROM s, k GROUP BY user_id, i, closed_first, closed HAVING max(ts) + INTERVAL '6 hours' <= closed""")
    def stream_session(spark: SparkSession, sf: str):
        out = windows.sessions(events(spark, sf), "ts", "6 hours", "1 day", "user_id")
        return drained(spark, out).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")

    @query("SELECT count(DISTINCT event_id) AS n FROM events")
    def stream_dedupe(spark: SparkSession, sf: str):
        out = windows.once_within(events(spark, sf), "ts", "40 days", ["event_id"])
        return drained(spark, out.select("event_id")).agg(F.count("*").alias("n"))

    @query(f"{_SEEN} SELECT * FROM runs")
    def stream_presence_state(spark: SparkSession, sf: str):
        """Presence runs kept as state a posting, the sightings out of order: the batch runs come out."""
        seen = L.sightings(table(spark, sf, "board_listings"), table(spark, sf, "board_crawls")).select("board_id", "posting_id", "seq", "id", "extends_to")
        stamped = stamp(spark, f"{sf}/board_listings.parquet") + stamp(spark, f"{sf}/board_crawls.parquet")
        return windows.latest_runs(drained(spark, windows.presence_stream(delivered(spark, seen, "seen", stamped, [F.col("seq") % 3 == r for r in (1, 0, 2)]))))
