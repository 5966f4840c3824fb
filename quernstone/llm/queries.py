"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import langs, leaks, markup, percentiles, places, similar, spans, tokens


def _languages(spark: SparkSession, sf: str, counted_only: bool = False) -> DataFrame:
    return langs.classify(table(spark, sf, "criterion_postings"), "id", "description", "title", "lang", counted_only=counted_only)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return langs.mislabelled(_languages(spark, sf, counted_only=True))


def p1_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).select("id", "main", F.posexplode_outer("parts").alias("part", "p")).select("id", "main", "part", "p.*")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    postings = table(spark, sf, "criterion_postings").select("id", F.from_json("locations_json", "array<string>").alias("labels"))
    known = table(spark, sf, "index_rows").select("id", F.explode("places.country").alias("country"))
    return places.read_labels(postings, table(spark, sf, "gazetteer_cities"), known)


def p2_index(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of index_rows, read as those of the postings."""
    rows = table(spark, sf, "index_rows")
    known = rows.select("id", F.explode("places.country").alias("country"))
    return places.read_labels(rows.select("id", F.col("locations").alias("labels")), table(spark, sf, "gazetteer_cities"), known)


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """label, postings: what names no city, by how many postings of the index have it."""
    labels = table(spark, sf, "index_rows").select("id", F.posexplode("locations").alias("loc_pos", "label"))
    none = p2_index(spark, sf).where("city_id = 0").select("id", "loc_pos")
    return labels.join(none, ["id", "loc_pos"], "left_semi").groupBy("label").agg(F.count_distinct("id").alias("postings"))


def p3_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.by(table(spark, sf, "freshness_samples"), ["run_id"])


def p3_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.by(table(spark, sf, "freshness_samples"), ["source"])


def p3_overall(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.by(table(spark, sf, "freshness_samples"), [])


def p3_windows(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.windows(table(spark, sf, "freshness_samples"))


def p4_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean(table(spark, sf, "criterion_postings"), "id", "description", "board_id").withColumn("markup", F.concat_ws(",", "markup"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = markup.clean(table(spark, sf, "criterion_postings"), "id", "description", "board_id", repeats=True)
    return cleaned.select("id", F.explode("markup").alias("markup")).distinct()


def _reposts(spark: SparkSession, sf: str) -> similar.Similar:
    return similar.Similar(table(spark, sf, "criterion_postings"), "id", "description", size=3, threshold=0.6, least_words=50)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _reposts(spark, sf).pairs()


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _reposts(spark, sf).groups()


def _named(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Links between class hashes as links between the classes' least ids."""
    names = members.groupBy("class_hash").agg(F.min(key).alias("class"))
    a, b = (names.select(F.col("class_hash").alias(f"h_{x}"), F.col("class").alias(x)) for x in "ab")
    both = links.join(a, "h_a").join(b, "h_b")
    return both.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), *[c for c in links.columns if c not in ("h_a", "h_b")])


def _members(members: DataFrame, key: str) -> DataFrame:
    return members.join(members.groupBy("class_hash").agg(F.min(key).alias("class")), "class_hash").select(key, "class")


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    """class_a < class_b and their similarity: the links between different texts; ``p6_members`` has who is in a class."""
    own = _reposts(spark, sf)
    members = own.classes().select(F.col("k").alias("id"), F.col("h").alias("class_hash"))
    return _named(own.links(), members, "id").withColumn("similarity", F.round("similarity", 9))


def p6_members(spark: SparkSession, sf: str) -> DataFrame:
    """id, class: texts of one set of word sequences; a class is named by its least id."""
    return _members(_reposts(spark, sf).classes().select(F.col("k").alias("id"), F.col("h").alias("class_hash")), "id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.find(table(spark, sf, "documents"), table(spark, sf, "eval_items"), masks=leaks.MASKS[:3])  # any mask meets all verbatim runs
    return found.where(f"run >= {leaks.LEAST}").select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.Shared(table(spark, sf, "documents")).pairs()


def p9_links(spark: SparkSession, sf: str) -> DataFrame:
    """class_a < class_b: the links between different texts; ``p9_members`` has which documents are copies of one."""
    own = spans.Shared(table(spark, sf, "documents"))
    return _named(own.links(), own.classes().withColumnRenamed("h", "class_hash"), "doc_id")


def p9_members(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, class: documents of one text; a class is named by its least id."""
    return _members(spans.Shared(table(spark, sf, "documents")).classes().withColumnRenamed("h", "class_hash"), "doc_id")


def p9_shared(spark: SparkSession, sf: str) -> DataFrame:
    return spans.Shared(table(spark, sf, "documents")).report()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_parts, p2_found, p2_index, p2_unmatched, p3_by_run, p3_by_source, p3_overall, p3_windows, p4_found, p4_clean_text, p6_found, p6_groups, p6_links, p6_members, p7_ids, p8_found, p8_overlaps, p9_found, p9_links, p9_members, p9_shared)}

_WORDS = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"

_SETS = f"""d AS (SELECT DISTINCT id, {_WORDS.format("description")} AS w FROM criterion_postings WHERE description IS NOT NULL),
s AS (SELECT DISTINCT id, md5_number(array_to_string(w[k:k + 2], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 50)),
m AS (SELECT id, min(id) OVER (PARTITION BY gs) AS class FROM (SELECT id, list(g ORDER BY g) AS gs FROM s GROUP BY id))"""
_SPANS = """d AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 320 GROUP BY text),
g AS (SELECT doc_id, k, md5_number(substr(text, k, 320)) AS g FROM (SELECT *, unnest(range(1, length(text) - 318)) AS k FROM d))"""

ORACLES: dict[str, str] = {
    "p6_members": f"WITH {_SETS} SELECT id, class FROM m",
    "p6_links": f"""WITH {_SETS}, r AS (SELECT DISTINCT class FROM m), o AS (SELECT s.* FROM s JOIN r ON r.class = s.id), n AS (SELECT id, count(*) AS n FROM o GROUP BY id),
p AS (SELECT a.id AS class_a, b.id AS class_b, count(*) AS k FROM o a JOIN o b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT class_a, class_b, round(k / (x.n + y.n - k), 9) AS similarity FROM p JOIN n x ON x.id = class_a JOIN n y ON y.id = class_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9""",
    "p9_members": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 320)",
    "p9_links": f"WITH {_SPANS} SELECT DISTINCT a.doc_id AS class_a, b.doc_id AS class_b FROM (SELECT DISTINCT doc_id, g FROM g) a JOIN (SELECT DISTINCT doc_id, g FROM g) b ON a.g = b.g AND a.doc_id < b.doc_id",
    "p9_shared": f"""WITH {_SPANS}, c AS (SELECT text, count(DISTINCT doc_id) AS copies FROM documents GROUP BY text), s AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM g WHERE g IN (SELECT g FROM s)), v AS (SELECT doc_id, sum(least(320, coalesce(nxt - k, 320)))::BIGINT AS part FROM p GROUP BY doc_id),
x AS (SELECT text, length(text) AS n_chars, CASE WHEN copies > 1 THEN length(text) ELSE part END AS shared_chars FROM d JOIN c USING (text) LEFT JOIN v USING (doc_id))
SELECT DISTINCT o.doc_id, x.n_chars, shared_chars, shared_chars / x.n_chars AS share FROM documents o JOIN x USING (text) WHERE shared_chars > 0""",
    **percentiles.SQL,
    "p6_found": f"""WITH d AS (SELECT DISTINCT id, {_WORDS.format("description")} AS w FROM criterion_postings WHERE description IS NOT NULL),
s AS (SELECT DISTINCT id, md5_number(array_to_string(w[k:k + 2], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 50)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9""",
    "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS.format("item_text")} AS w FROM eval_items WHERE item_text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i)),
d AS (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_found": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 320),
g AS (SELECT DISTINCT doc_id, md5_number(substr(text, k, 320)) AS g FROM (SELECT *, unnest(range(1, length(text) - 318)) AS k FROM d))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id""",
}
