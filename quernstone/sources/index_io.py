"""The search index as Parquet by region and part, with a manifest written last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import cut, latest, sizes

FORMAT = 1
PART_ROWS = 8_000
BUDGETS = {"part_bytes": 600 * 1024, "manifest_bytes": 20 * 1024, "files": 5_000}


def regions(places: Column, anywhere: Column, continents: dict[str, str], order: list[str]) -> Column:
    """The regions a row belongs to, in a fixed order: its places' continents, anywhere, or unplaced."""
    by = F.create_map(*[F.lit(x) for kv in continents.items() for x in kv])
    own = F.array_compact(F.transform(places, lambda p: F.try_element_at(by, p["country"])))
    all_ = F.concat(own, F.when(anywhere, F.array(F.lit("anywhere"))).otherwise(F.array().cast("array<string>")))
    kept = F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains(all_, r))
    return F.when(F.size(kept) == 0, F.array(F.lit("unplaced"))).otherwise(kept)


def parts(rows: DataFrame, region: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows once a region, with their part and place: newest first, no date last, then id.

    No region is numbered in one task: rows are counted by hour, those without a date by the first
    letters of their id, and only rows of one such group are numbered together.
    """
    hour = F.floor(F.col("posted_at") / 3_600_000)
    out = rows.withColumn("region", F.explode(region)).withColumns({"hour": hour, "letters": F.when(F.col("posted_at").isNull(), F.substring("id", 1, 3))})
    group = ["region", "hour", "letters"]
    counts = out.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("region").orderBy(F.desc_nulls_last("hour"), F.asc_nulls_first("letters")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*group).orderBy(F.desc_nulls_last("posted_at"), "id")
    out = out.withColumn("nth", F.row_number().over(inside))
    other = counts.withColumnsRenamed({c: f"_{c}" for c in group})
    keyed = out.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    keyed = keyed.withColumn("place", F.col("before") + F.col("nth") - 1)
    return keyed.withColumn("part", F.floor(F.col("place") / part_rows).cast("int")).drop(*(f"_{c}" for c in group), "before", "nth", "hour", "letters")


def manifest(parted: DataFrame) -> DataFrame:
    """region, part, n, hash of the rows of each part; the hash does not depend on their order in memory."""
    h = F.xxhash64("id", "title", "company", "posted_at", F.to_json("places"))
    return parted.groupBy("region", "part").agg(F.count("*").alias("n"), F.bit_xor(h).alias("hash"))


def fingerprint(questions: dict[str, tuple[str, ...]], versions: dict[str, int] | None = None) -> str:
    """Each question as id@version:options; an index made for other questions can't be read for these."""
    return ";".join(f"{q}@{(versions or {}).get(q, 1)}:{'|'.join(options)}" for q, options in sorted(questions.items()))


def build_id(entries: DataFrame, asked: str = "") -> DataFrame:
    """build: twelve hex digits of the format, the questions and all parts; the parts' hashes are added up, not gathered."""
    h = F.xxhash64("region", "part", "n", "hash")
    total = F.concat_ws(":", F.lit(str(FORMAT)), F.lit(asked), F.count("*").cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).cast("string"))
    return entries.agg(F.substring(F.sha2(total, 256), 1, 12).alias("build"))


#: The manifest's schemas: a header of one row, and an entry a part.
HEADER = "format int, build string, questions string"
ENTRIES = "region string, part int, n bigint, hash bigint"


def write(parted: DataFrame, path: str, questions: dict[str, tuple[str, ...]], versions: dict[str, int] | None = None) -> str:
    """Writes rows and links apart, then the manifest, its header last; the build's name.  Any file system will do."""
    asked = fingerprint(questions, versions)
    rows = parted.drop("url").repartition("region", "part").sortWithinPartitions("region", "part", "place")
    rows.write.mode("overwrite").partitionBy("region", "part").parquet(f"{path}/rows")
    parted.select("id", "url", "region", "part").repartition("region", "part").write.mode("overwrite").partitionBy("region", "part").parquet(f"{path}/links")
    entries = cut(manifest(parted))
    entries.write.mode("overwrite").json(f"{path}/manifest")
    name = build_id(entries, asked).first()["build"]
    parted.sparkSession.createDataFrame([(FORMAT, name, asked)], HEADER).coalesce(1).write.mode("overwrite").json(f"{path}/header")
    return name


def read(spark: SparkSession, path: str, only: list[str] | None = None, questions: dict[str, tuple[str, ...]] | None = None, versions: dict[str, int] | None = None) -> DataFrame:
    """The index, or some regions of it and always ``anywhere``: partitions that aren't asked for are not read.

    Each posting comes once, from the first region it is in.  Another format, or other questions than
    ``questions``, fail the read, and so does a header that isn't in its form.
    """
    header = spark.read.schema(HEADER).json(f"{path}/header", mode="FAILFAST").first()
    if header is None or header["format"] != FORMAT:
        raise ValueError(f"no index of format {FORMAT} at {path}")
    if questions is not None and header["questions"] != fingerprint(questions, versions):
        raise ValueError(f"the index holds {header['questions']}")
    rows = spark.read.parquet(f"{path}/rows")
    if only is not None:
        rows = rows.where(F.col("region").isin(*only, "anywhere"))
    return latest(rows, ["id"], ["region"])


def with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(links.select("id", "url").distinct(), "id", "left")


def check(spark: SparkSession, path: str, questions: dict[str, tuple[str, ...]], versions: dict[str, int] | None = None) -> list[str]:
    """What is wrong with a written index: format, questions, row counts, budgets."""
    header = spark.read.schema(HEADER).json(f"{path}/header", mode="FAILFAST").first()
    wrong = [f"format {header['format']}"] * (header["format"] != FORMAT)
    wrong += ["questions differ"] * (header["questions"] != fingerprint(questions, versions))
    held = spark.read.parquet(f"{path}/rows").groupBy("region", "part").agg(F.count("*").alias("held"))
    links = spark.read.parquet(f"{path}/links").groupBy("region", "part").agg(F.count("*").alias("linked"))
    said = spark.read.schema(ENTRIES).json(f"{path}/manifest", mode="FAILFAST")
    off = said.join(held, ["region", "part"], "full").join(links, ["region", "part"], "full").where("NOT (n <=> held AND n <=> linked)")
    wrong += [f"part {r['region']}/{r['part']} has other rows than its manifest says" for r in off.select("region", "part").limit(SHOWN).collect()]
    files = {f: n for f, n in sizes(spark, path).items() if f.endswith((".parquet", ".json"))}
    wrong += [f"{f} is over budget" for f, n in files.items() if n > BUDGETS["manifest_bytes" if f.endswith(".json") else "part_bytes"]]
    return wrong + ["too many files"] * (len(files) > BUDGETS["files"])


#: Parts a check names.
SHOWN = 50


def inconsistent(rows: DataFrame, questions: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, problem of rows that break the format: widths and sums of answers, repeated places, missing ids."""
    widths = F.create_map(*[F.lit(x) for q, o in questions.items() for x in (q, len(o))])
    each = rows.select("id", F.explode("answers").alias("q", "d"))
    known = F.try_element_at(widths, F.col("q"))
    problem = F.when(known.isNull(), "unknown question").when(F.size("d") != known, "wrong width").when(F.aggregate("d", F.lit(0), lambda a, x: a + x) != 100, "wrong sum")
    out = each.select("id", problem.alias("problem")).where("problem IS NOT NULL")
    return out.unionAll(rows.where("id IS NULL OR title IS NULL").select("id", F.lit("missing field").alias("problem")))
