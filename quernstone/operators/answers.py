"""Answers keyed by content, what is still to ask, and how good answers are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import likeliest, token_estimate

MIN_PREFIX = 10


def by_content(postings: DataFrame, answered: DataFrame) -> DataFrame:
    """content_hash, question, distribution: one answer a text and question, shared by all postings of the text.

    ``postings``: id, content_hash; ``answered``: id, answers (a map), at.  Of several the one given last counts,
    of equally late ones the greatest.
    """
    each = answered.select("id", F.coalesce("at", F.lit(-(1 << 62))).alias("at"), F.explode("answers").alias("question", "distribution"))
    joined = each.join(postings.select("id", "content_hash").distinct(), "id").where("content_hash IS NOT NULL")
    return joined.groupBy("content_hash", "question").agg(F.max(F.struct("at", "distribution"))["distribution"].alias("distribution"))


def answer_maps(contents: DataFrame) -> DataFrame:
    """content_hash, answers: all answers of a text as a map (as many as there are questions)."""
    return contents.groupBy("content_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("question", "distribution")))).alias("answers"))


def fan_out(postings: DataFrame, contents: DataFrame) -> DataFrame:
    """id, question, distribution: the answer of a text back to every posting that has it."""
    return postings.select("id", "content_hash").distinct().join(contents, "content_hash").select("id", "question", "distribution")


def unanswered(postings: DataFrame, contents: DataFrame, wanted: list[str]) -> DataFrame:
    """id, content_hash of postings whose text lacks an answer to any wanted question: one anti-join over posting and question."""
    own = postings.select("id", "content_hash").where("content_hash IS NOT NULL").distinct()
    asked = own.select("*", F.explode(F.array(*map(F.lit, wanted))).alias("question"))
    return asked.join(contents, ["content_hash", "question"], "left_anti").select("id", "content_hash").distinct()


def units(postings: DataFrame, contents: DataFrame, wanted: list[str]) -> DataFrame:
    """content_hash, postings, missing: one unit of asking a text, with how many postings share it."""
    own = postings.select("id", "content_hash").where("content_hash IS NOT NULL").distinct().groupBy("content_hash").agg(F.count("*").alias("postings"))
    held = contents.where(F.col("question").isin(*wanted)).groupBy("content_hash").agg(F.collect_set("question").alias("held"))
    missing = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("held", F.array().cast("array<string>")))
    return own.join(held, "content_hash", "left").withColumn("missing", missing).drop("held")


def estimate(asking: DataFrame, texts: DataFrame, wanted: int, unit_cost: int = 42) -> DataFrame:
    """postings, texts, wanted, cached, to_ask, tokens and cost of asking what is missing; tokens are a quarter of the bytes."""
    sized = asking.join(texts, "content_hash", "left").withColumn("tokens", F.coalesce(token_estimate(F.col("text")), F.lit(0)))
    todo = F.size("missing") > 0
    return sized.agg(
        F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.count("*").alias("texts"), F.coalesce(F.sum(F.col("postings") * wanted), F.lit(0)).alias("wanted"),
        F.coalesce(F.sum(F.col("postings") * (wanted - F.size("missing"))), F.lit(0)).alias("cached"), F.count_if(todo).alias("to_ask"),
        F.coalesce(F.sum(F.when(todo, F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(todo, F.col("tokens") * unit_cost)), F.lit(0)).alias("cost"),
    )


def resolve_prefixes(prefixes: DataFrame, ids: DataFrame, length: int = MIN_PREFIX) -> DataFrame:
    """prefix, id of prefixes (at least ``length`` long) that exactly one id has."""
    own = ids.select("id").distinct().withColumn("head", F.left("id", F.lit(length)))
    asked = prefixes.select("prefix").where(F.length("prefix") >= length).distinct().withColumn("head", F.left("prefix", F.lit(length)))
    hits = asked.join(own, "head").where(F.startswith("id", "prefix"))
    return hits.groupBy("prefix").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


def shortest_prefix(ids: DataFrame, least: int = MIN_PREFIX) -> DataFrame:
    """length: the least number of leading characters, ``least`` or more, that tells all ids apart.

    Neighbours in order share the longest heads, so one sort finds it: ids are compared with the
    next one within their head of ``least`` characters.
    """
    own = ids.select("id").distinct()
    by = Window.partitionBy(F.left("id", F.lit(least))).orderBy("id")
    pairs = own.withColumn("next", F.lead("id").over(by))
    places = F.sequence(F.lit(1), F.greatest(F.length("id"), F.length("next")))
    same = F.filter(places, lambda n: F.left("id", n) != F.left("next", n))
    need = F.when(F.col("next").isNotNull(), F.array_min(same))
    return pairs.agg(F.greatest(F.lit(least), F.coalesce(F.max(need), F.lit(0))).alias("length"))


# -- how good answers are ---------------------------------------------------------------


def judged(labels: DataFrame, predictions: DataFrame, options: list[str]) -> DataFrame:
    """Labels with what became of them: unlabelled, invalid, unanswered or compared, and the shares of compared ones.

    ``labels``: posting, option ("" where a reader could not tell); ``predictions``: posting, distribution.
    """
    known = F.array(*map(F.lit, options))
    truth = (F.array_position(known, F.col("option")) - 1).cast("int")
    joined = labels.join(predictions, "posting", "left")
    state = F.when(F.coalesce("option", F.lit("")) == "", "unlabelled").when(truth < 0, "invalid").when(F.col("distribution").isNull() | (F.size("distribution") != len(options)), "unanswered").otherwise("compared")
    rows = joined.withColumns({"state": state, "truth": truth})
    ok = F.col("state") == "compared"
    best = likeliest(F.col("distribution"))
    one_hot = F.aggregate(F.transform("distribution", lambda p, i: F.pow(p / 100.0 - (i == F.col("truth")).cast("int"), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns({
        "picked": F.when(ok, best), "confidence": F.when(ok, F.get("distribution", best)), "truth_share": F.when(ok, F.get("distribution", F.col("truth"))),
        "right": F.when(ok, best == F.col("truth")), "brier": F.when(ok, one_hot),
    })


def scores(rows: DataFrame) -> DataFrame:
    """Counts by state, accuracy, mean share of the truth, and the Brier score over all options."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("compared", "unlabelled", "invalid", "unanswered")}
    return rows.agg(*n.values(), F.avg(F.col("right").cast("int")).alias("accuracy"), (F.avg("truth_share") / 100).alias("mean_truth"), F.avg("brier").alias("brier"))


def calibration(rows: DataFrame) -> DataFrame:
    """bucket (tenths, the last closed at 100), n, mean confidence and accuracy; empty buckets are left out."""
    bucket = F.least(F.floor(F.col("confidence") / 10), F.lit(9)).cast("int")
    return rows.where("state = 'compared'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), (F.avg("confidence") / 100).alias("confidence"), F.avg(F.col("right").cast("int")).alias("accuracy"))


def calibration_error(rows: DataFrame) -> DataFrame:
    b = calibration(rows)
    return b.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("calibration_error"))


def threshold_sweep(rows: DataFrame, thresholds: tuple[int, ...] = (50, 60, 70, 80, 90)) -> DataFrame:
    """threshold, coverage, accuracy of answers at least so sure; NaN where none is."""
    own = rows.where("state = 'compared'").select("confidence", "right", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = F.col("confidence") >= F.col("threshold")
    accuracy = F.coalesce(F.avg(F.when(kept, F.col("right").cast("int"))), F.lit(float("nan")))
    return own.groupBy("threshold").agg((F.count_if(kept) / F.count("*")).alias("coverage"), accuracy.alias("accuracy"))


def disagreements(rows: DataFrame, options: list[str]) -> DataFrame:
    """posting, label, picked, confidence of wrong answers, the surest first when ordered by confidence."""
    named = F.array(*map(F.lit, options))
    return rows.where("NOT right").select("posting", F.col("option").alias("label"), F.get(named, F.col("picked")).alias("picked"), "confidence")


# -- upserts: plain tables have no MERGE, so the new state is a query over old and incoming rows ----------------


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the greatest by ``order``; an incoming row wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order], F.desc("_new")))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_new")


def upsert_newer(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Incoming rows replace only rows of an older version: a tie keeps what is there."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.asc("_new")))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_new")


def accumulate(parts: DataFrame, keys: list[str], sums: list[str], first: str, last: str) -> DataFrame:
    """Counters of one key add up; it started with the first part and finished with the last."""
    return parts.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), *[F.sum(c).alias(c) for c in sums])


def sync(existing: DataFrame, seeds: DataFrame, denied: DataFrame) -> DataFrame:
    """id, action, status after a sync: seeds are added, kept or reactivated, denied ones denied, active ones without a seed retired."""
    e = existing.select("id", F.col("status").alias("was"))
    s, d = seeds.select("id").distinct().withColumn("seed", F.lit(True)), denied.select("id").distinct().withColumn("no", F.lit(True))
    all_ = e.join(s, "id", "full").join(d, "id", "full")
    action = (
        F.when(F.col("no"), F.when(F.col("was").isNull(), "ignored").when(F.col("was") == "denied", "kept").otherwise("denied"))
        .when(F.col("seed"), F.when(F.col("was").isNull(), "added").when(F.col("was") == "active", "kept").otherwise("reactivated"))
        .when(F.col("was") == "active", "retired").otherwise("kept")
    )
    out = all_.withColumn("action", action).where("action <> 'ignored'")
    after = F.when(F.col("action").isin("added", "reactivated"), "active").when(F.col("action").isin("denied", "retired"), F.col("action")).otherwise(F.col("was"))
    return out.select("id", "action", after.alias("status"))


def grants(requests: DataFrame, key: str, order: str, wanted: str, cap: int) -> DataFrame:
    """The requests with ``granted``: in order, each key's wants are granted up to the cap.

    What a fold would grant, by a running sum: nothing is ever given back within it.
    """
    before = F.coalesce(F.sum(wanted).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return requests.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(wanted), F.lit(cap) - before)))


def settled(granted: DataFrame, key: str, used: str) -> DataFrame:
    """key, reserved, committed, released: of what was granted what was used (never more than granted), and what goes back."""
    committed = F.least(F.col("granted"), F.coalesce(used, F.lit(0)))
    sums = granted.groupBy(key).agg(F.sum("granted").alias("reserved"), F.sum(committed).alias("committed"))
    return sums.withColumn("released", F.col("reserved") - F.col("committed"))


def share_of(column: Column, total: Column) -> Column:
    return F.try_divide(column, total)
