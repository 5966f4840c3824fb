"""Questions: their registry and checks, what a run would ask within an allowance, and asking a scorer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical

KINDS = ("yes-no", "choice", "scale")
MAX_QUESTION, MAX_LABEL, MAX_CHOICES, MAX_LEVELS = 500, 120, 255, 10
STOPS = ("budget", "deadline", "errors", "finished")


@dataclass(frozen=True)
class Question:
    id: str
    kind: str
    text: str
    options: tuple[str, ...]
    version: int = 1


#: Questions asked of every posting.
STANDARD = (
    Question("arrangement", "choice", "Where is the work done?", ("remote", "hybrid", "onsite", "not_stated")),
    Question("on_call", "yes-no", "Does the work include being on call?", ("no", "yes")),
)


def registry(spark: SparkSession, questions: tuple[Question, ...] = STANDARD) -> DataFrame:
    """question, version, kind, option, place: one row an option."""
    rows = [(q.id, q.version, q.kind, o, i) for q in questions for i, o in enumerate(q.options)]
    return spark.createDataFrame(rows, "question string, version int, kind string, option string, place int")


def criterion(kind: str, text: str, choices: tuple[str, ...] = ()) -> Question:
    """A question someone wrote, checked and named by the hash of what it says."""
    text, choices = " ".join(text.split()), tuple(" ".join(c.split()) for c in choices)
    if kind not in KINDS:
        raise ValueError("unknown kind")
    if not 0 < len(text) <= MAX_QUESTION:
        raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
    if kind == "yes-no":
        if choices:
            raise ValueError("a yes-no question has no choices")
        options = ("no", "yes")
    else:
        most = MAX_CHOICES if kind == "choice" else MAX_LEVELS
        if not 2 <= len(choices) <= most or len({c.lower() for c in choices}) < len(choices) or any(not 0 < len(c) <= MAX_LABEL for c in choices):
            raise ValueError(f"2 to {most} different labels of 1 to {MAX_LABEL} characters")
        options = choices if kind == "choice" else tuple(map(str, range(len(choices))))
    named = hashlib.sha256(canonical({"kind": kind, "question": text, "choices": list(choices)}).encode()).hexdigest()
    return Question(named, kind, text, options)


def model_state(postings: DataFrame) -> DataFrame:
    """id, state: what a scorer is shown of a posting, as JSON."""
    return postings.select("id", F.to_json(F.struct("title", "company", F.from_json("locations_json", "array<string>").alias("locations"), "description")).alias("state"))


def planned(units: DataFrame, cost: str, order: list, allowance: int) -> DataFrame:
    """The units that fit the allowance, in order, with what was spent before each: a running sum, not a loop.

    Sums are taken by day (or any coarse leading key of ``order``) first, so no task holds all units.
    """
    head = order[0]
    days = units.groupBy(F.col(head).alias("_d")).agg(F.sum(cost).alias("_n"))
    earlier = Window.orderBy(F.desc_nulls_last("_d")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") <= allowance)
    inside = Window.partitionBy(head).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    kept = units.join(days, units[head].eqNullSafe(days["_d"]))
    kept = kept.withColumn("spent", F.col("_before") + F.coalesce(F.sum(cost).over(inside), F.lit(0)))
    return kept.where(F.col("spent") + F.col(cost) <= allowance).drop("_d", "_n", "_before")


def asked(texts: DataFrame, question: Question, scorer: Callable[[list[str]], list[list[int]]]) -> DataFrame:
    """content_hash, question, distribution: each distinct text asked once; answers of a wrong width or sum are null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            given = scorer(p["text"].tolist())
            read = [d if len(d) == len(question.options) and sum(d) == 100 and min(d) >= 0 else None for d in given]
            yield pd.DataFrame({"content_hash": p["content_hash"], "question": question.id, "distribution": read})

    one = texts.where("content_hash IS NOT NULL AND text IS NOT NULL").groupBy("content_hash").agg(F.min("text").alias("text"))
    return one.mapInPandas(run, "content_hash string, question string, distribution array<int>")


#: Failures in a row after which a worker asks no more.
FAILURES = 5


def asked_together(units: DataFrame, questions: tuple[Question, ...], scorer: Callable[[str, list[str]], dict[str, list[int]]]) -> DataFrame:
    """content_hash, question, distribution, stopped: one request a text, for all questions it lacks.

    ``units``: content_hash, text, missing (ids of questions).  Answers of a wrong width or sum are null, and so
    are those of a request that failed; after FAILURES failed requests in a row the rest of the task's texts are
    not asked (``stopped``) and stay as they are for the next run.
    """
    width = {q.id: len(q.options) for q in questions}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for p in parts:
            rows = []
            for key, text, missing in zip(p["content_hash"], p["text"], p["missing"]):
                wanted, given = [q for q in missing if q in width], {}
                stopped = failed >= FAILURES
                if not stopped:
                    try:
                        given = scorer(text, wanted)
                        failed = 0
                    except Exception:
                        failed += 1
                for q in wanted:
                    d = given.get(q)
                    ok = d is not None and len(d) == width[q] and sum(d) == 100 and min(d) >= 0
                    rows.append((key, q, d if ok else None, stopped))
            yield pd.DataFrame(rows, columns=["content_hash", "question", "distribution", "stopped"])

    one = units.where("content_hash IS NOT NULL AND text IS NOT NULL AND size(missing) > 0").select("content_hash", "text", "missing")
    return one.mapInPandas(run, "content_hash string, question string, distribution array<int>, stopped boolean")


def stop_reason(runs: DataFrame) -> DataFrame:
    """run_id, reason: of the reasons a run's parts stopped for the weightiest."""
    rank = F.array_position(F.array(*map(F.lit, STOPS)), F.col("reason"))
    return runs.groupBy("run_id").agg(F.min_by("reason", rank).alias("reason"))


def merged(held: DataFrame, newer: DataFrame) -> DataFrame:
    """id, distribution, at: of two answers to a posting the newer."""
    return held.unionByName(newer).groupBy("id").agg(F.max_by("distribution", "at").alias("distribution"), F.max("at").alias("at"))
