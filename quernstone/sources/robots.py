"""robots.txt rules as rows, and whether they allow a path."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file that are read, as the standard asks for at least.
LIMIT = 512 * 1024


def parse(body: str) -> list[tuple[str, bool, str]]:
    """(agent, allow, pattern) of each rule, agents in lower case; consecutive agent lines share the rules that follow."""
    rules, agents, open_ = [], [], False
    for line in body.encode()[:LIMIT].decode(errors="ignore").lstrip("﻿").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*(agents if open_ else []), value.lower()]
            open_ = True
        elif name in ("allow", "disallow"):
            open_ = False
            if value:
                rules += [(a, name == "allow", value) for a in agents]
        elif name == "crawl-delay":
            open_ = False
    return rules


def delays(body: str) -> dict[str, float]:
    """The longest crawl delay stated for each agent."""
    out: dict[str, float] = {}
    agents: list[str] = []
    open_ = False
    for line in body.splitlines():
        name, _, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents, open_ = [*(agents if open_ else []), value.lower()], True
        elif name:
            open_ = False
            if name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                for a in agents:
                    out[a] = max(out.get(a, 0.0), float(value))
    return out


def pattern(rule: str) -> str:
    """A rule as a regular expression from the start of a path; ``*`` is anything, a last ``$`` the end."""
    end = rule.endswith("$")
    body = ".*".join(re.escape(p) for p in unquote(rule.removesuffix("$")).split("*"))
    return f"^{body}{'$' if end else ''}"


def rules_table(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, agent, allow, rule, pattern of each robots.txt in ``body``."""

    def run(batches):
        for batch in batches:
            rows = [(k, *r, pattern(r[2])) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse(b or "")]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "agent", "allow", "rule", "pattern"])

    return df.select(F.col(key).cast("string"), F.col(body).cast("string")).mapInArrow(run, "host string, agent string, allow boolean, rule string, pattern string")


def allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """host, path, allowed: the group of the agent, else of ``*``; the longest rule that matches wins, allow wins ties.

    ``/robots.txt`` is always allowed, and so is what no rule matches.
    """
    own = rules.where(F.col("agent").isin(agent.lower(), "*"))
    named = own.groupBy("host").agg(F.max((F.col("agent") == agent.lower())).alias("named"))
    own = own.join(named, "host").where(F.col("named") == (F.col("agent") == agent.lower()))
    hits = paths.select("host", "path").distinct().join(own, "host", "left")
    match = F.coalesce(F.expr("coalesce(try_url_decode(replace(path, '+', '%2B')), path) RLIKE pattern"), F.lit(False))
    best = F.max(F.when(match, F.struct(F.length("rule").alias("n"), F.col("allow").alias("allow"))))
    out = hits.groupBy("host", "path").agg(best.alias("best"))
    return out.select("host", "path", (F.coalesce(F.col("best.allow"), F.lit(True)) | (F.col("path") == "/robots.txt")).alias("allowed"))


def backoff_ms(attempt: int, random: float, base: int = 1000, cap: int = 30_000) -> int:
    """Full jitter: any time up to the doubled base, at most the cap."""
    return int(random * min(cap, base * 2 ** (attempt - 1)))


def retry_after_ms(value: str | None, now_ms: int) -> int | None:
    """Seconds or an HTTP date, as milliseconds from now; None if it is neither."""
    from email.utils import parsedate_to_datetime

    if not value:
        return None
    if value.strip().isdigit():
        return int(value) * 1000
    try:
        return max(0, int(parsedate_to_datetime(value).timestamp() * 1000) - now_ms)
    except (ValueError, TypeError):
        return None
