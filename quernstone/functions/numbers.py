"""Probabilities in hundredths, and pay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Periods of a year by which stated amounts are multiplied (fixed values).
PER_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}


def hundredths(values: Column) -> Column:
    """Shares as integers that sum to 100: largest remainders are rounded up, ties from the left."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    scaled = F.transform(values, lambda x: x / total * F.lit(100.0))
    floors = F.transform(scaled, lambda x: F.floor(x).cast("int"))
    spare = F.lit(100) - F.aggregate(floors, F.lit(0), lambda a, x: a + x)
    order = F.array_sort(F.transform(scaled, lambda x, i: F.struct((F.floor(x) - x).alias("f"), i.alias("i"))))
    up = F.transform(F.slice(order, 1, F.greatest(spare, F.lit(0))), lambda s: s["i"])
    return F.when(total > 0, F.transform(floors, lambda x, i: x + F.array_contains(up, i).cast("int")))


def _probability(c: Column) -> Column:
    return c.isNotNull() & (c >= 0) & (c <= 1)


def read_yes_no(answer: Column) -> Column:
    """``{"type":"noul","noul":p}`` as [no, yes] in hundredths, null for anything else."""
    read = F.from_json(answer, "type string, noul double")
    return F.when((read["type"] == "noul") & _probability(read["noul"]), hundredths(F.array(1.0 - read["noul"], read["noul"])))


def read_choice(answer: Column, options: list[str], kind: str = "choice") -> Column:
    """The ``probabilities`` of an answer over ``options`` in hundredths, null unless it has exactly those and they sum to one."""
    read = F.from_json(answer, "type string, probabilities map<string,double>")
    given = read["probabilities"]
    values = F.array(*[F.try_element_at(given, F.lit(o)) for o in options])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    near = F.abs(total - 1) <= F.greatest(F.lit(0.01), F.lit(len(options) * 0.005)) + 1e-9
    ok = (read["type"] == kind) & (F.size(given) == len(options)) & F.forall(values, _probability) & near
    return F.when(F.coalesce(ok, F.lit(False)), hundredths(values))


def likeliest(distribution: Column) -> Column:
    """Place (from 0) of the greatest share, the first of equals."""
    best = F.array_max(F.transform(distribution, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    return (-best["i"]).cast("int")


def probability_of(distribution: Column, places: list[int]) -> Column:
    return sum((F.coalesce(F.try_element_at(distribution, F.lit(i + 1)), F.lit(0)) for i in places), F.lit(0))


def annual(amount: Column, interval: Column) -> Column:
    """The amount for a year, rounded, halves up; null for an unknown interval."""
    factor = F.create_map(*[x for k, v in PER_YEAR.items() for x in (F.lit(k), F.lit(v))])
    return F.floor(amount * F.try_element_at(factor, interval) + 0.5).cast("double")


def pay_reach(low: Column, high: Column) -> Column:
    """The most that stated pay comes to."""
    return F.greatest(low, high)


def salary_range(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """A struct of the bounds, null without an ISO currency, a known interval and a bound that is not negative."""
    lo, hi = F.when(low >= 0, low), F.when(high >= 0, high)
    ok = currency.rlike("^[A-Z]{3}$") & interval.isin(*PER_YEAR) & (lo.isNotNull() | hi.isNotNull())
    return F.when(ok, F.struct(lo.alias("min"), hi.alias("max"), currency.alias("currency"), interval.alias("interval")))


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: a quarter of its bytes, and one."""
    return F.ceil((F.octet_length(text) + 1) / 4.0).cast("bigint")
