"""Problem 2: freely typed places to the cities of a reference list.

Names and alternates form a trie; a typed name is searched in it with a Levenshtein automaton
(swapped neighbours count as one error) whose states are memoised, so a step is a lookup.  The
allowed distance depends on the length of the reference name.  Labels are read in one narrow pass
with a cache per worker; only labels that name a city more than one place bears are joined with
the places already known of the row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: Reference entries that may be sent to every executor at once; a longer list goes in blocks.
MAX_REFERENCE = 200_000
CACHE = 200_000
ERRORS = 2

#: Words of a label that say nothing about which city (fixed values).
NOISE = frozenset("office offices floor hub campus hq headquarters area greater metro metropolitan region remote remotely hybrid onsite site on anywhere in fully home based building desk suite room the of near center centre flexible wfh telework worldwide global work from".split())

_SEPARATORS = re.compile(r"[,;:/|()\[\]{}•·\n\t]|\s[-–—]\s|\s(?:and|or|und|et|y|e)\s|[&+]", re.I)


def fold(text: str) -> str:
    """Lower case without marks; signs become spaces."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in text if not unicodedata.combining(c)).split())


def allowed(length: int) -> int:
    """Errors a reference name of so many letters may have."""
    return 0 if length < 5 else ERRORS


class Automaton:
    """Positions (letters of the typed name used, errors, swap pending) relative to the least one."""

    def __init__(self, errors: int = ERRORS):
        self.k = errors
        self.steps: dict[tuple, tuple] = {}

    def step(self, state: tuple, bits: int, left: int) -> tuple:
        """(advance of the base, state) after a letter that stands where ``bits`` are set; ``left`` letters follow the base."""
        key = (state, bits, left)
        if (found := self.steps.get(key)) is None:
            found = self.steps[key] = self._step(state, bits, left)
        return found

    def _step(self, state: tuple, bits: int, left: int) -> tuple:
        k, to = self.k, set()
        for i, e, swap in state:
            if swap:
                if bits >> i & 1:
                    to.add((i + 2, e, 0))
                continue
            if i < left and bits >> i & 1:
                to.add((i + 1, e, 0))
                continue
            if e < k:
                to.add((i, e + 1, 0))
                if i < left:
                    to.add((i + 1, e + 1, 0))
                for d in range(1, k - e + 1):
                    if i + d < left and bits >> (i + d) & 1:
                        to.add((i + d + 1, e + d, 0))
                if i + 1 < left and bits >> (i + 1) & 1:
                    to.add((i, e + 1, 1))
        kept = [p for p in to if not any(q != p and not q[2] and q[1] < p[1] and abs(q[0] - p[0]) + p[2] <= p[1] - q[1] for q in to)]
        base = min((p[0] for p in kept), default=0)
        return base, tuple(sorted((i - base, e, s) for i, e, s in kept))


class Trie:
    """Reference names; each end holds the entries that bear the name."""

    def __init__(self, names: Iterator[tuple[str, int]]):
        self.root: dict = {}
        self.exact: dict[str, list[int]] = {}
        for name, entry in names:
            if name and entry not in self.exact.setdefault(name, []):
                self.exact[name].append(entry)
        for name in self.exact:
            node = self.root
            for c in name:
                node = node.setdefault(c, {})
            node[""] = name
        self.automaton = Automaton()

    def within(self, typed: str) -> dict[str, int]:
        """All reference names within their allowed distance of ``typed``, with that distance."""
        n, k, found = len(typed), self.automaton.k, {}
        masks: dict[str, int] = {}
        for i, c in enumerate(typed):
            masks[c] = masks.get(c, 0) | 1 << i
        window, step = (1 << 2 * k + 2) - 1, self.automaton.step
        stack = [(self.root, 0, ((0, 0, 0),))]
        while stack:
            node, base, state = stack.pop()
            for c, child in node.items():
                if not c:
                    least = min((e + n - base - i for i, e, s in state if not s), default=k + 1)
                    if least <= allowed(len(child)):
                        found[child] = least
                    continue
                gone, to = step(state, masks.get(c, 0) >> base & window, min(n - base, 2 * k + 2))
                if to:
                    stack.append((child, base + gone, to))
        return found


def joined(name: str) -> str:
    return fold(name).replace(" ", "")


class Areas:
    """Countries and divisions by joined name or code."""

    def __init__(self, rows: Iterable[tuple]):
        """``rows``: (country, country_name, division, division_name)."""
        self.countries: dict[str, set[str]] = {}
        self.divisions: dict[str, set[tuple[str, str]]] = {}
        self.division_codes: set[str] = set()
        for country, country_name, division, division_name in rows:
            for name in (country, country_name):
                if name:
                    self.countries.setdefault(joined(name), set()).add(country)
            if division_name:
                self.divisions.setdefault(joined(division_name), set()).add((country, division))
            if division:
                self.division_codes.add(joined(division))


class Reader:
    """Reads labels against rows (city_id, city_name, country, country_name, division, division_name, population, alternates)."""

    def __init__(self, rows: list[tuple], areas: Areas | None = None):
        self.cities = rows
        self.trie = Trie((joined(name), i) for i, r in enumerate(rows) for name in [r[1], *(r[7] or [])] if name)
        areas = areas or Areas(r[2:6] for r in rows)
        self.countries, self.divisions, self.division_codes = areas.countries, areas.divisions, areas.division_codes
        self.cache: dict[str, list[list[int]]] = {}

    def read(self, label: str | None) -> list[list[int]]:
        """For each city the label names, the rows that bear its name and that the label's country or division admit."""
        if not label:
            return []
        if (found := self.cache.get(label)) is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.cache[label] = self._read(label)
        return found

    def _read(self, label: str) -> list[list[int]]:
        countries: set[str] = set()
        divisions: set[tuple[str, str]] = set()
        codes: set[str] = set()
        named: dict[tuple[int, ...], None] = {}
        for part in _SEPARATORS.split(unicodedata.normalize("NFKC", label)):
            words = fold(part).split()
            while words and (words[0] in NOISE or words[0].isdigit()):
                words.pop(0)
            while words and (words[-1] in NOISE or words[-1].isdigit()):
                words.pop()
            while len(words) > 1 and "-" in part and (words[0] in self.countries or words[0] in self.division_codes):
                (codes if words[0] not in self.countries else countries).update({words[0]} if words[0] not in self.countries else self.countries[words[0]])
                words.pop(0)
            if not words:
                continue
            for tried in self._cuts(words, countries, divisions):
                if tried in self.countries and tried not in self.trie.exact:
                    countries |= self.countries[tried]
                elif tried in self.divisions and tried not in self.trie.exact:
                    divisions |= self.divisions[tried]
                elif tried in self.division_codes:
                    codes.add(tried)
                elif found := self._closest(tried):
                    named[tuple(found)] = None
        out = []
        for cities in named:
            for admitted in ((c for c in cities if self.cities[c][2] in countries), (c for c in cities if (self.cities[c][2], self.cities[c][4]) in divisions), (c for c in cities if fold(self.cities[c][4] or "") in codes)):
                cities = [*admitted] or cities
            out.append([*cities])
        return out

    def _cuts(self, words: list[str], countries: set[str], divisions: set[tuple[str, str]]) -> list[str]:
        """The part as one name, or without a country or division that stands before or after it."""
        whole = "".join(words)
        if len(words) > 1 and whole not in self.trie.exact and whole not in self.countries and whole not in self.divisions:
            for head, rest in ((words[-1], words[:-1]), (words[0], words[1:])):
                if head in self.countries or head in self.divisions:
                    return [head, "".join(rest)]
        return [whole]

    def _closest(self, typed: str) -> list[int]:
        if typed in self.trie.exact:
            return self.trie.exact[typed]
        if len(typed) < 5 - ERRORS:
            return []
        near = self.trie.within(typed)
        if not near:
            return []
        least = min(near.values())
        return sorted({i for name, d in near.items() if d == least for i in self.trie.exact[name]})


def read_labels(labels: DataFrame, gazetteer: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """id, loc_pos, city_id: each entry of ``labels`` (id, labels: array<string>) that is no canonical label.

    One row for each city the entry names, or one with city_id 0.  ``places`` (id, country, one row
    each) decides between cities of one name when the label doesn't; then population decides, then
    the lower id.  Null and empty entries name none, null lists and null ids have no entries, rows delivered
    twice count once.  Other columns are not read.
    """
    cities = gazetteer.where("city_id IS NOT NULL").select(*COLUMNS)
    own = labels.select(F.col("id").cast("string").alias("id"), F.col("labels").cast("array<string>").alias("labels")).where("id IS NOT NULL AND size(labels) > 0")
    if cities.count() <= MAX_REFERENCE:
        return _settled(_read(own, [tuple(r) for r in cities.collect()], None), places)
    # a longer list: every distinct label is first met with blocks of it, and read against the rows it came near
    areas = [tuple(r) for r in cities.select("country", "country_name", "division", "division_name").distinct().collect()]  # as many as there are divisions
    each = own.select("id", F.posexplode("labels").alias("loc_pos", "label")).withColumn("label", F.coalesce("label", F.lit("")))
    distinct = cut(each.select("label").distinct())
    near = cut(_near(distinct, cities))
    blocks = max(1, -(-near.count() // MAX_REFERENCE))
    at = F.pmod(F.xxhash64("label"), blocks)
    parts = []
    for b in range(blocks):
        rows = cities.join(near.where(at == b).select("city_id").distinct(), "city_id").select(*COLUMNS)
        parts.append(_read(distinct.where(at == b).select(F.col("label").alias("id"), F.array("label").alias("labels")), [tuple(r) for r in rows.collect()], areas))
    read = functools.reduce(DataFrame.unionAll, parts).select(F.col("id").alias("label"), "n", "cities", "countries")
    return _settled(each.join(read, "label").select("id", "loc_pos", "n", "cities", "countries"), places)


COLUMNS = ["city_id", "city_name", "country", "country_name", "division", "division_name", "population", "alternates", "canonical_label"]


def _tried(label: str | None, areas: Areas) -> set[str]:
    """All names a label may be tried as, whatever the reference list holds."""
    out: set[str] = set()
    for part in _SEPARATORS.split(unicodedata.normalize("NFKC", label or "")):
        words = fold(part).split()
        while words and (words[0] in NOISE or words[0].isdigit()):
            words.pop(0)
        while words and (words[-1] in NOISE or words[-1].isdigit()):
            words.pop()
        while words:
            out |= {"".join(words), "".join(words[:-1]), "".join(words[1:]), words[0], words[-1]}
            if not (len(words) > 1 and "-" in part and (words[0] in areas.countries or words[0] in areas.division_codes)):
                break
            words.pop(0)
    return out - {""}


def _near(labels: DataFrame, cities: DataFrame) -> DataFrame:
    """label, city_id: the reference rows that bear one of the closest names to what the label is tried as, and exact canonical labels."""
    spark = labels.sparkSession
    areas = Areas(tuple(r) for r in cities.select("country", "country_name", "division", "division_name").distinct().collect())
    shared_areas = spark.sparkContext.broadcast(areas)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(label, t) for label in batch.column(0).to_pylist() for t in _tried(label, shared_areas.value)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["label", "typed"])

    typed = cut(labels.where("label IS NOT NULL").mapInArrow(tries, "label string, typed string").distinct())
    names = typed.select("typed").distinct()
    blocks = -(-cities.count() // MAX_REFERENCE)
    found = None
    for block in range(blocks):
        rows = cities.where(F.pmod(F.xxhash64("city_id"), blocks) == block).select("city_id", "city_name", "alternates")
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = Trie((joined(name), city) for city, name_, others in shared.value for name in [name_, *(others or [])] if name)
            for batch in batches:
                out: list[tuple[str, int, int]] = []
                for t in batch.column(0).to_pylist():
                    near = {t: 0} if t in trie.exact else trie.within(t) if len(t) >= 5 - ERRORS else {}
                    least = min(near.values(), default=0)
                    out += [(t, least, city) for name, d in near.items() if d == least for city in trie.exact[name]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["typed", "errors", "city_id"])

        part = names.mapInArrow(run, "typed string, errors int, city_id bigint")
        found = part if found is None else found.unionAll(part)
    found = cut(found)
    least = found.groupBy("typed").agg(F.min("errors").alias("errors"))
    near = found.join(least, ["typed", "errors"]).select("typed", "city_id")
    exact = labels.join(cities.select(F.col("canonical_label").alias("label"), "city_id"), "label")
    return typed.join(near, "typed").select("label", "city_id").unionAll(exact.select("label", "city_id")).distinct()


def _read(labels: DataFrame, reference: list[tuple], areas: list[tuple] | None) -> DataFrame:
    shared = labels.sparkSession.sparkContext.broadcast((sorted(reference, key=lambda r: r[0]), areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, areas = shared.value
        reader, canonical = Reader([r[:8] for r in rows], Areas(areas) if areas is not None else None), {r[8] for r in rows}
        order = sorted(range(len(rows)), key=lambda i: (-(rows[i][6] or 0), rows[i][0]))
        rank = {i: n for n, i in enumerate(order)}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pos, entry in enumerate(entries or []):
                    if entry in canonical:
                        continue
                    named = reader.read(entry)
                    for n, cities in enumerate(named or [[]]):
                        ranked = sorted(cities, key=rank.__getitem__)
                        for col, x in zip(out, (key, pos, n, [rows[c][0] for c in ranked] or [0], [rows[c][2] or "" for c in ranked] or [""])):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["id", "loc_pos", "n", "cities", "countries"])

    return labels.mapInArrow(run, "id string, loc_pos int, n int, cities array<bigint>, countries array<string>")


def _settled(read: DataFrame, places: DataFrame | None) -> DataFrame:
    """One city of those that a label names alike: in a country known of the row, or the most populous."""
    first = F.col("cities")[0]
    if places is None:
        return read.select("id", "loc_pos", first.alias("city_id")).distinct()
    known = places.where("id IS NOT NULL AND country IS NOT NULL").groupBy("id").agg(F.collect_set("country").alias("known"))  # as many as there are countries
    both = read.join(known, "id", "left")
    at = F.array_position(F.transform("countries", lambda c: F.array_contains("known", c)), True).cast("int")
    city = F.when((F.size("cities") > 1) & (F.coalesce(at, F.lit(0)) > 0), F.element_at("cities", at)).otherwise(first)
    return both.select("id", "loc_pos", city.alias("city_id")).distinct()
