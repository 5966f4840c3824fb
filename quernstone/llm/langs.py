"""Problem 1: the language of each text and of each of its parts, with a confidence.

Rank-order profiles: a language is the list of its most frequent n-grams; a part's n-grams, most
frequent first, are compared with it by the sum of how far out of place each stands.  Profiles are
fitted on a bounded sample of labelled rows, twice: parts of the sample that the first profiles
place elsewhere than their label does not count in the second.  Classification is one narrow,
vectorised pass over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import kinds_of, render
from .repeats import once

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt")
#: Labelled rows the profiles are fitted on: those with the least hash of their id.
SAMPLE = 2000
#: N-grams of a profile, and the sizes of an n-gram (a word has a blank before and after it).
PROFILE, SIZES = 2500, (1, 2, 3, 4)
#: The rank of an n-gram that a profile lacks, and the words whose n-grams a worker remembers.
_NOWHERE, MOST_WORDS = 30_000, 500_000
#: Words a part must have to say that a text holds its language.
LEAST_WORDS = 8

#: English and own names and codes of the languages (fixed values).
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}
MISSING = ("", "und", "unknown")

#: A few plain sentences each, so that a table without labels can be read too.
SEEDS = {
    "en": "The people who work here know that it is not easy to say what will come next, but they have always been there for each other. We would like to hear from you if you can help us with this and have some time for it. There are many things that should be done before the end of the year, which is why we are looking for someone.",
    "de": "Die Menschen, die hier arbeiten, wissen, dass es nicht einfach ist zu sagen, was als nächstes kommt, aber sie waren immer füreinander da. Wir würden gerne von dir hören, wenn du uns dabei helfen kannst und etwas Zeit dafür hast. Es gibt viele Dinge, die vor dem Ende des Jahres noch getan werden müssen, und deshalb suchen wir jemanden.",
    "fr": "Les personnes qui travaillent ici savent qu'il n'est pas facile de dire ce qui va suivre, mais elles ont toujours été là les unes pour les autres. Nous aimerions avoir de vos nouvelles si vous pouvez nous aider et si vous avez un peu de temps. Il y a beaucoup de choses à faire avant la fin de l'année, c'est pourquoi nous cherchons quelqu'un.",
    "es": "Las personas que trabajan aquí saben que no es fácil decir lo que vendrá después, pero siempre han estado ahí los unos para los otros. Nos gustaría saber de ti si puedes ayudarnos con esto y tienes algo de tiempo para ello. Hay muchas cosas que se deben hacer antes del final del año y por eso estamos buscando a alguien.",
    "it": "Le persone che lavorano qui sanno che non è facile dire che cosa verrà dopo, ma ci sono sempre state l'una per l'altra. Ci piacerebbe avere tue notizie se puoi aiutarci in questo e hai un po' di tempo. Ci sono molte cose che devono essere fatte prima della fine dell'anno ed è per questo che stiamo cercando qualcuno.",
    "nl": "De mensen die hier werken weten dat het niet makkelijk is om te zeggen wat er hierna komt, maar ze zijn er altijd voor elkaar geweest. Wij horen graag van je als je ons hierbij kunt helpen en er wat tijd voor hebt. Er zijn veel dingen die voor het einde van het jaar nog gedaan moeten worden en daarom zoeken wij iemand.",
    "pt": "As pessoas que trabalham aqui sabem que não é fácil dizer o que virá a seguir, mas sempre estiveram lá umas para as outras. Gostaríamos de ter notícias tuas se nos puderes ajudar com isto e tiveres algum tempo. Há muitas coisas que devem ser feitas antes do fim do ano e é por isso que estamos à procura de alguém.",
}

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=\S)")
_ENTRY = re.compile(r"^\s*(?:[-–—•*+·▪◦‣]|\(?\d{1,3}[.)])\s*")
_HEADING = re.compile(r"#{1,6} ")


def named(tag: str | None) -> str | None:
    """The language a tag names: a code of ours, "?" for any other, None if it is missing."""
    tag = (tag or "").strip().lower()
    if tag in MISSING:
        return None
    return _BY_NAME.get(re.split(r"[-_\s]", tag, maxsplit=1)[0], _BY_NAME.get(tag, "?"))


def pieces(text: str | None) -> list[tuple[str, bool]]:
    """The sentences of a text without markup, and whether each stands in a list entry, a heading or code."""
    if not text:
        return []
    kinds = kinds_of(text)
    text = unicodedata.normalize("NFC", render(text, kinds)[0])
    out = []
    code = False
    for line in text.split("\n"):
        line = line.strip()
        if kinds and line == "```":
            code = not code
        elif line:
            head = _HEADING.match(line) if kinds else None
            if code or head:
                out.append((line[head.end() :] if head else line, True))
                continue
            entry = _ENTRY.match(line)
            at = entry.end() if entry else 0
            first, *rest = _END.split(line[at:])
            out += [(s, bool(entry)) for s in (line[:at] + first, *rest) if s.strip()]
    return out


def parts(text: str | None) -> list[str]:
    """The sentences of a text, without markup and list entries."""
    return [s for s, entry in pieces(text) if not entry]


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


class Profiles:
    """Rank of each known n-gram in each language; no distance is over PROFILE."""

    def __init__(self, counts: dict[str, Counter]):
        tops = {code: [g for g, _ in sorted(counts[code].items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for code in LANGUAGES}
        overall: Counter = Counter()
        for code in LANGUAGES:
            total = sum(counts[code].values()) or 1
            for g in tops[code]:
                overall[g] += counts[code][g] / total
        known = sorted(overall, key=lambda g: (-overall[g], g))
        self.ids = {g: i for i, g in enumerate(known)}  # ties of a part's ranking go by this order
        self.ranks = np.full((len(LANGUAGES), len(known)), _NOWHERE, np.int16)
        for j, code in enumerate(LANGUAGES):
            for rank, g in enumerate(tops[code]):
                self.ranks[j, self.ids[g]] = rank
        self._forget()

    def _forget(self) -> None:
        """The words met so far, numbered, with the n-grams of word i at begin[i] to begin[i + 1] of ``flat``."""
        self.words: dict[str, int] = {}
        self.begin, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > MOST_WORDS:
            self._forget()
        for w in {w for w in words if w not in self.words}:
            own = [i for g in grams(w) if (i := self.ids.get(g)) is not None]
            at = len(self.words)
            self.words[w] = at
            begin = self.begin[at]
            if at + 2 > len(self.begin):
                self.begin = np.append(self.begin, np.zeros_like(self.begin))
            while begin + len(own) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[begin : begin + len(own)] = own
            self.begin[at + 1] = begin + len(own)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def distances(self, texts: list[list[str]]) -> np.ndarray:
        """texts (as lower-case words) x languages: the mean out-of-place distance of the known n-grams of each text."""
        out = np.full((len(texts), len(LANGUAGES)), float(PROFILE))
        for at in range(0, len(texts), 1000):
            own = texts[at : at + 1000]
            word = self._numbers([w for t in own for w in t])
            of = np.repeat(np.arange(len(own)), [len(t) for t in own])
            many = self.begin[word + 1] - self.begin[word]
            if not many.sum():
                continue
            of = np.repeat(of, many)
            gram = self.flat[np.repeat(self.begin[word] - (np.cumsum(many) - many), many) + np.arange(len(of))]
            key = np.sort((of << 20) | gram)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(new, len(key)))
            key = key[new]
            # one sort of packed keys: text, then most frequent first, ties by the overall order
            low = (1 << 20) - 1
            packed = np.sort((key >> 20 << 40) | (low - np.minimum(n, low) << 20) | (key & low))
            text, gram = packed >> 40, packed & low
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            many = np.diff(np.append(first, len(text)))
            rank = np.minimum(np.arange(len(text)) - np.repeat(first, many), _NOWHERE - 2 * PROFILE).astype(np.int16)
            for j, known in enumerate(self.ranks):  # an n-gram that is in no profile is farther than PROFILE
                apart = np.minimum(np.abs(known[gram] - rank), PROFILE)
                out[at + text[first], j] = np.add.reduceat(apart, first, dtype=np.int64) / many
        return out

    def read(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and confidence of each: the share by which the next best is farther, from 0 to 1."""
        return self.read_words([_WORD.findall(t.lower()) for t in texts])

    def read_words(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        if not texts:
            return []
        d = self.distances(texts)
        best = d.argmin(1)
        two = np.sort(d, axis=1)[:, :2]
        sure = np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9), 0, 1)
        return [(LANGUAGES[i], float(s)) for i, s in zip(best.tolist(), np.round(sure, 4).tolist())]


def _counted(pairs: list[tuple[str, str]]) -> dict[str, Counter]:
    words = {code: Counter() for code in LANGUAGES}
    for code, text in pairs:
        words[code].update(_WORD.findall(text.lower()))
    counts = {code: Counter() for code in LANGUAGES}
    for code in LANGUAGES:
        for w, n in words[code].items():
            if not w.isdigit():
                for g in grams(w):
                    counts[code][g] += n
    return counts


def fit(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles from (language, text) pairs whose labels are mostly right, and the seeds."""
    seeds = list(SEEDS.items())
    sentences = [(code, s) for code, text in labelled for s in parts(text) if len(_WORD.findall(s)) >= LEAST_WORDS]
    found = Profiles(_counted(seeds + sentences))
    agreed = [p for p, (code, _) in zip(sentences, found.read([s for _, s in sentences])) if code == p[0]]
    return Profiles(_counted(seeds + agreed))


def fit_on(df: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most ``sample`` rows with a tag that names one of our languages."""
    tag = F.regexp_extract(F.lower(F.trim(f"`{lang}`")), r"^([^\W\d_]+)", 1)
    rows = df.select(tag.alias("tag"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{key}`").alias("h")).where(F.col("tag").isin(sorted(_BY_NAME)) & (F.length("text") > 0))
    return fit([(_BY_NAME[r.tag], r.text) for r in rows.orderBy("h", "text").limit(sample).collect()])


def classify(df: DataFrame, key: str, text: str, title: str, lang: str, profiles: Profiles | None = None, repeats: bool = False, counted_only: bool = False) -> DataFrame:
    """key, stated, main, confidence, parts (array of lang, confidence, words, text, counted) of each row.

    ``parts`` are the sentences of the text with a word, or the title where the text is blank; sentences of
    under LEAST_WORDS words and list entries are not ``counted`` (with ``counted_only`` they are left out).
    Neighbours of one language, both counted or both not, are joined.  ``main`` has the most words of the
    counted parts, or of all where none counts, ties go to the language met first; null if there is no part.  Null keys are left out, nulls elsewhere count as blank,
    rows delivered twice count once (with ``repeats`` they stay, for callers that take distinct results).
    """
    c = lambda name: F.col(f"`{name}`").cast("string")
    shared = df.sparkSession.sparkContext.broadcast(profiles or fit_on(df, key, text, lang))
    rows = df.select(c(key).alias("id"), c(text).alias("text"), c(title).alias("title"), c(lang).alias("tag")).where("id IS NOT NULL")
    rows = rows if repeats else once(rows)
    part = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("text", pa.string()), ("counted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, texts, titles, tags = (col.to_pylist() for col in some.columns)
                sentences, of, split, counts = [], [], [], []
                for i, (t, head) in enumerate(zip(texts, titles)):
                    blank = not (t or "").strip()
                    for s, entry in [(head or "", False)] if blank else pieces(t):
                        if entry and counted_only:
                            continue
                        own = _WORD.findall(s.lower())
                        counted = blank and bool(s.strip()) or len(own) >= LEAST_WORDS and not entry
                        if counted or own and not counted_only:
                            sentences.append(s)
                            of.append(i)
                            split.append(own)
                            counts.append(counted)
                joined: list[list[dict]] = [[] for _ in ids]
                for i, s, n, counted, (code, sure) in zip(of, sentences, map(len, split), counts, held.read_words(split)):
                    own = joined[i]
                    if own and (own[-1]["lang"], own[-1]["counted"]) == (code, counted):
                        last = own[-1]
                        last["confidence"] = round((last["confidence"] * last["words"] + sure * n) / (last["words"] + n), 4)
                        last["words"] += n
                        last["text"] += " " + s
                    else:
                        own.append({"lang": code, "confidence": sure, "words": n, "text": s, "counted": counted})
                main, sure = [], []
                for own in joined:
                    own = [p for p in own if p["counted"]] or own
                    total: Counter = Counter()
                    for p in own:
                        total[p["lang"]] += p["words"]
                    best = max(total, key=total.get) if total else None
                    main.append(best)
                    sure.append(round(sum(p["confidence"] * p["words"] for p in own if p["lang"] == best) / sum(total.values()), 4) if best else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([named(t) for t in tags], pa.string()), pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(joined, pa.list_(part))],
                    names=["id", "stated", "main", "confidence", "parts"],
                )

    return rows.mapInArrow(run, "id string, stated string, main string, confidence double, parts array<struct<lang: string, confidence: double, words: int, text: string, counted: boolean>>")


def mislabelled(classified: DataFrame) -> DataFrame:
    """id, found_lang: each language of rows whose tag is missing or names another than the main one, or that mix languages."""
    langs = F.array_distinct(F.transform(F.filter("parts", lambda p: p["counted"]), lambda p: p["lang"]))
    wrong = F.col("stated").isNull() | (F.col("stated") != F.col("main")) | (F.size(langs) > 1)
    return classified.where(wrong).select("id", F.explode(langs).alias("found_lang")).distinct()
