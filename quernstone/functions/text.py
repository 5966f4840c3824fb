"""String functions: folding, cleaning, HTML to text, employment words, placeholders."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html_blocks import text_of_html

#: White space as the stored texts mean it: Java's \s has no no-break space (fixed value).
SPACE = r"[\s\p{Z}\x{FEFF}]"


def fold_text(text: str) -> str:
    """Compatibility decomposition, without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).lower()


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


def name_folded(text: str) -> str:
    """Folded, without periods, apostrophes and backticks, dashes and blanks as one blank."""
    return " ".join("".join(" " if unicodedata.category(c) == "Pd" else c for c in fold_text(text) if c not in ".'`\u2018\u2019").split())


@F.pandas_udf(StringType())
def fold_name(text: pd.Series) -> pd.Series:
    return text.map(name_folded, na_action="ignore")


def clean_text(c: Column) -> Column:
    """Runs of white space as one blank, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def clean_list(c: Column) -> Column:
    """The cleaned entries, each once, first come first."""
    return F.array_distinct(F.array_compact(F.transform(c, clean_text)))


def place_text(parts: Column) -> Column:
    """The cleaned parts joined by commas, a part that differs from an earlier one in case alone left out; null if none."""
    cleaned = F.array_compact(F.transform(parts, clean_text))
    first = F.filter(cleaned, lambda x, i: F.array_position(F.transform(cleaned, F.lower), F.lower(x)) == i + 1)
    return F.nullif(F.array_join(first, ", "), F.lit(""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@F.pandas_udf(StringType())
def html_to_text(source: pd.Series) -> pd.Series:
    return source.map(text_of_html, na_action="ignore")


#: Words that name an employment type (fixed values).
EMPLOYMENT_WORDS = {
    "full-time": r"\bfull ?time\b",
    "part-time": r"\b(part ?time|working student|werkstudent)\b",
    "contract": r"\b(contract|contractor|freelance|freelancer|project based)\b",
    "internship": r"\b(intern|internship|trainee|apprentice|apprenticeship|alternance|stage|stagiaire)\b",
    "temporary": r"\b(temporary|temp|fixed term|short term|cdd)\b",
}
EMPLOYEE_WORDS = r"\b(permanent|employee|cdi|cadre)\b"


def employment_types(label: Column) -> Column:
    """The employment types a label names; words for employees mean full-time if it names none."""
    words = F.regexp_replace(F.lower(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+", " ")
    named = F.array_compact(F.array(*[F.when(words.rlike(p), F.lit(t)) for t, p in EMPLOYMENT_WORDS.items()]))
    return F.when(label.isNull(), F.array().cast("array<string>")).when((F.size(named) == 0) & words.rlike(EMPLOYEE_WORDS), F.array(F.lit("full-time"))).otherwise(named)


#: Titles and labels of templates and tests (fixed values), ASCII word limits.
PLACEHOLDER_TITLE = r"(?i)^[^A-Za-z0-9_]*((external|internal)\s+)?(template|test (job|posting))\s*[-:|\]]|(?<![A-Za-z0-9_])do not apply(?![A-Za-z0-9_])"
PLACEHOLDER_LABEL = r"(?i)(?<![A-Za-z0-9_])templates?(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])z-?test(?![A-Za-z0-9_])"


def is_placeholder(title: Column, labels: Column) -> Column:
    return F.coalesce(title.rlike(PLACEHOLDER_TITLE), F.lit(False)) | F.coalesce(F.exists(labels, lambda x: x.rlike(PLACEHOLDER_LABEL)), F.lit(False))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 70, "likely").when(percent >= 40, "maybe").when(percent.isNotNull(), "unlikely")
