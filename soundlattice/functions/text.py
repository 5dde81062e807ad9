"""Cleaning of names, fields, dates and JSON lists."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"^\s+|\s+$"
RELEASE_TYPES = ("album", "ep", "mixtape", "comp")


def fold_accents(text: str) -> str:
    """Compatibility forms without combining marks."""
    marked = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFC", "".join(c for c in marked if not unicodedata.combining(c)))


# The steps from a folded, lower-case name to its key, in order, as patterns and what replaces them.
NAME_STEPS = [
    (r"\$", "_"),
    (r"\(.*?\)", ""),
    (r"\[.*?\]", ""),
    (r"(?<=[A-Za-z])\.(?=[A-Za-z])", "_"),
    (r"\.", " "),
    (r"&", "and"),
    (r"[^\w\s–-]", ""),
    (r"\s+(?=[-–])|(?<=[-–])\s+", ""),
    (r"^\s+|\s+$", ""),
    (r"\s+", "-"),
]
#: Names of these characters have the same key in Spark SQL as in Python: nothing is to be folded.
PLAIN = r"\A[\x09-\x0C\x20-\x7E]*\z"


def name_key(name: str) -> str:
    """A join key from a title, artist or album: lower case, no accents, words joined by hyphens."""
    key = fold_accents(name.lower().replace("℮", "e"))
    for pattern, put in NAME_STEPS:
        key = re.sub(pattern, put, key)
    return key


@F.pandas_udf(StringType())
def _name_key(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in names:
        yield batch.map(name_key, na_action="ignore")


def process_name(name: Column | str) -> Column:
    """``name_key`` of a column.  Plain names stay in Spark SQL; the others go to Python, which can fold accents.  Nulls stay null."""
    name = F.col(name) if isinstance(name, str) else name
    plain = F.regexp_like(name, F.lit(PLAIN))
    key = F.lower(name)
    for pattern, put in NAME_STEPS:
        key = F.regexp_replace(key, pattern, put)
    return F.when(plain, key).otherwise(_name_key(F.when(~plain, name)))


@F.pandas_udf(StringType())
def strip_accents(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in names:
        yield batch.map(lambda x: fold_accents(x.lower()), na_action="ignore")


def process_field(value: Column) -> Column:
    """A tag without bracketed parts and featured artists; null if empty."""
    plain = F.regexp_replace(value, r"\([^)\n]*\)", "")
    plain = F.regexp_replace(plain, r"(?i)\b(?:feat|ft)\b[^\n]*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), SPACES, "")
    return F.when(value != "", plain)


def album_artist(artist: Column, main: Column) -> Column:
    """The album artist where there is one, else the artist."""
    return F.coalesce(F.nullif(main, F.lit("")), artist)


def extract_year(date: Column) -> Column:
    """The year of YYYY, YYYY-MM-DD or DD-MM-YYYY; null for anything else."""
    first = F.regexp_extract(date, r"^([0-9]{4})(?:-[0-9]{2}-[0-9]{2})?$", 1)
    last = F.regexp_extract(date, r"^[0-9]{2}-[0-9]{2}-([0-9]{4})$", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def load_list(text: Column) -> Column:
    """A list of strings from JSON; an empty one if it is no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def is_missing(items: Column) -> Column:
    """True for no list, an empty one, or one of blank strings only; a null element is not blank."""
    blank = F.forall(items, lambda x: F.coalesce(F.regexp_replace(x, SPACES, "") == "", F.lit(False)))
    return F.coalesce((F.size(items) == 0) | blank, F.lit(True))


def split_tags(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.lower(F.regexp_replace(x, SPACES, "")))


def release_urls(base: str, artist: Column, album: Column) -> Column:
    """Candidate addresses, one for each release type, in order of preference."""
    return F.array(*(F.format_string(f"{base}/release/{kind}/%s/%s/", artist, album) for kind in RELEASE_TYPES))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The part after the last full stop, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def allowed_file(name: Column, kinds: tuple[str, ...] = ("mp3", "flac")) -> Column:
    return extension(name).isin(*kinds)


def html_text(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Texts of all elements of a name, and a class if given, in order; elements don't nest."""
    mark = rf"[^>]*class=[\"'][^\"'>]*\b{re.escape(css_class)}\b[^>]*" if css_class else r"(?:\s[^>]*)?"
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}{mark}>(.*?)</{tag}>"), F.lit(1))


def bpm_norm(bpm: Column) -> Column:
    return bpm / 208


def floor_len(seconds: Column) -> Column:
    return F.floor(seconds)
