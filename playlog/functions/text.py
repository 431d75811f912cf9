"""Text functions that Spark lacks, as Arrow-batched UDFs.  They run once for each track
or album, never for each play."""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# What titles are cleaned of.
_MARKS = re.compile(r"[^a-z0-9]+")
_STEPS = (
    (re.compile(r"\.[a-z0-9]{2,5}$"), ""),
    (re.compile(r"^\s*\d{1,3}(?:\s*[-._)\]]+\s*|\s+)"), ""),
    (re.compile(r"\b(?:disc|cd)\s*\d+\b"), " "),
    (re.compile(r"\b(?:official|audio|video|remaster(?:ed)?|version)\b"), " "),
)


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text.strip()).encode("ascii", "ignore").decode("ascii").casefold()


def entity_key_of(text: str) -> str:
    """Letters and digits of an album's or artist's name, editions kept."""
    return " ".join(_MARKS.sub(" ", _ascii(text)).split())


def title_key_of(text: str) -> str:
    """A title without extension, leading number, disc and release words."""
    out = _ascii(text)
    for pattern, by in _STEPS:
        out = pattern.sub(by, out)
    return " ".join(_MARKS.sub(" ", out).split())


def longest_rising(values: list[int]) -> int:
    """Length of the longest strictly increasing subsequence of the positive values."""
    return rising_lengths(values)[-1]


def rising_lengths(values: list[int]) -> list[int]:
    """That length for each beginning of the values, the empty one first."""
    tails: list[int] = []
    out = [0]
    for v in values:
        if v > 0:
            at = bisect.bisect_left(tails, v)
            tails[at : at + 1] = [v]
        out.append(len(tails))
    return out


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def entity_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None else entity_key_of(x))


@F.pandas_udf(StringType())
def title_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None else title_key_of(x))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, the order of both texts mattering."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


RISING = ["_u", "_u24", "_u48", "_l", "_l24", "_l48"]


@F.pandas_udf(StructType([StructField(name, IntegerType()) for name in RISING]))
def rising(values: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Distinct values and the longest rising subsequence, of all and of two beginnings."""
    rows = []
    for v, a, b in zip(values, first, second, strict=True):
        v = [int(x) for x in v]
        lengths = rising_lengths(v)
        rows.append((len(set(v)), len(set(v[:a])), len(set(v[:b])), lengths[-1], lengths[a], lengths[b]))
    return pd.DataFrame(rows, columns=RISING)
