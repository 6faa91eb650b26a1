"""Name comparison: similarity of sorted words, and the guard against merging two people."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CREDENTIALS

TITLES = {"mr", "ms", "mrs", "dr", "prof", "mx"}


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200 times the longest common subsequence over the sum of lengths, pair by pair; 100 for two empty strings.

    The table of common subsequences is filled row by row for all pairs at once.
    """
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    if not len(la):
        return np.zeros(0)
    codes = lambda side, width, pad: np.array([[*map(ord, x), *[pad] * (width - len(x))] for x in side], np.int64).reshape(len(side), width)
    x, y = codes(a, int(la.max()), -1), codes(b, int(lb.max()), -2)
    row = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        step = np.maximum(row[:, 1:], row[:, :-1] + (x[:, i, None] == y))
        row[:, 1:] = np.maximum.accumulate(step, axis=1)
    total = la + lb
    return np.where(total > 0, 200.0 * row[:, -1] / np.maximum(total, 1), 100.0)


def indel_ratio(a: str, b: str) -> float:
    return float(indel_ratios([a], [b])[0])


def sorted_words(name: str) -> str:
    return " ".join(sorted(name.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(sorted_words(a), sorted_words(b))


def _similarity(a: Column, b: Column, form) -> Column:
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = list(zip(x.to_pylist(), y.to_pylist(), strict=True))
        out = np.full(len(pairs), np.nan)
        known = np.array([p is not None and q is not None for p, q in pairs], bool)
        for at in np.array_split(np.flatnonzero(known), max(1, -(-int(known.sum()) // 4096))):
            out[at] = indel_ratios([form(pairs[i][0]) for i in at], [form(pairs[i][1]) for i in at])
        return pa.array(out, pa.float64(), mask=~known)

    return run(a, b)


def token_sort_similarity(a: Column, b: Column) -> Column:
    return _similarity(a, b, sorted_words)


def plain_similarity(a: Column, b: Column) -> Column:
    return _similarity(a, b, str)


def _split(name: str) -> tuple[str, str]:
    """(first, last) in lower case; first is empty for a single word. Titles and trailing credentials don't count."""
    words = [w for w in re.sub(CREDENTIALS, "", name).lower().split() if w.strip(".") not in TITLES]
    return (words[0] if len(words) > 1 else "", words[-1] if words else "")


def blocked(a: str, b: str) -> bool:
    """Whether two person names must not become one: both have a first name and their last names differ."""
    (fa, la), (fb, lb) = _split(a), _split(b)
    if not fa or not fb:
        return False
    return la != lb


def name_guard(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([blocked(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="object")

    return F.pandas_udf(run, "boolean")(a, b)


def title_case(name: Column) -> Column:
    """Trimmed, single spaces, the first letter of every run of letters upper case and the others lower case."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"(\p{L}+)", "\x00$1")
    return F.array_join(F.transform(F.split(plain, "\x00"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")
