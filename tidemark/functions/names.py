"""Name and birth-date similarity for record linkage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_accents

# Name particles and scoring constants.
PARTICLES = ["da", "de", "do", "das", "dos", "e", "du", "d’", "d"]
INITIALS_BONUS = 0.05


def normalize_name(name: Column) -> Column:
    """Lower case, no accents, letters and apostrophes only, particles dropped."""
    plain = strip_accents(F.lower(F.coalesce(name, F.lit(""))))
    tokens = F.split(F.trim(F.regexp_replace(plain, r"[^a-z']+", " ")), " ")
    kept = F.filter(tokens, lambda t: (t != "") & ~t.isin(*PARTICLES))
    return F.array_join(kept, " ")


def name_initials(name: Column) -> Column:
    """struct(first, last): first letters of the first and last token of a normal name."""
    return F.struct(
        F.substring(F.substring_index(name, " ", 1), 1, 1).alias("first"),
        F.substring(F.substring_index(name, " ", -1), 1, 1).alias("last"),
    )


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 1.0 if size == 0 else 2.0 * _lcs(a, b) / size


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any same-length or edge window of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        best = max(best, _ratio(short, long[max(start, 0) : start + n]))
        if best == 1.0:
            break
    return best


def _token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    common = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and (not only_a or not only_b):
        return 1.0
    whole_a = f"{common} {only_a}".strip()
    whole_b = f"{common} {only_b}".strip()
    best = _ratio(whole_a, whole_b)
    if common:
        best = max(best, _ratio(common, whole_a), _ratio(common, whole_b))
    return best


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    picked = []
    for i, ch in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(b))):
            if not used[j] and b[j] == ch:
                used[j] = True
                picked.append(ch)
                break
    m = len(picked)
    if m == 0:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(picked, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def best_name_ratio(a: str, b: str) -> float:
    """Largest of the five string ratios, all on 0..1."""
    if a == b:
        return 1.0
    best = max(_token_set(a, b), _jaro_winkler(a, b), _ratio(a, b))
    best = max(best, _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    return best if best == 1.0 else max(best, _partial(a, b))


@F.pandas_udf(T.DoubleType())
def fuzzy_name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [best_name_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64"
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normal names; null if both are empty, 0 if one is."""
    bonus = F.when(name_initials(a) == name_initials(b), INITIALS_BONUS).otherwise(0.0)
    return (
        F.when((a == "") & (b == ""), F.lit(None).cast("double"))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.least(fuzzy_name_ratio(a, b) + bonus, F.lit(1.0)))
    )


def birthdate_similarity(a: Column, b: Column) -> Column:
    """Stepwise similarity of two dates; null if both are missing, 0 if one is."""
    a, b = a.cast("date"), b.cast("date")
    years = F.abs(F.year(a) - F.year(b))
    same_month = F.month(a) == F.month(b)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(None).cast("double"))
        .when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .when(F.abs(F.datediff(a, b)) <= 1, 0.95)
        .when((years == 0) & same_month, 0.8)
        .when(years == 0, 0.6)
        .when((years == 1) & same_month & (F.day(a) == F.day(b)), 0.85)
        .when((years == 1) & same_month, 0.5)
        .otherwise(0.0)
    )


def pair_score(name_sim: Column, date_sim: Column, w_name: float = 0.70, w_date: float = 0.30) -> Column:
    """Weighted score; the weights adapt to how far the dates agree."""
    n, d = F.coalesce(name_sim, F.lit(0.0)), F.coalesce(date_sim, F.lit(0.0))
    score = (
        F.when(d >= 0.95, 0.45 * n + 0.55 * d)
        .when(d == 0.0, 0.85 * n + 0.15 * d)
        .otherwise(w_name * n + w_date * d)
    )
    return F.when((n >= 0.8) & (d >= 0.8), F.least(F.lit(1.0), score + 0.05)).otherwise(score)
