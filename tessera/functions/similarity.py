"""String similarities in [0, 1]: by built-in functions where Spark has them, else in one Arrow UDF for all of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1 << 12)
def _masks(a: str) -> dict[str, int]:
    """Where each character stands in a string, as bits. A source's strings come again with each of its candidates."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


@lru_cache(1 << 14)
def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


@lru_cache(1 << 14)
def _words(a: str) -> frozenset[str]:
    return frozenset(a.split())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big integer holds a row of the table."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    at = _masks(a).get
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * common_subsequence(a, b) / n if n else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among common words, and common words with either side's other words; 0 if a side has no words."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both, one, other = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not other):
        return 1.0
    shared = len(" ".join(both))
    gap = 1 if both else 0
    left, right = shared + gap + len(one), shared + gap + len(other)
    apart = len(one) + len(other) - 2 * common_subsequence(one, other)
    best = 1 - apart / (left + right)
    if both:
        best = max(best, 1 - (gap + len(one)) / (shared + left), 1 - (gap + len(other)) / (shared + right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one; windows may stick out at both ends."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 1.0
    n, best = len(short), 0.0
    pairs = [(short, long)] if len(a) != len(b) else [(a, b), (b, a)]
    for s, t in pairs:
        for end in range(1, len(t) + n):
            window = t[max(0, end - n) : end]
            if 2 * min(n, len(window)) / (n + len(window)) > best:
                best = max(best, ratio(s, window))
    return best


BITS = 64
"""Letters of the shorter string up to which partial ratios are computed for many pairs at once."""


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio() of many pairs. Those whose shorter strings are as long go together, all windows at once.

    An integer for each pair and window holds a row of the subsequence's table, as in common_subsequence().
    """
    out = [0.0] * len(pairs)
    groups: dict[int, list[tuple[int, str, str]]] = {}
    for i, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short or len(short) > BITS or short in long:
            out[i] = partial_ratio(a, b)
            continue
        groups.setdefault(len(short), []).append((i, short, long))
        if len(a) == len(b):
            groups[len(short)].append((i, long, short))
    for n, rows in groups.items():
        rows.sort(key=lambda r: len(r[2]))
        # Long strings of about the same length go together, so that one of many letters doesn't widen all.
        for low in range(0, len(rows), 256):
            part = rows[low : low + 256]
            size = np.array([len(long) for _, _, long in part])
            m = int(size.max())
            s = np.array([[ord(c) for c in short] for _, short, _ in part], np.uint32)
            t = np.full((len(part), m), 0xFFFFFFFF, np.uint32)
            for r, (_, _, long) in enumerate(part):
                t[r, : len(long)] = [ord(c) for c in long]
            hit = np.zeros((len(part), m + 2 * n), np.uint64)
            for j in range(n):
                hit[:, n : n + m] |= (s[:, j, None] == t).astype(np.uint64) << np.uint64(j)
            full = np.uint64((1 << n) - 1)
            row = np.full((len(part), m + n - 1), full, np.uint64)
            for j in range(n):
                at = hit[:, 1 + j : m + n + j] & row
                row = ((row + at) | (row - at)) & full
            common = n - np.bitwise_count(row).astype(np.int64)
            end = np.arange(1, m + n)[None, :]
            window = np.minimum(end, size[:, None]) - np.maximum(0, end - n)
            best = np.where(window > 0, 2 * common / (n + np.maximum(window, 1)), 0.0).max(axis=1)
            for (i, _, _), v in zip(part, best.tolist(), strict=True):
                out[i] = max(out[i], v)
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity, raised by a tenth of the rest for each of up to 4 equal first letters where it exceeds 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    moved = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro > 0.7:
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro


MEASURES = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler}


def measures(**wanted: tuple[str, Column, Column]) -> Column:
    """A struct of doubles: each name with its measure of two columns, all from one Arrow UDF; null counts as empty."""
    names = list(wanted)
    functions = [MEASURES[wanted[k][0]] for k in names]

    def all_of(f, one: pd.Series, other: pd.Series) -> list[float]:
        """f of each pair; pairs that come again in a batch are computed once."""
        if f is partial_ratio:
            pairs = list(zip(one.fillna(""), other.fillna(""), strict=True))
            different = list(dict.fromkeys(pairs))
            values = dict(zip(different, partial_ratios(different), strict=True))
            return [values[p] for p in pairs]
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(one.fillna(""), other.fillna(""), strict=True):
            v = known.get(pair)
            if v is None:
                v = known[pair] = f(*pair)
            out.append(v)
        return out

    @F.pandas_udf(", ".join(f"{k} double" for k in names))
    def compute(*sides: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({k: all_of(f, sides[2 * i], sides[2 * i + 1]) for i, (k, f) in enumerate(zip(names, functions, strict=True))}, dtype="float64")

    return compute(*[c for k in names for c in wanted[k][1:]])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column, empty_as_zero: bool = False) -> Column:
    """Jaccard of the parts between single blanks. Two empty strings score 1, or 0 (and empty parts don't count) if asked for."""
    x, y = F.split(a, " "), F.split(b, " ")
    if empty_as_zero:
        x, y = (F.filter(s, lambda t: t != "") for s in (x, y))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def set_jaccard(x: Column, y: Column, both_empty: float) -> Column:
    """Jaccard of two arrays; `both_empty` if both are, 0 if one is."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(x, y)) / union)
