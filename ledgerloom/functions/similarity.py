"""Similarity of names: built-in expressions where they can say it, Arrow batches where not."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ACCENTED, BARE

# Words that do not tell suppliers apart, and legal forms.
COMMON = ["LTDA", "ME", "EPP", "EIRELI", "SA", "S/A", "CIA", "COMERCIO", "INDUSTRIA", "SERVICOS", "DE", "DO", "DA", "DOS", "DAS", "E"]
LEGAL = r"\b(comercio|industria|servicos|ltda|limitada|s\s?a|sociedade anonima|eireli|me|epp|mei|cia|companhia|sociedade)\b"


def supplier_words(c: Column) -> Column:
    """Words of a supplier's name that tell it apart, in order: upper case, no punctuation, no common or one-letter words."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"(?U)[^\w\s]", "")
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(COMMON))


def normalise_supplier(c: Column) -> Column:
    return F.coalesce(F.array_join(supplier_words(c), " "), F.lit(""))


def normalise_company(c: Column) -> Column:
    """Lower case without accents, punctuation and legal forms."""
    s = F.regexp_replace(F.lower(F.translate(c, ACCENTED, BARE)), r"[^a-z0-9_\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, LEGAL, ""), r"\s+", " "))


def word_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.9 if one contains the other, else the Jaccard similarity of their words; 0 for empty ones."""
    x, y = normalise_supplier(a), normalise_supplier(b)
    wx, wy = F.array_distinct(supplier_words(a)), F.array_distinct(supplier_words(b))
    j = F.size(F.array_intersect(wx, wy)) / F.size(F.array_union(wx, wy))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(j)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared words over the smaller number of words."""
    wx, wy = F.array_distinct(supplier_words(a)), F.array_distinct(supplier_words(b))
    least = F.least(F.size(wx), F.size(wy))
    return F.when(least > 0, F.size(F.array_intersect(wx, wy)) / least).otherwise(0.0)


def fuzzy_match(a: Column, b: Column) -> Column:
    """True if one name contains the other, six tenths of the words overlap or the first five letters agree."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (overlap_coefficient(a, b) >= 0.6) | ((F.length(x) >= 5) & (F.substring(x, 1, 5) == F.substring(y, 1, 5)))), F.lit(False))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """2 * LCS / (m + n): similarity by insertions and deletions only."""
    if a is None or b is None:
        return 0.0
    n = len(a) + len(b)
    return 1.0 if not n else 2 * lcs_length(a, b) / n


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """Ratio of the texts with their words sorted."""
    return indel_ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))) if a and b else 0.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Largest ratio among the shared words and each side's words added to them; 1 if one side has no more words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    p, q = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    if both and (p == both or q == both):
        return 1.0
    return max(indel_ratio(both, p) if both else 0.0, indel_ratio(both, q) if both else 0.0, indel_ratio(p, q))


def sequence_ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else 0.0


def sequence_ratios(a: list[str], b: list[str], at_once: int = 16_000) -> list[float]:
    """:func:`sequence_ratio` of many pairs of texts at once, by the same choice of blocks.

    The longest common run that comes first in a, then in b, splits a pair in two,
    until no run is left.  Pairs with a text of 200 letters and more, of which
    difflib skips frequent letters, are left to it.
    """
    out = np.zeros(len(a))
    short = [k for k in range(len(a)) if len(a[k]) < 200 and len(b[k]) < 200]
    for k in {*range(len(a))}.difference(short):
        out[k] = sequence_ratio(a[k], b[k])
    short.sort(key=lambda k: len(a[k]) + len(b[k]))
    for s in range(0, len(short), at_once):
        ks = short[s : s + at_once]
        la, lb = (np.array([len(x[k]) for k in ks], dtype=np.int64) for x in (a, b))
        x, y = (_letters([t[k] for k in ks], int(n.max())) for t, n in ((a, la), (b, lb)))
        both = la + lb
        out[ks] = np.where(both > 0, 2.0 * _matched(x, la, y, lb) / np.maximum(both, 1), 1.0)
    return out.tolist()


def _letters(texts: list[str], wide: int) -> np.ndarray:
    return np.array([t.ljust(wide) for t in texts], dtype=f"U{max(1, wide)}").view(np.uint32).reshape(len(texts), -1)


def _matched(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Letters in matching blocks of each pair of rows."""
    total = np.zeros(len(la), np.int64)
    zero = np.zeros(len(la), np.int64)
    idx, alo, ahi, blo, bhi = np.arange(len(la)), zero, la, zero, lb
    rows, cols = np.arange(a.shape[1]), np.arange(b.shape[1])
    none_a, none_b = np.uint32(0x110000), np.uint32(0x110001)  # beyond all letters: outside of the part looked at
    while len(idx):
        x = np.where((rows >= alo[:, None]) & (rows < ahi[:, None]), a[idx], none_a)
        y = np.where((cols >= blo[:, None]) & (cols < bhi[:, None]), b[idx], none_b)
        run = np.zeros((len(idx), len(cols) + 1), np.uint8)  # length of the run that ends here, one column to the right
        size, end_a, end_b = (np.zeros(len(idx), np.int64) for _ in range(3))
        for i in range(int(alo.min()), int(ahi.max())):
            new = np.zeros_like(run)
            np.multiply(run[:, :-1] + np.uint8(1), x[:, i, None] == y, out=new[:, 1:])
            most = new.max(axis=1)
            up = np.flatnonzero(most > size)
            if len(up):
                size[up], end_a[up], end_b[up] = most[up], i + 1, new[up].argmax(axis=1)
            run = new
        np.add.at(total, idx, size)  # both sides of a pair may be among them
        sa, sb = end_a - size, end_b - size
        left, right = (size > 0) & (alo < sa) & (blo < sb), (size > 0) & (end_a < ahi) & (end_b < bhi)
        idx, alo, ahi, blo, bhi = (np.concatenate(p) for p in zip((idx[left], alo[left], sa[left], blo[left], sb[left]), (idx[right], end_a[right], ahi[right], end_b[right], bhi[right])))
    return total


def pair_udf(f):
    """A similarity of two texts over Arrow batches; equal pairs of a batch are computed once."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for k in zip(a, b):
            if k not in seen:
                seen[k] = f(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return run
