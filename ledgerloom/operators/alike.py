"""Names against a stated set of known ones by matching blocks or shared words, without comparing all pairs letter by letter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratios, token_set_ratio
from ..session import cut

#: Names and known names that meet in one task.
NAMES, KNOWN = 4000, 20_000
#: Letters are counted in so many places; letters that share one make a bound looser, never wrong.
PLACES = 63
EPS = 1e-9


class Letters:
    """Known texts by length, with counts of letters, to bound how alike a text can be."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = sorted(texts, key=len)
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        wide = int(self.length.max(initial=0))
        self.at = np.full((wide, len(texts)), PLACES, np.uint8)  # place of each letter; PLACES: none
        self.count = np.zeros((PLACES, len(texts)), np.uint16)
        for k, t in enumerate(self.texts):
            p = [ord(c) % PLACES for c in t]
            self.at[: len(p), k] = p
            for x, n in Counter(p).items():
                self.count[x, k] = n

    def shared(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Letters that text and each of the known texts lo to hi have in common at most, wherever they stand."""
        out = np.zeros(hi - lo, np.uint16)
        for x, n in Counter(ord(c) % PLACES for c in text).items():
            out += np.minimum(self.count[x, lo:hi], n)
        return out

    def in_order(self, text: str, which: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with known texts, or more where letters share a place; bit-parallel over texts of up to 63 letters."""
        mask = np.zeros(PLACES + 1, np.uint64)
        for i, c in enumerate(text):
            mask[ord(c) % PLACES] |= np.uint64(1 << i)
        full = np.uint64((1 << len(text)) - 1)
        v = np.full(len(which), full)
        for row in self.at[: int(self.length[which].max(initial=0))]:
            u = v & mask[row[which]]
            v = (v + u | v - u) & full
        return len(text) - np.bitwise_count(v).astype(np.int64)


def most_alike(names: list[str], least: list[float], known: list[str], flipped: bool) -> list[tuple[str, str, float]]:
    """(name, known, ratio) of the known texts with the largest ratio of matching blocks of each name, all of them if several have it, from ``least`` on.

    The ratio is at most that of letters in common, and at most that of a common
    subsequence; pairs whose bounds fall short of the cutoff or of the best so far
    are not compared.  ``flipped``: the known text comes first.
    """
    k = Letters(known)
    todo = []  # (name, least, known by falling bound, their bounds)
    for name, c in zip(names, least):
        n = len(name)
        lo, hi = np.searchsorted(k.length, n * c / (2 - c) - 0.5), np.searchsorted(k.length, n * (2 - c) / c + 0.5, "right")
        both = k.length[lo:hi] + n
        which = np.flatnonzero(2 * k.shared(name, lo, hi).astype(np.int64) >= c * both - EPS) + lo
        if not len(which):
            continue
        bound = 2 * (k.in_order(name, which) if n < 64 else k.shared(name, lo, hi)[which - lo].astype(np.int64)) / (k.length[which] + n)
        ok = bound >= c - EPS
        order = np.argsort(-bound[ok], kind="stable")
        if len(order):
            todo.append((name, c, which[ok][order], bound[ok][order]))
    best = [c for _, c, _, _ in todo]
    got: list[list[tuple[int, float]]] = [[] for _ in todo]
    done, step = 0, 2
    while True:
        # the likeliest of each name first: they rule out most of the others
        pairs = [(i, int(j)) for i, (_, _, which, bound) in enumerate(todo) for j, b in zip(which[done : done + step], bound[done : done + step]) if b >= best[i] - EPS]
        if not pairs:
            break
        a, b = [todo[i][0] for i, _ in pairs], [k.texts[j] for _, j in pairs]
        for (i, j), r in zip(pairs, sequence_ratios(b, a) if flipped else sequence_ratios(a, b)):
            if r >= best[i]:
                best[i] = r
                got[i].append((j, r))
        done, step = done + step, step * 4
    return [(todo[i][0], k.texts[j], float(r)) for i, x in enumerate(got) for j, r in x if r == best[i]]


def most_words(names: list[str], least: list[float], known: list[str]) -> list[tuple[str, str, float]]:
    """As :func:`most_alike` by the ratio of word sets (see similarity.token_set_ratio).

    Whichever of its forms is largest, at least ``least / (2 - least)`` of the shorter
    side's distinct words are letters of the other side as well.
    """
    words = lambda t: " ".join(sorted(set(t.split())))
    of: dict[str, list[str]] = {}
    for t in known:
        of.setdefault(words(t), []).append(t)
    k = Letters(list(of))
    out = []
    for name, c in zip(names, least):
        w = words(name)
        shared = k.shared(w, 0, len(k.texts))
        best, got = c, []
        for j in np.flatnonzero(shared >= c / (2 - c) * np.minimum(k.length, len(w)) - EPS):
            r = token_set_ratio(w, k.texts[j])
            if r >= best:
                best, got = r, [*(got if r == best else []), k.texts[j]]
        out += [(name, t, float(best)) for x in got for t in of[x]]
    return out


def most_shared(names: list[str], least: list[float], known: list[str]) -> list[tuple[str, str, float]]:
    """(name, known, share) of the first known text with the largest share of words in common, of the fewer words of the two, from ``least`` on."""
    words = lambda t: list(dict.fromkeys(re.split(r"[ \t\n\x0b\f\r]+", t)))  # noqa: E731  the blanks of Spark's \s
    having: dict[str, list[int]] = {}
    for k, t in enumerate(known):
        for w in words(t):
            having.setdefault(w, []).append(k)
    at = {w: np.array(k, dtype=np.int64) for w, k in having.items()}
    size = np.array([len(words(t)) for t in known], dtype=np.int64)
    count = np.zeros(len(known), np.int64)
    out = []
    for name, c in zip(names, least):
        own = words(name)
        hits = [at[w] for w in own if w in at]
        if not hits:
            continue
        for k in hits:
            count[k] += 1
        which = np.unique(np.concatenate(hits))
        share = count[which] / np.minimum(size[which], len(own))
        j = int(share.argmax())  # the first of the largest
        if share[j] >= c:
            out.append((name, known[which[j]], float(share[j])))
        count[which] = 0
    return out


def close_names(names: list[str], least: list[float], known: list[str]) -> list[tuple[str, str, float]]:
    """(name, known, similarity) of all pairs that share a word, from ``least`` on: 1 if equal, 0.9 if one contains the other, else the Jaccard similarity of their words.

    Of a text that another contains all words but the first and the last are whole
    words there, which leaves few pairs to be looked at as texts.  Pairs that share no
    word are found by :func:`parts_of_words`.
    """
    of = [set(t.split(" ")) for t in known]
    having: dict[str, list[int]] = {}
    for k, ws in enumerate(of):
        for w in ws:
            having.setdefault(w, []).append(k)
    at = {w: np.array(k, dtype=np.int64) for w, k in having.items()}
    size = np.array([len(ws) for ws in of], dtype=np.int64)
    count = np.zeros(len(known), np.int64)
    out = []
    for name, c in zip(names, least):
        own = set(name.split(" "))
        hits = [at[w] for w in own if w in at]
        if not hits:
            continue
        for k in hits:
            count[k] += 1
        which = np.unique(np.concatenate(hits))
        shared = count[which]
        count[which] = 0
        words = shared / (size[which] + len(own) - shared)
        for j in np.flatnonzero((words >= c) | (shared >= np.minimum(size[which], len(own)) - 2)):
            k = known[which[j]]
            sim = 1.0 if k == name else 0.9 if k in name or name in k else float(words[j])
            if sim >= c:
                out.append((name, k, sim))
    return out


def search(names: DataFrame, known: DataFrame, f: Callable[[list[str], list[float], list[str]], list[tuple[str, str, float]]]) -> DataFrame:
    """(name, known, ratio) that ``f`` gives, over (name, least) and (known), both distinct texts: the best of each part of the known ones.

    Every part of the names meets every part of the known ones in a task; a part is
    sent as often as the other side has parts, and nothing goes by way of the driver.
    Known texts come in the order of their column ``ord``, if they have one.
    """
    a, b = cut(names.select("name", "least"), count=F.lit(True)), cut(known.select("known", *(["ord"] if "ord" in known.columns else [])), count=F.lit(True))
    p, q = max(24, -(-a.counted // NAMES)), max(1, -(-b.counted // KNOWN))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = a.withColumn("_p", part("name", p)).withColumn("_q", every(q)).repartition(p * q, "_p", "_q")
    y = b.withColumn("_q", part("known", q)).withColumn("_p", every(p)).repartition(p * q, "_p", "_q")

    def meet(n: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        k = k.sort_values("ord") if "ord" in k else k
        got = f(n["name"].tolist(), n["least"].tolist(), k["known"].tolist()) if len(n) and len(k) else []
        return pd.DataFrame(got, columns=["name", "known", "ratio"])

    return x.groupBy("_p", "_q").cogroup(y.groupBy("_p", "_q")).applyInPandas(meet, "name string, known string, ratio double")


def parts_of_words(names: DataFrame) -> DataFrame:
    """(name, known): the pairs, both ways round, of distinct texts (column ``name``) of which one contains the other and that share no word.

    The contained text has one word, which is part of a word of the other, or two, of
    which the first ends a word and the second begins the next.  Parts of distinct
    words are joined with such texts by equality; no text is compared with all others.
    """
    t = names.select("name", F.split("name", " ").alias("_ws"))
    size = F.size("_ws")
    one, two = t.filter(size == 1).select(F.col("name").alias("_p")), t.filter(size == 2).select(F.col("name").alias("_p"), F.col("_ws")[0].alias("_x"), F.col("_ws")[1].alias("_y"))

    words = t.select("name", "_ws", F.explode(F.array_distinct("_ws")).alias("_w")).filter("_w <> ''")
    n = F.length("_w")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substr(F.col("_w"), i, m))))
    within = words.select("_w").distinct().withColumn("_p", F.explode(F.array_distinct(parts))).filter("_p <> _w").join(one.hint("merge"), "_p")
    a = within.join(words.hint("merge"), "_w").filter(~F.array_contains("_ws", F.col("_p"))).select("_p", "name")

    beside = t.filter(size > 1).select("name", "_ws", F.explode(F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.struct(F.get("_ws", i).alias("u"), F.get("_ws", i + 1).alias("v")))).alias("_b")).filter("length(_b.u) > 1 and length(_b.v) > 1")
    u, v = F.col("_b.u"), F.col("_b.v")
    # what the first word ends with, and the letter that the second begins with
    ends = beside.select("_b").distinct().withColumn("_x", F.explode(F.transform(F.sequence(F.lit(2), F.length(u)), lambda i: F.substr(u, i)))).withColumn("_c", F.substring(v, 1, 1))
    over = ends.join(two.withColumn("_c", F.substring("_y", 1, 1)).hint("merge"), ["_x", "_c"]).filter(F.startswith(v, F.col("_y"))).select("_b", "_p", "_x", "_y")
    b = over.join(beside.hint("merge"), "_b").filter(~F.arrays_overlap("_ws", F.array("_x", "_y"))).select("_p", "name")

    got = a.unionByName(b).distinct()
    return got.select(F.col("_p").alias("name"), F.col("name").alias("known")).unionByName(got.select("name", F.col("_p").alias("known")))
