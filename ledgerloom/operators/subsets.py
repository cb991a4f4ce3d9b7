"""Sums of a few rows that meet a target: bisection for pairs, pruned search beyond."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Target-item pairs of a task's share of one key, and of the least share a key is spread by.
SHARE, SPREAD = 16_000_000, 1_000_000
#: Rows handed on at once.
HANDED = 200_000


def met_pairs(values: np.ndarray, target: int, tol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the ascending ``values`` whose sum is within ``tol`` of ``target``: some at a time.

    The lesser of two values is at most half of the target, so only those come first;
    the others that complete one lie side by side.
    """
    first = values[: np.searchsorted(values, (target + tol) // 2, "right")]
    lo = np.maximum(np.searchsorted(values, target - tol - first), np.arange(1, len(first) + 1))
    n = np.searchsorted(values, target + tol - first, "right") - lo
    at = np.flatnonzero(n > 0)
    lo, n = lo[at], n[at]
    ends = np.cumsum(n)
    k = 0
    while k < len(at):
        done = int(ends[k - 1]) if k else 0
        m = max(k + 1, int(np.searchsorted(ends, done + HANDED, "right")))
        c = n[k:m]
        yield np.repeat(at[k:m], c), np.arange(done, int(ends[m - 1])) + np.repeat(lo[k:m] - ends[k:m] + c, c)
        k = m


def sums(ids: pa.Array, i: pa.Array, v: np.ndarray, at: list) -> pa.RecordBatch:
    """Rows of the pairs of positions ``at``: (target, first, second)."""
    k, p, q = (np.concatenate(x) for x in zip(*at))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(k)), i.take(pa.array(p)), i.take(pa.array(q)), pa.array(v[p] + v[q])], names=["_id", "_i", "_j", "_total"])


def pair_sums(targets: DataFrame, items: DataFrame, key: str, target: str, value: str, tid: str, iid: str, tol: int) -> DataFrame:
    """(tid, i1, i2, total): two items of the target's key, i1 < i2, whose sum is within ``tol`` of the target.

    The items of a key are one sorted list, which meets the key's targets some at a
    time, so a hot key is spread over tasks.  Pairs are found by bisection, each once,
    and go straight to the output: only lists are shuffled, never a pair.
    """
    kind, ikind, vkind = dict(targets.dtypes)[tid], dict(items.dtypes)[iid], dict(items.dtypes)[value]
    listed = lambda df, k, v, i, out: df.filter(F.col(v).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(v).cast("bigint").alias("v"), F.col(i).alias("i")))).alias(out))
    both = listed(targets, key, target, tid, "_a").join(listed(items, key, value, iid, "_b"), "_k")
    work = F.size("_a").cast("bigint") * F.size("_b")
    shares = F.greatest(F.ceil(work / SHARE), F.least(F.lit(16), F.ceil(work / SPREAD), F.size("_a")))
    each = both.withColumn("_m", F.ceil(F.size("_a") / shares).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(1), F.size("_a"), F.col("_m"))))
    some = each.select("_k", "_p", F.slice("_a", F.col("_p"), F.col("_m")).alias("_a"), "_b").select("_k", "_p", F.col("_a.i").alias("_id"), F.col("_a.v").alias("_t"), F.col("_b.v").alias("_v"), F.col("_b.i").alias("_i"))
    # the number of tasks is given: few bytes would be taken for little work
    met = some.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k", "_p").select("_id", "_t", "_v", "_i")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, ts, v, i in zip(*b.columns):
                ids, v, i = ids.values, v.values.to_numpy(zero_copy_only=False), i.values
                at, size = [], 0
                for k, x in enumerate(ts.values.to_pylist()):
                    for p, q in met_pairs(v, x, tol):
                        at.append((np.full(len(p), k), p, q))
                        size += len(p)
                        if size >= HANDED:
                            yield sums(ids, i, v, at)
                            at, size = [], 0
                if at:
                    yield sums(ids, i, v, at)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in found(batches):
            held.append(b)
            if len(held) >= 1000 or b.num_rows >= HANDED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    got = met.mapInArrow(pick, f"_id {kind}, _i {ikind}, _j {ikind}, _total bigint").filter("_i <> _j")
    return got.select(F.col("_id").alias(tid), F.least("_i", "_j").alias("i1"), F.greatest("_i", "_j").alias("i2"), F.col("_total").cast(vkind).alias("total"))


def subset_of(values: list[int], target: int, tol: int, most: int, first: bool = True) -> list[tuple[int, ...]]:
    """Positions of up to ``most`` values whose sum is within ``tol`` of ``target``: fewest first, then by position.

    The last two places are found by bisection over pair sums instead of being
    tried, so five places cost what three cost by trying.
    """
    n = len(values)
    out: list[tuple[int, ...]] = []
    order = sorted(range(n), key=values.__getitem__)
    ranked = [values[i] for i in order]
    for r in range(1, min(most, n) + 1):
        found = []
        if r == 1:
            found = [(i,) for i in range(n) if abs(values[i] - target) <= tol]
        else:
            for head in combinations(range(n), r - 1):
                rest = target - sum(values[i] for i in head)
                lo, hi = bisect_left(ranked, rest - tol), bisect_right(ranked, rest + tol)
                found += [(*head, i) for i in sorted(order[lo:hi]) if i > head[-1]]
                if first and found:
                    break
        found.sort()
        if first and found:
            return found[:1]
        out += found
    return out


def subset_matches(targets: DataFrame, items: DataFrame, key: str, target: str, value: str, tid: str, iid: str, tol: int = 5, most: int = 5, nearest: int = 50) -> DataFrame:
    """(tid, parts, total): the first set of up to ``most`` items that meets each target.

    As a feature, the ``nearest`` items by distance from the target are candidates,
    in that order with ids breaking ties; a target's candidates are therefore a
    bounded list, kept by a window group limit before anything is collected.
    """
    j = targets.select(tid, F.col(key).alias("_k"), F.col(target).alias("_t")).join(items.select(F.col(key).alias("_k"), F.col(iid).alias("_i"), F.col(value).alias("_v")), "_k")
    w = Window.partitionBy(tid).orderBy(F.abs(F.col("_v") - F.col("_t")), "_i")
    near = j.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= nearest)
    g = near.groupBy(tid, "_t").agg(F.array_sort(F.collect_list(F.struct("_n", "_i", "_v"))).alias("c"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(c: pd.Series, t: pd.Series) -> pd.Series:
        hit = [subset_of([x["_v"] for x in r], int(k), tol, most) for r, k in zip(c, t)]
        return pd.Series([list(h[0]) if h else None for h in hit], dtype=object)

    p = g.withColumn("at", pick("c", "_t")).filter("at is not null")
    parts = F.array_sort(F.transform("at", lambda i: F.get("c", i)["_i"]))
    return p.select(tid, parts.alias("parts"), F.aggregate(F.transform("at", lambda i: F.get("c", i)["_v"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def first_of(values: np.ndarray, target: int, tol: int, r: int) -> list[int] | None:
    """Positions of the first ``r`` values, by position, whose sum is within ``tol`` of ``target``; any number of values.

    Exact: values that no ``r`` with the smallest or largest others can bring to the
    target are left out, the last two places are found by bisection, and four places
    are only tried if two pair sums meet the target.
    """
    n = len(values)
    if r > n:
        return None
    if r == 1:
        hit = np.flatnonzero(np.abs(values - target) <= tol)
        return [int(hit[0])] if len(hit) else None
    if r == 2:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        lo, hi = np.searchsorted(ranked, target - tol - values), np.searchsorted(ranked, target + tol - values, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            later = order[lo[i] : hi[i]]
            later = later[later > i]
            if len(later):
                return [i, int(later.min())]
        return None
    ranked = np.sort(values)
    keep = np.flatnonzero((values + ranked[1 - r :].sum() >= target - tol) & (values + ranked[: r - 1].sum() <= target + tol))
    if len(keep) < n:
        hit = first_of(values[keep], target, tol, r)
        return hit and [int(keep[i]) for i in hit]
    if r == 4 and n <= 2000:
        x, y = np.triu_indices(n, 1)
        sums = np.sort(values[x] + values[y])
        if not (np.searchsorted(sums, target + tol - sums, "right") > np.searchsorted(sums, target - tol - sums)).any():
            return None
    for i in range(n - r + 1):
        hit = first_of(values[i + 1 :], target - int(values[i]), tol, r - 1)
        if hit:
            return [i, *(i + 1 + k for k in hit)]
    return None


def first_sets(targets: DataFrame, items: DataFrame, key: str, target: str, value: str, tid: str, iid: str, tol: int = 5, most: int = 5, per_row: int = 16) -> DataFrame:
    """(tid, parts, total): the first set of up to ``most`` of all items of a key that meets each target.

    Fewest items first, then by distance from the target, ids breaking ties, as
    :func:`subset_matches`, but no item is left out.  The items of a key meet
    ``per_row`` of its targets at a time, so a hot key is spread over tasks.
    """
    lists = items.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(iid).alias("i"), F.col(value).alias("v")))).alias("_c"))
    t = targets.select(tid, F.col(key).alias("_k"), F.col(target).alias("_t")).filter("_t is not null").join(items.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi")
    n = t.groupBy("_k").agg(F.ceil(F.count("*") / per_row).alias("_n"))
    some = t.join(n, "_k").groupBy("_k", F.pmod(F.xxhash64(tid), "_n").alias("_salt")).agg(F.collect_list(F.struct(F.col(tid).alias("id"), F.col("_t").alias("t"))).alias("_some"))
    # spread over tasks by key and salt: the lists are short for most keys and long for a few
    met = some.join(lists, "_k").repartition("_k", "_salt")
    kind = dict(targets.dtypes)[tid], dict(items.dtypes)[iid]

    def pick(batches):
        for b in batches:
            out = []
            for some, ids, v in zip(b["_some"], b["_i"], b["_v"]):
                v = np.array(v, dtype=np.int64)
                for x in some:
                    order = np.argsort(np.abs(v - x["t"]), kind="stable")
                    for r in range(1, most + 1):
                        at = first_of(v[order], int(x["t"]), tol, r)
                        if at:
                            out.append((x["id"], sorted(ids[order[k]] for k in at), int(v[order[at]].sum())))
                            break
            yield pd.DataFrame(out, columns=[tid, "parts", "total"])

    return met.select("_some", F.col("_c.i").alias("_i"), F.col("_c.v").alias("_v")).mapInPandas(pick, f"{tid} {kind[0]}, parts array<{kind[1]}>, total bigint")
