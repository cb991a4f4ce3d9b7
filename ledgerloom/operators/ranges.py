"""Joins on tolerances, intervals and containment, written so that Catalyst gets an equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance_join(a: DataFrame, b: DataFrame, va: str, vb: str, tol: float, keys: list[tuple[str, str]] = []) -> DataFrame:
    """Pairs with |va - vb| <= tol, and equal ``keys`` (column of a, column of b).

    Values fall into bins as wide as the tolerance; each row of ``b`` goes to its
    bin and both neighbours, so the join is an equi-join on (keys, bin) with the
    exact condition as residual, and each pair meets exactly once.  Column names of
    the two sides must differ.
    """
    width = max(float(tol), 1.0)
    bin_ = lambda c: F.floor(F.col(c) / width).cast("long")
    x = a.withColumn("_bin", bin_(va))
    y = b.withColumn("_binb", F.explode(F.array(*[bin_(vb) + k for k in (-1, 0, 1)])))
    cond = (F.col("_bin") == F.col("_binb")) & (F.abs(F.col(va) - F.col(vb)) <= tol)
    for p, q in keys:
        cond = cond & (F.col(p) == F.col(q))
    return x.join(y, cond).drop("_bin", "_binb")


def ratio_join(a: DataFrame, b: DataFrame, va: str, vb: str, pct: float, keys: list[tuple[str, str]] = []) -> DataFrame:
    """Pairs of positive values with (max - min) / min * 100 <= pct: bins of the logarithm, neighbours on one side."""
    import math

    width = math.log1p(pct / 100)
    bin_ = lambda c: F.floor(F.log(F.col(c)) / width).cast("long")
    x = a.filter(F.col(va) > 0).withColumn("_bin", bin_(va))
    y = b.filter(F.col(vb) > 0).withColumn("_binb", F.explode(F.array(*[bin_(vb) + k for k in (-1, 0, 1)])))
    lo, hi = F.least(va, vb), F.greatest(va, vb)
    cond = (F.col("_bin") == F.col("_binb")) & ((hi - lo) * 100 <= pct * lo)
    for p, q in keys:
        cond = cond & (F.col(p) == F.col(q))
    return x.join(y, cond).drop("_bin", "_binb")


#: Pairs of rows of a task's share of one bin, and of the least share a bin is spread by; ids handed on at once.
SHARE, SPREAD, HANDED = 64_000_000, 1_000_000, 200_000


def value_pairs(df: DataFrame, iid: str, kind: str, value: str, tol: int, pct: int) -> DataFrame:
    """(src, dst, near): rows of two kinds, src < dst, with positive whole values within ``tol`` or, if further, within ``pct`` per cent of the lesser.

    A row goes to the bin of its value and to those of the lesser values that reach
    it.  A bin is one sorted list; what a row meets among other kinds, from itself
    upwards, lies side by side there, so each pair is made once and none is tried in
    vain.  Pairs leave as lists of ids and are spread out last.
    """
    import math

    width = math.log1p(pct / 100)
    bin_ = lambda c: F.floor(F.log(c.cast("double")) / width)
    v = F.col(value).cast("bigint")
    x = df.select(v.alias("v"), F.col(iid).alias("i"), F.col(kind).alias("k")).filter("v > 0 and k is not null")
    least = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("v") - tol, F.floor(F.col("v") / (1 + pct / 100)) - 1))
    x = x.withColumn("_h", bin_(F.col("v"))).withColumn("_b", F.explode(F.sequence(bin_(least), F.col("_h"))))
    lists = x.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("v", "i", "k", (F.col("_h") == F.col("_b")).alias("own")))).alias("c"))
    own = F.size(F.filter("c", lambda e: e["own"])).cast("bigint")
    work = own * F.size("c")
    some = lists.withColumn("_n", F.greatest(F.ceil(work / SHARE), F.least(F.lit(16), F.ceil(work / SPREAD), own))).filter("_n > 0").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    # the number of tasks is given: few bytes would be taken for little work
    met = some.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_b", "_p").select("_p", "_n", *[F.col(f"c.{c}").alias(c) for c in ("v", "i", "k", "own")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, bool]]:
        """A row's id and the ids it meets, within ``tol`` or further."""
        for b in batches:
            for p, n, v, i, k, mine in zip(*b.columns):
                v, i, mine = (a.values.to_numpy(zero_copy_only=False) for a in (v, i, mine))
                k = k.values.dictionary_encode().indices.to_numpy()
                rank = np.cumsum(np.r_[False, (v[1:] != v[:-1]) | (i[1:] != i[:-1])])
                mine = np.flatnonzero(mine)[p.as_py() :: n.as_py()]
                for kind in np.unique(k[mine]).tolist():
                    others, at = np.flatnonzero(k != kind), mine[k[mine] == kind]
                    w, ids = v[others], i[others]
                    a = np.searchsorted(rank[others], rank[at], "right")
                    b = np.maximum(a, np.searchsorted(w, v[at] + tol, "right"))
                    c = np.maximum(b, np.searchsorted(w, v[at] + v[at] * pct // 100, "right"))
                    for one, x, y, z in zip(i[at], a.tolist(), b.tolist(), c.tolist()):
                        if y > x:
                            yield one, ids[x:y], False
                        if z > y:
                            yield one, ids[y:z], True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            one, ids, near = zip(*held)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(one), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(near)], names=["_i", "_ids", "near"])

        for x in found(batches):
            held.append(x)
            size += len(x[1])
            if size >= HANDED:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    t = dict(df.dtypes)[iid]
    got = met.mapInArrow(pick, f"_i {t}, _ids array<{t}>, near boolean").select("_i", F.explode("_ids").alias("_j"), "near")
    return got.select(F.least("_i", "_j").alias("src"), F.greatest("_i", "_j").alias("dst"), "near")


def interval_join(a: DataFrame, b: DataFrame, day: str, low: Column, high: Column, width: int = 30, keys: list[tuple[str, str]] = []) -> DataFrame:
    """Pairs where ``day`` of a lies within [low, high] of b: each interval is sent to the periods of ``width`` days it meets."""
    origin = F.lit("1970-01-01").cast("date")
    period = lambda c: F.floor(F.datediff(c, origin) / width)
    x = a.withColumn("_p", period(F.col(day)))
    y = b.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi").withColumn("_q", F.explode(F.sequence(period(F.col("_lo")), period(F.col("_hi")))))
    cond = (F.col("_p") == F.col("_q")) & F.col(day).between(F.col("_lo"), F.col("_hi"))
    for p, q in keys:
        cond = cond & (F.col(p) == F.col(q))
    return x.join(y, cond).drop("_p", "_q", "_lo", "_hi")


def null_tolerant_join(a: DataFrame, b: DataFrame, ka: str, kb: str, key: tuple[str, str]) -> DataFrame:
    """Pairs on ``key`` whose ka and kb are equal or one of them null: two equi-joins instead of a condition with OR."""
    on = F.col(key[0]) == F.col(key[1])
    equal = a.filter(F.col(ka).isNotNull()).join(b.filter(F.col(kb).isNotNull()), on & (F.col(ka) == F.col(kb)))
    left = a.filter(F.col(ka).isNull()).join(b, on)
    right = a.filter(F.col(ka).isNotNull()).join(b.filter(F.col(kb).isNull()), on)
    return equal.unionByName(left).unionByName(right)


def boxes_in_regions(words: DataFrame, regions: DataFrame, share: float = 0.4) -> DataFrame:
    """Words of which more than ``share`` of the area lies in a region of the same document; region columns are rx0, ry0, rx1, ry1."""
    j = words.join(regions, "doc_id")
    w = F.greatest(F.lit(0.0), F.least("x1", "rx1") - F.greatest("x0", "rx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "ry1") - F.greatest("y0", "ry0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return j.filter(w * h > area * share)
