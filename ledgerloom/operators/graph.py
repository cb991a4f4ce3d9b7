"""Document graphs: edges from several rules, the best edge of each pair, connected components, assignment."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, drop_cut


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: the smallest ``priority``, then the largest ``weight``, then ``reason``."""
    e = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    g = e.groupBy("a", "b").agg(F.min(F.struct("priority", (-F.col("weight")).alias("w"), "reason")).alias("best"))
    return g.select(F.col("a").alias("src"), F.col("b").alias("dst"), (-F.col("best.w")).alias("weight"), F.col("best.reason").alias("reason"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable, by large-star and small-star rounds.

    Each round links every neighbour larger than a vertex to the vertex's smallest
    neighbour, then every smaller one; edges become stars in about log2 of the
    longest path rounds.  Edges are read once.  Rounds are cut, so losing an executor
    repeats one round; while a round's vertices are written, those are counted that
    have a smaller neighbour and another one as well - none is left when all is stars.
    """
    e = cut(edges.select(F.greatest(src, dst).alias("x"), F.least(src, dst).alias("y")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct())
    cur = e.filter("x <> y")
    last = None
    while True:
        both = cur.union(cur.select("y", "x"))
        stars = cut(both.groupBy("x").agg(F.min("y").alias("n"), F.count("*").alias("c")).select("x", F.least("x", "n").alias("m"), "c"), count="m < x and c > 1")
        if not stars.counted:
            lab = stars.select(F.col("x").alias("id"), F.col("m").alias("component"))
            alone = e.filter("x = y").select(F.col("x").alias("id")).join(lab, "id", "left_anti").withColumn("component", F.col("id"))
            return lab.unionByName(alone)
        large = cut(both.join(stars.select("x", "m"), "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        nxt = cut(large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct())
        drop_cut(stars, large, last)
        cur = last = nxt


def greedy_pairs(pairs: DataFrame, a: str, b: str, *order: Column) -> DataFrame:
    """Pairs taken in ``order``, each side at most once: rounds of pairs that come first for both sides, then one pass over what is left.

    A pair first for both sides is taken by the sequential loop as well, so the
    result equals taking pairs one by one.  A round is worth its two shuffles while it
    leaves no more than half of the pairs; many rows that want the same few would need
    a round for each.  The pass sorts the pairs that are left (a sort may spill) and
    streams them through one task, which keeps the ids taken, not the pairs.
    ``order`` must be total within each side.
    """
    left, done = cut(pairs, count=F.lit(True)), None
    while left.counted:
        best = cut(left.withColumn("_i", F.row_number().over(Window.partitionBy(a).orderBy(*order))).withColumn("_j", F.row_number().over(Window.partitionBy(b).orderBy(*order))).filter("_i = 1 and _j = 1").drop("_i", "_j"))
        done = best if done is None else done.unionByName(best)
        nxt = cut(left.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti").select(*left.columns), count=F.lit(True))
        slow = nxt.counted * 2 > left.counted
        drop_cut(left)
        left = nxt
        if slow:
            done = done.unionByName(cut(_in_order(left, a, b, *order)))
            break
    drop_cut(left)
    return pairs.limit(0) if done is None else done


def _in_order(pairs: DataFrame, a: str, b: str, *order: Column) -> DataFrame:
    """Pairs taken one by one in one task."""

    def take(batches):
        used_a, used_b = set(), set()
        for rows in batches:
            keep = []
            for x, y in zip(rows.column(a).to_pylist(), rows.column(b).to_pylist()):
                free = x not in used_a and y not in used_b
                if free:
                    used_a.add(x)
                    used_b.add(y)
                keep.append(free)
            yield rows.filter(pa.array(keep, pa.bool_()))

    return pairs.coalesce(1).sortWithinPartitions(*order).mapInArrow(take, pairs.schema)


def matching_of(a: np.ndarray, b: np.ndarray, gain: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """(row, column) pairs, each row and column at most once, of the largest total gain; a[k], b[k], gain[k] are the pairs with a gain above 0.

    Shortest augmenting paths with integer prices: a row enters at its best gain and
    the cheapest way is sought to a free column, or to a row that had better stay
    alone.  Only rows and columns nearer than that are touched; a row's pairs are
    looked through at once.
    """
    order = np.lexsort((b, a))
    a, b, gain = a[order], b[order], gain[order].astype(np.int64)
    start = np.searchsorted(a, np.arange(n + 1))
    of_row, of_col = np.full(n, -1, np.int64), np.full(m, -1, np.int64)
    u, v = np.zeros(n, np.int64), np.zeros(m, np.int64)
    far = np.iinfo(np.int64).max
    dist, via = np.full(m, far), np.full(m, -1, np.int64)
    for root in range(n):
        lo, hi = start[root], start[root + 1]
        u[root] = max(0, int((gain[lo:hi] - v[b[lo:hi]]).max())) if hi > lo else 0
        if not u[root]:
            continue
        rows, cols, touched, heap, done = [(root, 0)], [], [], [], set()
        end, alone, last = int(u[root]), root, -1  # the cheapest end so far: this row stays alone, or a free column
        row, d = root, 0
        while True:
            x = b[start[row] : start[row + 1]]
            new = d + u[row] + v[x] - gain[start[row] : start[row + 1]]
            near = (new < dist[x]) & (new < end)
            x, new = x[near], new[near]
            if len(x):
                dist[x], via[x] = new, row
                touched.append(x)
                free = of_col[x] < 0
                if free.any():
                    k = int(np.where(free, new, far).argmin())
                    end, alone, last = int(new[k]), -1, int(x[k])
                for k, c in zip(new[~free].tolist(), x[~free].tolist()):
                    heapq.heappush(heap, (k, c))
            row = -1
            while heap and row < 0:
                d, c = heapq.heappop(heap)
                if d >= end:
                    break
                if c not in done:
                    done.add(c)
                    cols.append((c, d))
                    row = int(of_col[c])
            if row < 0:
                break
            rows.append((row, d))
            if d + u[row] < end:
                end, alone, last = int(d + u[row]), row, -1
        for r, d in rows:
            u[r] -= end - d
        for c, d in cols:
            v[c] += end - d
        if alone >= 0:  # the row gives up its column, if it has one
            last, of_row[alone] = int(of_row[alone]), -1
        while last >= 0:
            r = int(via[last])
            of_col[last] = r
            of_row[r], last = last, int(of_row[r])
        for x in touched:
            dist[x], via[x] = far, -1
    return [(i, int(c)) for i, c in enumerate(of_row) if c >= 0]


def assignment(pairs: DataFrame, a: str, b: str, gain: str, group: str | None = None) -> DataFrame:
    """One-to-one pairs with the largest total gain; gains are integers above 0, every side may stay alone.

    Each component of the pairs is solved by itself in one task, whose memory follows
    its pairs; see :func:`matching_of`.  ``group`` may name a column that no component
    crosses, which saves looking for components.
    """
    p = pairs.groupBy(*([group] if group else []), a, b).agg(F.max(gain).alias(gain))
    if group is None:
        p = cut(p)
        # both sides in one space of ids: those of b as odd numbers, or texts with another first letter
        text = "string" in (dict(p.dtypes)[a], dict(p.dtypes)[b])
        ids = [F.concat(F.lit(x), F.col(c)) if text else F.col(c).cast("bigint") * 2 + k for k, (x, c) in enumerate((("a", a), ("b", b)))]
        p = p.withColumn("_a", ids[0]).withColumn("_b", ids[1])
        p = p.join(components(p, "_a", "_b").select(F.col("id").alias("_a"), F.col("component").alias("_g")), "_a")
        group = "_g"
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.select(a, b, gain).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.unique(pdf[c].to_numpy(), return_inverse=True) for c in (a, b)]
        small = 0 if len(sides[0][0]) <= len(sides[1][0]) else 1  # fewer rows, fewer paths
        (rn, r), (cn, c) = sides[small], sides[1 - small]
        g = pdf[gain].to_numpy()
        got = matching_of(r, c, g, len(rn), len(cn))
        i, j = np.array(got, dtype=np.int64).reshape(-1, 2).T
        key = r * len(cn) + c
        order = np.argsort(key)
        won = g[order[np.searchsorted(key, i * len(cn) + j, sorter=order)]]
        x, y = (rn[i], cn[j]) if small == 0 else (cn[j], rn[i])
        return pd.DataFrame({a: x, b: y, gain: won})

    return p.select(F.col(group).alias("_group"), a, b, gain).groupBy("_group").applyInPandas(solve, out)


#: Its former name, from when prices were bid up in rounds.
auction_assignment = assignment


def greedy_flow(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, flow): amounts sent from a to b within cap_a and cap_b, cheapest pairs first, larger possible amounts before smaller.

    In each round pairs that come first for both sides send what both have left;
    a side that is used up leaves.  Every round uses up a side, and the result
    equals a loop that always sends the pair first by (cost, larger amount left, ids).
    """
    left, done = cut(pairs.filter("cap_a > 0 and cap_b > 0")), None
    while True:
        order = [F.col("cost"), F.desc("most"), F.col(a), F.col(b)]
        p = left.withColumn("most", F.least("cap_a", "cap_b"))
        best = cut(p.withColumn("_i", F.row_number().over(Window.partitionBy(a).orderBy(*order))).withColumn("_j", F.row_number().over(Window.partitionBy(b).orderBy(*order))).filter("_i = 1 and _j = 1").select(a, b, F.col("most").alias("flow")), count=F.lit(True))
        if not best.counted:
            drop_cut(left)
            return best if done is None else done
        done = best if done is None else done.unionByName(best)
        ua, ub = best.select(F.col(a), F.col("flow").alias("fa")), best.select(F.col(b), F.col("flow").alias("fb"))
        sent = best.select(a, b)
        nxt = left.join(ua, a, "left").join(ub, b, "left").join(sent, [a, b], "left_anti")
        nxt = cut(nxt.select(a, b, (F.col("cap_a") - F.coalesce("fa", F.lit(0))).alias("cap_a"), (F.col("cap_b") - F.coalesce("fb", F.lit(0))).alias("cap_b"), "cost").filter("cap_a > 0 and cap_b > 0"))
        drop_cut(left)
        left = nxt


FAR = 45  # days from which on all distances cost the same


def _level(gap: int | None) -> int:
    """Cost of a pair of one supplier in hundredths, from its days apart; as scores.match_cost."""
    return int((0.2 if gap is None else 0.5 if abs(gap) > FAR else abs(gap) / 45.0 * 0.3) * 100)


def flow_of(cap_a: list[int], cap_b: list[int], day_a: list, day_b: list, tag_a: list, tag_b: list) -> list[tuple[int, int, int]]:
    """(i, j, amount) sent between rows of one supplier, each pair considered unless both tags are given and differ.

    Always the pair first by (cost, larger amount left, i, j), as :func:`greedy_flow`,
    but pairs are never listed: cost depends on days apart only, so the largest
    amount left by tag and day tells the best pair of a cost.  Memory follows rows
    and days; each step uses up a row and passes over the rows once.
    """
    ca, cb = np.array(cap_a, dtype=np.int64), np.array(cap_b, dtype=np.int64)
    known = [d for d in [*day_a, *day_b] if d is not None]
    first = min(known, default=0)
    days = max(known, default=0) - first + 1
    at = lambda v: np.array([days if d is None else d - first for d in v], dtype=np.int64)  # noqa: E731  missing days come last
    da, db = at(day_a), at(day_b)
    names = {x: k + 1 for k, x in enumerate(sorted({x for x in [*tag_a, *tag_b] if x is not None}))}
    ta, tb = (np.array([names.get(x, 0) for x in v], dtype=np.int64) for v in (tag_a, tag_b))
    n = days + 1
    top_a, top_b = np.zeros((len(names) + 1, n), np.int64), np.zeros((len(names) + 1, n), np.int64)
    np.maximum.at(top_a, (ta, da), ca)
    np.maximum.at(top_b, (tb, db), cb)
    by = lambda t, d: {k: np.array(v) for k, v in _grouped(zip(t.tolist(), d.tolist())).items()}
    rows_a, rows_b = by(ta, da), by(tb, db)
    ua, ub = np.unique(da[da < days]), np.unique(db[db < days])
    apart = set(np.unique(np.minimum(np.abs(ua[:, None] - ub[None, :]), FAR + 1)).tolist())
    levels: dict[int, list] = {}
    for g in [None, *sorted(apart)]:
        if g is not None or (da == days).any() or (db == days).any():
            levels.setdefault(_level(g), []).append(g)
    out = []
    for level in sorted(levels):
        gaps = levels[level]
        while True:
            reach = np.maximum(top_b, top_b[0])
            reach[0] = top_b.max(axis=0)
            best = np.zeros_like(reach)
            on, to = best[:, :days], reach[:, :days]
            for g in gaps:
                if g is None:
                    np.maximum(on, reach[:, days:], out=on)
                    best[:, days] = np.maximum(best[:, days], reach.max(axis=1))
                elif g > FAR:
                    if days > g:
                        np.maximum(on[:, g:], np.maximum.accumulate(to, axis=1)[:, :-g], out=on[:, g:])
                        np.maximum(on[:, :-g], np.maximum.accumulate(to[:, ::-1], axis=1)[:, ::-1][:, g:], out=on[:, :-g])
                elif g == 0:
                    np.maximum(on, to, out=on)
                elif days > g:
                    np.maximum(on[:, g:], to[:, :-g], out=on[:, g:])
                    np.maximum(on[:, :-g], to[:, g:], out=on[:, :-g])
            most = int(np.minimum(top_a, best).max())
            if most <= 0:
                break
            i = int(np.argmax((ca >= most) & (best[ta, da] >= most)))
            missing = (db == days) | (da[i] == days)
            gap = np.minimum(np.abs(db - da[i]), FAR + 1)
            fits = np.zeros(len(cb), bool)
            for g in gaps:
                fits |= missing if g is None else ~missing & (gap == g)
            j = int(np.argmax(fits & (cb >= most) & ((ta[i] == 0) | (tb == 0) | (tb == ta[i]))))
            out.append((i, j, most))
            ca[i] -= most
            cb[j] -= most
            x, y = (int(ta[i]), int(da[i])), (int(tb[j]), int(db[j]))
            top_a[x], top_b[y] = ca[rows_a[x]].max(), cb[rows_b[y]].max()
    return out


def _grouped(keys) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        out.setdefault(k, []).append(i)
    return out


def supplier_flow(a: DataFrame, b: DataFrame) -> DataFrame:
    """(payment, bill, flow) between all rows of a supplier; columns of both: id, s, v (amount), day, tag.

    The rows of a supplier meet in one task, their pairs nowhere; see :func:`flow_of`.
    """
    both = a.select("s").distinct().join(b.select("s").distinct(), "s")
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day")
    side = lambda x, n: x.filter("v > 0").select("s", F.lit(n).alias("side"), "id", "v", day, "tag")
    rows = side(a, 0).unionByName(side(b, 1)).join(both, "s", "left_semi")
    kind = dict(rows.dtypes)["id"]

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p, n = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        days = [[None if pd.isna(d) else int(d) for d in x["day"]] for x in (p, n)]
        tags = [[None if pd.isna(t) or not t else t for t in x["tag"]] for x in (p, n)]
        got = flow_of(p["v"].tolist(), n["v"].tolist(), *days, *tags)
        pid, nid = p["id"].tolist(), n["id"].tolist()
        return pd.DataFrame([(pid[i], nid[j], f) for i, j, f in got], columns=["payment", "bill", "flow"])

    return rows.groupBy("s").applyInPandas(send, f"payment {kind}, bill {kind}, flow bigint")


def best_flow(cap_a: list[int], cap_b: list[int], profit: np.ndarray) -> np.ndarray:
    """Amounts x[i, j] of the largest total of x * profit with row sums within cap_a and column sums within cap_b; pairs of profit 0 or less carry nothing.

    Longest augmenting paths, each found by relaxing all pairs at once: the path from
    a row with something left to a column with room that gains most is filled until
    none gains anything, which is the optimum of this transportation problem.
    """
    p, gained = np.where(profit > 0, profit.astype(float), -np.inf), np.where(profit > 0, profit, 0)
    ra, rb = np.array(cap_a, dtype=np.int64), np.array(cap_b, dtype=np.int64)
    x = np.zeros(p.shape, np.int64)
    while p.size:
        da, db = np.where(ra > 0, 0.0, -np.inf), np.full(len(rb), -np.inf)
        via_a, via_b = np.full(len(ra), -1), np.full(len(rb), -1)
        while True:
            gain = da[:, None] + p
            i = gain.argmax(axis=0)
            top = gain[i, np.arange(len(rb))]
            better = top > db + 1e-9
            db[better], via_b[better] = top[better], i[better]
            back = np.where(x > 0, db[None, :] - gained, -np.inf)
            j = back.argmax(axis=1)
            top = back[np.arange(len(ra)), j]
            moved = top > da + 1e-9
            da[moved], via_a[moved] = top[moved], j[moved]
            if not moved.any():
                break
        open_ = np.where(rb > 0, db, -np.inf)
        end = int(open_.argmax())
        if not open_[end] > 1e-9:
            break
        path, col = [], end
        while True:
            row = int(via_b[col])
            path.append((row, col))
            if via_a[row] < 0:
                break
            col = int(via_a[row])
        most = min([rb[end], ra[path[-1][0]], *(x[path[k][0], path[k + 1][1]] for k in range(len(path) - 1))])
        for k, (row, col) in enumerate(path):
            x[row, col] += most
            if k + 1 < len(path):
                x[row, path[k + 1][1]] -= most
        rb[end] -= most
        ra[path[-1][0]] -= most
    return x


def flow_gap(a: DataFrame, b: DataFrame, pairs: int = 2500) -> DataFrame:
    """(s, payments, bills, greedy, best): profit of the greedy flow of each supplier and of the best one.

    The profit of a pair is 1000 less its cost in hundredths for each cent sent.  The
    best flow is sought where a supplier has at most ``pairs`` pairs; beyond that
    ``best`` is null, as rows times pairs of work would not end.  Columns as in :func:`supplier_flow`.
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day")
    side = lambda x, n: x.filter("v > 0").select("s", F.lit(n).alias("side"), "id", "v", day, "tag")
    both = a.select("s").distinct().join(b.select("s").distinct(), "s")
    rows = side(a, 0).unionByName(side(b, 1)).join(both, "s", "left_semi")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p, n = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        days = [[None if pd.isna(d) else int(d) for d in x["day"]] for x in (p, n)]
        tags = [[None if pd.isna(t) or not t else t for t in x["tag"]] for x in (p, n)]
        worth = lambda i, j: 1000 - _level(None if days[0][i] is None or days[1][j] is None else days[0][i] - days[1][j])
        got = flow_of(p["v"].tolist(), n["v"].tolist(), *days, *tags)
        greedy = sum(f * worth(i, j) for i, j, f in got)
        best = None
        if len(p) * len(n) <= pairs:
            profit = np.array([[worth(i, j) if tags[0][i] is None or tags[1][j] is None or tags[0][i] == tags[1][j] else 0 for j in range(len(n))] for i in range(len(p))]).reshape(len(p), len(n))
            best = int((best_flow(p["v"].tolist(), n["v"].tolist(), profit) * profit).sum())
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "payments": [len(p)], "bills": [len(n)], "greedy": [int(greedy)], "best": pd.array([best], dtype="Int64")})

    return rows.groupBy("s").applyInPandas(send, "s string, payments bigint, bills bigint, greedy bigint, best bigint")
