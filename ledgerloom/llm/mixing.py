"""Mixing sources to target shares of the total size, by Pfair block scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut
from .tokens import token_counts


def quotas(total: float, share: dict[str, float], capacity: dict[str, float]) -> dict[str, float]:
    """Size each source gives to a mix of ``total``.

    A source that cannot reach its share gives its whole capacity; what is missing
    is spread over the others in proportion to their shares, again and again until
    none overflows.  If all overflow the mix is smaller than ``total``.
    """
    full: set[str] = set()
    while True:
        free = [s for s in share if s not in full and share[s] > 0]
        left = total - sum(capacity[s] for s in full)
        weight = sum(share[s] for s in free)
        over = {s for s in free if left * share[s] / weight > capacity[s]} if free else set()
        if not over:
            return {s: capacity[s] if s in full else (max(left, 0) * share[s] / weight if s in free else 0.0) for s in share}
        full |= over


def pfair_slots(weight: dict[str, float], blocks: int) -> list[tuple[str, int, int]]:
    """(source, block, slot): which block of which source runs in each of ``blocks`` equal slots.

    Block k of a source of weight w is released at floor(k / w) and due at
    ceil((k + 1) / w); each slot runs the released block due first (ties by
    source).  The weights add up to 1, so at every slot each source has run less
    than one block more or less than its weight times the time.
    """
    total = sum(weight.values())
    w = {s: v / total for s, v in weight.items() if v > 0}
    near = lambda v: round(v) if abs(v - round(v)) < 1e-9 else v
    release = lambda s, k: int(near(k / w[s]) // 1)
    due = lambda s, k: int(-(-near((k + 1) / w[s]) // 1))
    waiting = [(0, s, 0) for s in sorted(w)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(blocks):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        if not ready:  # rounding left the slot free: run the block released next
            t, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def whole_slots(weight: dict[str, float], blocks: int) -> list[tuple[str, int, int]]:
    """:func:`pfair_slots` in which every source of weight above 0 has a block.

    A source of less than one block may be due only after the last slot; its one
    block gets a slot of its own, such slots evenly spread between the others.
    """
    slots = pfair_slots(weight, blocks)
    lost = sorted({s for s, v in weight.items() if v > 0} - {s for s, _, _ in slots})
    n = len(slots)
    for i, s in reversed(list(enumerate(lost))):
        slots.insert((i + 1) * n // (len(lost) + 1), (s, 0, 0))
    return [(s, k, slot) for slot, (s, k, _) in enumerate(slots)]


def sized_offsets(df: DataFrame, group: str, order: str, size: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """``df`` with ``start``: the size of its group's rows before it, and ``group_size``.

    Prefix sums in two levels, so no group is ever sorted in one task: rows are
    hashed into buckets of about ``rows_per_bucket`` rows, bucket totals are summed
    in bucket order, and a window runs inside each bucket only.  The order within a
    group is bucket, then ``order``, then a row's hash: fixed for a given table.
    """
    n = df.count()
    k = max(1, -(-n // rows_per_bucket))
    b = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(k)).cast("int"))
    sums = b.groupBy(group, "_b").agg(F.sum(size).alias("_s"))
    by_group = Window.partitionBy(group)
    sums = sums.withColumn("_before", F.sum("_s").over(by_group.orderBy("_b")) - F.col("_s")).withColumn("group_size", F.sum("_s").over(by_group))
    within = Window.partitionBy(group, "_b").orderBy(order, F.col(size)).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("_in", F.sum(size).over(within) - F.col(size)).join(sums, [group, "_b"]).withColumn("start", F.col("_before") + F.col("_in")).drop("_b", "_s", "_before", "_in")


def _plan(sized: DataFrame, target: DataFrame, total: int | None):
    """Driver-side plan: one row a source, so bounded by the number of listed sources."""
    have = {r["source"]: r["t"] or 0 for r in sized.filter("source is not null").join(F.broadcast(target.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    rows = [r for r in target.groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect() if r["source"] is not None]
    share = {r["source"]: max(r["s"] or 0.0, 0.0) for r in rows}
    repeats = {r["source"]: max(r["m"] or 0, 0) for r in rows}
    capacity = {s: float(have.get(s, 0) * repeats[s]) for s in share}
    want = float(sum(have.values()) if total is None else total)
    return share, repeats, have, quotas(want, share, capacity)


def mix(docs: DataFrame, target: DataFrame, total: int | None = None, blocks: int = 4096, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """Chosen records with their repeats, and the shares reached.

    Sizes are tokens of a public tokenizer.  ``total`` is the size wanted, by
    default that of all records of listed sources.  Each source gives its quota
    (see :func:`quotas`); its records are taken in a fixed order, all of them
    ``j`` times before any is taken ``j + 1`` times, and a record is taken if its
    middle lies within the quota - so a source misses its quota by half a record
    at most.  The quota of every source is cut into blocks of total / ``blocks``,
    and Pfair scheduling orders the blocks; ``slot`` and ``start_token`` give the
    order of the mix.  A record belongs to the block it starts in, and a source of
    less than one block has one slot.

    Records: doc_id, source, repeat (from 1), n_tokens, slot, start_token.
    Shares: source, target_share, actual_share, tokens, records, times (most
    uses of one record), max_repeats, available_tokens.

    Rows of unlisted or null sources are not part of the mix.  Null and empty
    texts have size 0 and are never chosen (they add nothing).  Null shares or
    repeats count as 0; a source listed twice takes its larger values.  Repeated
    rows are records of their own.  Empty tables give no records and shares of 0.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    # a text that is not empty has a token; filtering on the count would count twice
    sized = cut(token_counts(docs.select("doc_id", "source", "text").filter("length(text) > 0"), **tokenizer).select("doc_id", "source", "n_tokens"))
    share, repeats, have, quota = _plan(sized, target, total)
    size = sum(quota.values())
    block = max(size / blocks, 1e-9)
    slots = whole_slots(quota, blocks) if size > 0 else []
    plan = spark.createDataFrame([(s, float(quota[s]), repeats[s]) for s in share], "source string, quota double, max_repeats int")
    at = spark.createDataFrame(slots, "source string, block int, slot int")
    rows = sized_offsets(sized.join(F.broadcast(plan), "source"), "source", "doc_id", "n_tokens")
    # copy j of a record starts at j * group_size + start; it is taken if its middle is below the quota
    uses = F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.ceil((F.col("quota") - F.col("start") - F.col("n_tokens") / 2) / F.col("group_size"))).cast("int"))
    taken = rows.withColumn("uses", uses).filter("uses > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    taken = taken.withColumn("start_token", (F.col("repeat") - 1) * F.col("group_size") + F.col("start"))
    taken = taken.withColumn("block", F.floor(F.col("start_token") / F.lit(block)).cast("int"))
    last = {s: max((k for x, k, _ in slots if x == s), default=0) for s in share}
    ends = spark.createDataFrame(list(last.items()), "source string, last int")
    # rounding may leave a quota's last part without a block of its own: it goes with the one before
    taken = taken.join(F.broadcast(ends), "source").withColumn("block", F.least("block", "last")).join(F.broadcast(at), ["source", "block"])
    records = taken.select("doc_id", "source", "repeat", "n_tokens", "slot", "start_token")
    got = cut(records.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.max("repeat").alias("times")))
    listed = spark.createDataFrame([(s, float(share[s]), repeats[s], int(have.get(s, 0))) for s in share], T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("available_tokens", T.LongType())]))
    whole = got.agg(F.sum("tokens").alias("_all"))
    shares = listed.join(got, "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("times", F.lit(0)).alias("times"), "max_repeats", "available_tokens")
    return records, shares
