"""Names against a dictionary of known ones, and against a list of unwanted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, size_in_bytes
from .alike import most_alike, most_shared, search

#: A dictionary is sent to tasks in blocks of at most this many bytes.
BROADCAST_LIMIT = 8 << 20


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """``df`` in parts by hash, each small enough to be sent to every task.

    A table that is large or of unknown size is written first, which tells its true size.
    """
    if size_in_bytes(df) > BROADCAST_LIMIT:
        df = cut(df)
    n = -(-size_in_bytes(df) // BROADCAST_LIMIT)
    return [F.broadcast(df if n <= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(max(1, n))]


def _begin(c: str) -> Column:
    """The first letters of a text, three or all it has, with their number."""
    n = F.least(F.lit(3), F.length(c))
    return F.concat(n, F.lit(":"), F.substring(c, 1, 3))


def _grams(c: str) -> Column:
    """All runs of one, two and three letters of a text, with their number."""

    def all_of(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.concat(F.lit(f"{q}:"), F.substr(F.col(c), i, F.lit(q))))

    runs = [all_of(q) for q in (1, 2, 3)]
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(F.length(c) >= q, r).otherwise(empty) for q, r in zip((1, 2, 3), runs)]))


def containing(a: DataFrame, b: DataFrame, ca: str, cb: str) -> DataFrame:
    """Pairs of rows of which one text contains the other, each pair once.

    What is contained meets what contains it under its first letters, so this is an
    equi-join whatever the sizes; containment itself is the residual condition.
    Empty texts are in no pair.
    """
    inside = a.filter(F.length(ca) > 0).withColumn("_g", _begin(ca)).join(b.withColumn("_h", F.explode(_grams(cb))), (F.col("_g") == F.col("_h")) & F.contains(F.col(cb), F.col(ca)))
    around = a.withColumn("_g", F.explode(_grams(ca))).join(b.filter(F.length(cb) > 0).withColumn("_h", _begin(cb)), (F.col("_g") == F.col("_h")) & F.contains(F.col(ca), F.col(cb)) & (F.col(ca) != F.col(cb)))
    return inside.unionByName(around).drop("_g", "_h")


def match_names(names: DataFrame, known: DataFrame, name: str, least: float = 0.6, fuzzy: bool = True) -> DataFrame:
    """(name, canonical, score, tier) of the best dictionary entry for each distinct name.

    ``known`` has name, canonical and ord (place in the dictionary).  Tiers: 1 equal;
    2 one contains the other, by share of the longer, first in dictionary order; 3
    shared words over the fewer words, best first; 4 matching blocks.  Tier 1 is an
    equi-join, tier 2 joins on first letters, tier 3 counts shared words in parts of the
    dictionary, so no pair is shuffled; only names without
    an earlier hit reach the matching blocks, which search the dictionary for the
    most alike; see :func:`alike.most_alike`.

    What reads a tier's result twice reads it from a cut.  The dictionary is never
    broadcast: its size is estimated from compressed columns, and its runs of letters,
    a hundred times as large, are estimated to be no larger than it.
    """
    d = cut(names.select(F.upper(F.trim(name)).alias("name")).filter("name is not null and name <> ''").distinct())
    k = cut(known.select(F.upper(F.trim("name")).alias("kname"), "canonical", "ord"))
    by_merge = k.hint("merge")
    one = cut(d.join(by_merge, F.col("name") == F.col("kname")).groupBy("name").agg(F.max_by("canonical", "ord").alias("canonical")).select("name", "canonical", F.lit(1.0).alias("score"), F.lit(1).alias("tier")))
    rest = cut(d.join(one.hint("merge"), "name", "left_anti"))
    share = F.length("name") / F.greatest(F.length("kname"), F.length("name"))
    two = containing(rest, by_merge, "name", "kname").withColumn("score", share).filter(F.col("score") >= least)
    two = cut(two.groupBy("name").agg(F.min_by(F.struct("canonical", "score"), "ord").alias("b")).select("name", "b.canonical", "b.score", F.lit(2).alias("tier")))
    rest = rest.join(two.hint("merge"), "name", "left_anti")
    first = cut(k.filter("kname is not null").groupBy(F.col("kname").alias("known")).agg(F.min_by(F.struct("canonical", "ord"), "ord").alias("f")).select("known", "f.*"))
    met = search(rest.select("name", F.lit(least).alias("least")), first, most_shared)
    three = met.join(first.hint("merge"), "known").groupBy("name").agg(F.min_by(F.struct("canonical", F.col("ratio").alias("score")), F.struct(-F.col("ratio"), F.col("ord"))).alias("b")).select("name", "b.canonical", "b.score", F.lit(3).alias("tier"))
    if not fuzzy:
        return one.unionByName(two).unionByName(three)
    three = cut(three)
    rest = rest.join(three.hint("merge"), "name", "left_anti")
    met = search(rest.select("name", F.lit(least).alias("least")), first.select("known"), lambda n, c, x: most_alike(n, c, x, False))
    four = met.join(by_merge, F.col("known") == F.col("kname")).select("name", "canonical", "ord", F.col("ratio").alias("score"))
    four = four.groupBy("name").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("b")).select("name", "b.canonical", "b.score", F.lit(4).alias("tier"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def unwanted(names: DataFrame, banned: DataFrame, name: str) -> DataFrame:
    """Distinct names equal to, containing or contained in a banned one."""
    d = names.select(F.upper(F.trim(name)).alias("name")).filter("name is not null and name <> ''").distinct()
    b = banned.select(F.upper(F.trim("name")).alias("b")).filter("b <> ''").distinct()
    return containing(d, b, "name", "b").select("name").distinct()
