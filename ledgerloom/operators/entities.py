"""Names and company numbers against a dimension of known companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.similarity import normalise_company, pair_udf, token_set_ratio
from ..session import cut
from .alike import most_alike, most_words, search


def closest_known(names: DataFrame, known: DataFrame, name: str, least: float = 0.85, short: float = 0.75) -> DataFrame:
    """(name, known, tier) of each distinct name that is known: equal; one begins with the other and they differ by less than ten letters; or alike in matching blocks (``short`` for names under six letters).

    Ties of tier 2 go to the first by letters, of tier 3 to the most alike, then by
    letters.  The known names are searched as a stated query set (see :func:`alike.most_alike`);
    names of tiers 1 and 2 leave before that.  Null and empty names match nothing.
    """
    d = names.select(F.upper(name).alias("name")).filter("name <> ''").distinct()
    k = known.select(F.upper("name").alias("known")).filter("known <> ''").distinct()
    one = d.join(k, F.col("name") == F.col("known"), "left_semi").select("name", F.col("name").alias("known"), F.lit(1).alias("tier"))
    rest = d.join(one, "name", "left_anti")
    # less than ten letters longer: one is among the other's beginnings
    begun = lambda c: F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.length(c) - 9), F.length(c)), lambda n: F.substr(F.col(c), F.lit(1), n))).alias("begun")
    two = rest.select("name", begun("name")).join(k, F.col("begun") == F.col("known")).unionByName(k.select("known", begun("known")).join(rest, F.col("begun") == F.col("name")))
    two = cut(two.groupBy("name").agg(F.min("known").alias("known")).select("name", "known", F.lit(2).alias("tier")))
    cutoff = F.when(F.length("name") < 6, short).otherwise(least)
    met = search(rest.join(two, "name", "left_anti").withColumn("least", cutoff), k, lambda n, c, x: most_alike(n, c, x, True))
    three = met.groupBy("name").agg(F.min(F.struct(-F.col("ratio"), "known")).alias("b")).select("name", "b.known", F.lit(3).alias("tier"))
    return one.unionByName(two).unionByName(three)


def cross_validate(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, status, confidence, cnpj, name, method) of rows with cnpj and name, against known companies (cnpj, name).

    A company number whose check figures hold and that is known decides: APPROVED if
    the names share their words to 80 per cent, else WARNING, as the number is the
    stronger key.  Otherwise the known name that agrees to 95 per cent is inferred
    (ties: the first by letters).  Everything else is REJECTED.
    """
    k = known.select(ids.digits_only(F.col("cnpj")).alias("k_cnpj"), F.col("name").alias("k_name")).filter("k_cnpj <> ''").dropDuplicates(["k_cnpj"]).withColumn("k_clean", normalise_company(F.col("k_name")))
    r = rows.select(key, ids.digits_only(F.col("cnpj")).alias("c"), normalise_company(F.coalesce("name", F.lit(""))).alias("n"))
    r = r.withColumn("c", F.when(ids.is_cnpj(F.col("c")), F.col("c")))
    by_number = r.join(k, F.col("c") == F.col("k_cnpj"), "left").withColumn("ratio", pair_udf(token_set_ratio)("n", "k_clean"))
    hit = by_number.filter("k_cnpj is not null")
    sure = F.col("ratio") >= 0.8
    first = hit.select(key, F.when(sure, "APPROVED").otherwise("WARNING").alias("status"), F.when(sure, 1.0).otherwise(0.9).alias("confidence"), F.col("k_cnpj").alias("cnpj"), F.col("k_name").alias("name"), F.when(sure, "NUMBER").otherwise("NUMBER_OTHER_NAME").alias("method"))
    rest = by_number.filter("k_cnpj is null").select(key, "n")
    met = search(rest.select(F.col("n").alias("name")).filter("name <> ''").distinct().withColumn("least", F.lit(0.95)), k.select(F.col("k_clean").alias("known")).filter("known <> ''").distinct(), most_words)
    alike = met.join(k, F.col("known") == F.col("k_clean")).groupBy(F.col("name").alias("n")).agg(F.min(F.struct(-F.col("ratio"), "k_name", "k_cnpj")).alias("b"))
    second = rest.join(alike, "n", "left").select(key, F.when(F.col("b").isNotNull(), "APPROVED").otherwise("REJECTED").alias("status"), F.coalesce(-F.col("b.col1"), F.lit(0.0)).alias("confidence"), F.col("b.k_cnpj").alias("cnpj"), F.col("b.k_name").alias("name"), F.when(F.col("b").isNotNull(), "NAME").otherwise("NONE").alias("method"))
    return first.unionByName(second)
