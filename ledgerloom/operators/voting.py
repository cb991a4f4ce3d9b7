"""Votes among readings of one field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.similarity import indel_ratio


def positional_vote(df: DataFrame, group: str, value: str, order: str, out: str) -> DataFrame:
    """Per group: the modal length, then at each position the modal character; ties go to the first by ``order``.

    Characters are counted per (group, position) with map-side combine; only one
    character a position is collected.
    """
    n = df.filter(F.col(value).isNotNull()).withColumn("_n", F.length(value))
    w = Window.partitionBy(group).orderBy(F.desc("_c"), "_n")
    modal = n.groupBy(group, "_n").agg(F.count("*").alias("_c")).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(group, "_n")
    ch = n.join(modal, [group, "_n"]).select(group, order, F.posexplode(F.filter(F.split(value, ""), lambda c: c != "")).alias("_i", "_ch"))
    c = ch.groupBy(group, "_i", "_ch").agg(F.count("*").alias("_c"), F.min(order).alias("_f"))
    w = Window.partitionBy(group, "_i").orderBy(F.desc("_c"), "_f")
    best = c.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_ch"))), lambda x: x["_ch"]), "").alias(out))


def clusters_of(values: list[str], scores: list[float], threshold: float = 0.8) -> list[list[int]]:
    """Greedy groups: each value joins the first group whose seed is as similar as ``threshold``."""
    groups: list[list[int]] = []
    for i, v in enumerate(values):
        for g in groups:
            if indel_ratio(v, values[g[0]]) >= threshold:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


def weighted_vote(cands: DataFrame, keys: list[str], value: str, confidence: str, weight: str, order: str, threshold: float = 0.8) -> DataFrame:
    """Winner of each key: similar values form groups, a group scores the sum of confidence times weight, a tenth more for each member of a group of several.

    Ties go to the group seen first; its best member is the winner; confidence is a
    third of the score, at most 0.95.  Equal values are folded before grouping, so
    a group in Python holds a key's distinct spellings only.
    """
    folded = cands.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(confidence) * F.col(weight)).alias("_s"), F.max(F.col(confidence) * F.col(weight)).alias("_m"), F.count("*").alias("_n"), F.min(order).alias("_o"))
    schema = T.StructType([*[folded.schema[k] for k in keys], T.StructField(value, T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("votes", T.LongType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_o").reset_index(drop=True)
        best = None
        for g in clusters_of(p[value].tolist(), p["_s"].tolist(), threshold):
            n = int(p.loc[g, "_n"].sum())
            s = float(p.loc[g, "_s"].sum()) * (1 + 0.1 * n if n > 1 else 1)
            if best is None or s > best[0] + 1e-12:
                best = (s, p.loc[g].sort_values(["_m", "_o"], ascending=[False, True]).iloc[0][value], n)
        row = p.iloc[[0]][keys].copy()
        row[value], row["score"], row["confidence"], row["votes"] = best[1], best[0], min(0.95, best[0] / 3), best[2]
        return row[[*keys, value, "score", "confidence", "votes"]]

    return folded.groupBy(*keys).applyInPandas(pick, schema)


def divergence(cands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of agreeing pairs of each key's readings, from counts, and whether it is below 0.6; single readings agree."""
    c = cands.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    s = c.groupBy(*keys).agg(F.sum("_c").alias("readings"), F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias("_same"))
    pairs = F.col("readings") * (F.col("readings") - 1) / 2
    agree = F.when(pairs > 0, F.col("_same") / pairs).otherwise(1.0)
    return s.withColumn("agreement", F.round(agree, 6)).withColumn("diverges", agree < 0.6).drop("_same")
