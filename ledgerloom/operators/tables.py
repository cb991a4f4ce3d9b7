"""Table operators: deduplicated ingest, upserts, deletions, latest rows, rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ingest_new(new: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is unknown, the first by ``order`` of each key; rows without a key are all kept."""
    w = Window.partitionBy(key).orderBy(order)
    first = new.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(known.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(new.columns).unionByName(new.filter(F.col(key).isNull()))


def upsert(old: DataFrame, new: DataFrame, key: str, zero_is_missing: list[str] = [], keep_old_if_null: list[str] = []) -> DataFrame:
    """``old`` with the values of ``new``: 0 and null of ``zero_is_missing`` and null of ``keep_old_if_null`` leave the old value; unknown keys are added."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        if c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in zero_is_missing:
            cols.append(F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit(0)), F.col(f"o.{c}")).alias(c))
        elif c in keep_old_if_null:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(cols)


def bulk_edit(rows: DataFrame, ids: DataFrame, key: str, values: dict[str, str | None]) -> DataFrame:
    """``rows`` with the non-blank ``values`` set where the key is among ``ids``."""
    hit = ids.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_hit", F.lit(True))
    j = rows.join(hit, rows[key] == F.col("_k"), "left")
    return j.select([F.when(F.col("_hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if (values.get(c) or "").strip() else F.col(c) for c in rows.columns])


def cascade_delete(doomed: DataFrame, key: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each table without the rows whose listed columns name a doomed key."""
    d = doomed.select(F.col(key).alias("_d")).filter("_d is not null").distinct()
    out = {}
    for name, (t, cols) in tables.items():
        for c in cols:
            t = t.join(d, t[c] == F.col("_d"), "left_anti")
        out[name] = t
    return out


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def collision_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """``out``: the name, with ' (n)' before its extension for the n-th repetition by ``order``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))).drop("_n")


def segments(pages: DataFrame, doc: str, page: str, kind: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Gaps and islands: a page starts a segment if its kind differs from the page before and neither is unknown.

    Adds ``segment`` (from 1) and ``segment_kind``, the kind of its first page.
    """
    w = Window.partitionBy(doc).orderBy(page)
    before = F.lag(kind).over(w)
    new = before.isNull() | ((before != F.col(kind)) & (before != unknown) & (F.col(kind) != unknown))
    d = pages.withColumn("_s", new.cast("int")).withColumn("segment", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return d.withColumn("segment_kind", F.first(kind).over(Window.partitionBy(doc, "segment").orderBy(page)))
