"""File sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import read_text


def pdf_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, modified and the MD5 of every PDF below a folder, each once whatever the case of its ending."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", str(recursive).lower())
    return r.load(folder).select("path", F.col("length"), F.col("modificationTime").alias("modified"), F.md5("content").alias("file_hash"))


def name_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """name, canonical, ord of a text file with lines ``canonical|alias|alias``; '#' opens a comment.

    ``ord`` is the place of the line's first occurrence by text offset of one file,
    then of the name within its line; of equal names the later line wins.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "v")).select("line", F.trim("v").alias("v")).filter("v <> '' and not startswith(v, '#')")
    names = lines.select("line", F.transform(F.split("v", r"\|"), lambda x: F.upper(F.trim(x))).alias("n"))
    e = names.select("line", F.get("n", F.lit(0)).alias("canonical"), F.posexplode("n").alias("k", "name")).filter("name <> ''").withColumn("ord", F.col("line").cast("bigint") * F.lit(1 << 31) + F.col("k"))
    return e.groupBy("name").agg(F.max_by("canonical", "ord").alias("canonical"), F.max("ord").alias("ord"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One upper-case name a line; '#' opens a comment."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("name")).filter("name <> '' and not startswith(name, '#')").distinct()


def suppliers_of_filenames(files: DataFrame, name: str = "file") -> DataFrame:
    """Distinct third parts of names such as DATE_TAG_SUPPLIER_VALUE_TYPE."""
    return files.select(F.upper(F.trim(F.split_part(F.col(name), F.lit("_"), F.lit(3)))).alias("name")).filter("length(name) > 2").distinct()


def golden_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON file of hand-checked truth, one row each; entries with an error are left out."""
    d = spark.read.option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    return d.filter("error is null") if "error" in d.columns else d


def pattern_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """field, doc_type, ord, pattern, confidence of a JSON catalogue {field: {type: [[pattern, confidence]]}}; patterns that do not compile are left out.

    The file is a configuration of a few kilobytes and read on the driver, from any
    file system that Spark knows.
    """
    import re

    cat = json.loads(read_text(spark, path) or "{}")
    rows = []
    for field, types in cat.items():
        for kind, entries in types.items():
            for i, (p, c) in enumerate(entries):
                try:
                    re.compile(p)
                except re.error:
                    continue
                rows.append((field, kind, i, p, float(c)))
    return spark.createDataFrame(rows, "field string, doc_type string, ord int, pattern string, confidence double")


def append_patterns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue with the patterns of ``new`` that it lacks, numbered after those it has."""
    fresh = new.dropDuplicates(["field", "doc_type", "pattern"]).join(old, ["field", "doc_type", "pattern"], "left_anti")
    most = old.groupBy("field", "doc_type").agg(F.max("ord").alias("_m"))
    n = F.row_number().over(Window.partitionBy("field", "doc_type").orderBy("ord", "pattern"))
    return old.unionByName(fresh.join(most, ["field", "doc_type"], "left").withColumn("ord", F.coalesce("_m", F.lit(-1)) + n).select(old.columns))


def write_csv(df: DataFrame, path: str, sep: str = ",", only: str | None = None) -> None:
    """CSV with a header; ``only`` is a condition on the rows written."""
    (df.filter(only) if only else df).write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then swap by two renames.

    A reader never sees part of a table, but between the renames there is none; a
    reader that must not fail there tries again.  A run that stopped between them is
    put right by the next.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(conf)
    if not fs.exists(p(path)) and fs.exists(p(path + ".old")):
        fs.rename(p(path + ".old"), p(path))
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(p(path)):
        fs.delete(p(path + ".old"), True)
        fs.rename(p(path), p(path + ".old"))
    fs.rename(p(path + ".new"), p(path))
    fs.delete(p(path + ".old"), True)


def safe_name(c):
    """File name with anything but letters, figures, dots and hyphens replaced by an underscore."""
    return F.regexp_replace(c, r"(?U)[^\w.\-]", "_")


def graph_json(vertices: DataFrame, edges: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """JSON texts of each component, its nodes and links in pieces of at most ``most`` of either; a large component has several pieces, from 0."""

    def pieces(rows: DataFrame, name: str, *cols: str) -> DataFrame:
        w = Window.partitionBy(group).orderBy(*cols)
        n = rows.withColumn("piece", F.floor((F.row_number().over(w) - 1) / most).cast("int"))
        return n.groupBy(group, "piece").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    n, e = pieces(vertices, "nodes", "id", "kind"), pieces(edges, "links", "src", "dst", "weight")
    return n.join(e, [group, "piece"], "full_outer").select(group, "piece", F.to_json(F.struct("nodes", "links")).alias("graph"))
