"""Sinks and sources in one: what is written is read again and must be the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph
from ..session import cut, work_dir
from ..sources import files, mail
from .matching import EDGES, edges, view
from .reports import TR, distinct_trans, load


def place(spark) -> str:
    return f"{work_dir(spark)}/export-{uuid.uuid4().hex}"


@query("csv_export", "SELECT id, status, replace(coalesce(doc_number, ''), '\"', '') AS number, entity_tag FROM documentos WHERE status = 'ERROR'")
def csv_export(spark, d):
    """Rows in error as CSV with semicolons, read back."""
    rows = load(spark, d, "documentos").select("id", "status", F.replace(F.coalesce("doc_number", F.lit("")), F.lit('"'), F.lit("")).alias("number"), "entity_tag")
    path = place(spark)
    files.write_csv(rows, path, ";", "status = 'ERROR'")
    return spark.read.option("header", True).option("sep", ";").schema("id bigint, status string, number string, entity_tag string").csv(path).withColumn("number", F.coalesce("number", F.lit("")))


@query("json_export", f"SELECT id, doc_id, amount_cents, supplier_clean FROM {TR}")
def json_export(spark, d):
    """Transactions as JSON lines, read back."""
    path = place(spark)
    files.write_json(distinct_trans(spark, d).select("id", "doc_id", "amount_cents", "supplier_clean"), path)
    return spark.read.schema("id bigint, doc_id bigint, amount_cents bigint, supplier_clean string").json(path)


@query("table_swap", "SELECT id, CASE WHEN status = 'ERROR' THEN 'PENDING' ELSE status END AS status FROM documentos")
def table_swap(spark, d):
    """A table written, replaced by its successor and read."""
    docs, path = load(spark, d, "documentos").select("id", "status"), place(spark)
    files.replace_table(docs, path)
    files.replace_table(docs.withColumn("status", F.when(F.col("status") == "ERROR", "PENDING").otherwise(F.col("status"))), path)
    return spark.read.parquet(path)


@query("safe_names", "SELECT id, regexp_replace(regexp_extract(original_path, '([^/]*)$', 1), '[^\\p{L}\\p{N}_.\\-]', '_', 'g') AS name FROM documentos")
def safe_names(spark, d):
    return load(spark, d, "documentos").select("id", files.safe_name(F.regexp_extract("original_path", "([^/]*)$", 1)).alias("name"))


@query("new_attachments", "SELECT id, file_hash AS md5_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS k FROM documentos WHERE lote_id >= 3 AND file_hash IS NOT NULL) WHERE k = 1 AND file_hash NOT IN (SELECT file_hash FROM documentos WHERE lote_id < 3 AND file_hash IS NOT NULL)")
def new_attachments(spark, d):
    """Attachments of later batches whose content is not known from earlier ones."""
    docs = load(spark, d, "documentos").select("id", "lote_id", "file_hash", "original_path")
    mails = docs.filter("lote_id >= 3 and file_hash is not null").select("id", F.array(F.struct(F.col("original_path").alias("filename"), F.col("file_hash").alias("md5_hash"))).alias("attachments"))
    return mail.new_attachments(mails, docs.filter("lote_id < 3")).select("id", "md5_hash")


@query("pending_mails", "SELECT id FROM documentos WHERE created_at::DATE >= DATE '2024-06-30' - 90 AND status <> 'RECONCILED'")
def pending_mails(spark, d):
    """Mails of the last ninety days that are not processed yet."""
    docs = load(spark, d, "documentos")
    m = docs.select("id", F.col("created_at").cast("date").alias("date"), F.array(F.struct(F.col("original_path").alias("filename"))).alias("attachments"), F.when(F.col("status") == "RECONCILED", F.array(F.lit("processed"))).otherwise(F.array(F.lit("new"))).alias("labels")).filter("labels is not null")
    return mail.pending_mails(m.join(docs.filter("status is not null").select("id"), "id", "left_semi"), F.lit("2024-06-30").cast("date"), 90).select("id")


@query("graph_pieces", f"""{EDGES}, ends AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), lab(v, l) USING KEY (v) AS (
  SELECT a, min(least(a, b)) FROM ends GROUP BY a
  UNION SELECT b.b AS v, min(s.l) AS l FROM lab s JOIN ends b ON b.a = s.v JOIN recurring.lab r ON r.v = b.b WHERE s.l < r.l GROUP BY b.b)
SELECT lab.l AS component, 0 AS piece, count(*) AS nodes, (SELECT count(*) FROM g JOIN lab m ON m.v = g.src WHERE m.l = lab.l) AS links FROM lab GROUP BY lab.l""")
def graph_pieces(spark, d):
    """Components as JSON in bounded pieces, read back and counted."""
    e = cut(graph.best_edges(edges(spark, d)))
    lab = cut(graph.components(e))
    v = lab.join(view(spark, d).select("id", F.col("k").alias("kind")), "id")
    links = e.join(lab.withColumnRenamed("id", "src"), "src")
    g = F.from_json("graph", "nodes array<struct<id: bigint>>, links array<struct<src: bigint>>")
    return files.graph_json(v, links, "component").select("component", "piece", g.alias("g")).select("component", "piece", F.size("g.nodes").cast("bigint").alias("nodes"), F.coalesce(F.size("g.links"), F.lit(0)).cast("bigint").alias("links"))
