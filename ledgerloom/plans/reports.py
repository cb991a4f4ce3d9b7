"""Relational reports over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import dates
from ..operators import tables as T
from ..session import read_table

OPEN = "status NOT IN ('ARCHIVED', 'ERROR')"


def load(spark, d, *names):
    out = [read_table(spark, d, n) for n in names]
    return out if len(out) > 1 else out[0]


def distinct_trans(spark, d, cond=None):
    """Transactions that meet ``cond``, repeated deliveries dropped.

    Repeated rows are alike, so the condition comes first: it reaches the scan, and
    only what is left is shuffled by id.
    """
    t = load(spark, d, "transacoes")
    return (t if cond is None else t.filter(cond)).dropDuplicates(["id"])


TR = "(SELECT DISTINCT * FROM transacoes)"


@query("status_counts", "SELECT status, count(*) AS n FROM documentos GROUP BY status")
def status_counts(spark, d):
    return load(spark, d, "documentos").groupBy("status").agg(F.count("*").alias("n"))


@query("dashboard_counts", "SELECT count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RECONCILED') AS reconciled, count(*) FILTER (doc_type = 'BOLETO') AS slips, count(*) FILTER (raw_text IS NULL) AS unread FROM documentos")
def dashboard_counts(spark, d):
    return load(spark, d, "documentos").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "RECONCILED").alias("reconciled"), F.count_if(F.col("doc_type") == "BOLETO").alias("slips"), F.count_if(F.col("raw_text").isNull()).alias("unread"))


@query("statistics_row", f"SELECT (SELECT count(*) FROM documentos) AS documents, (SELECT count(*) FROM {TR}) AS transactions, (SELECT count(*) FROM (SELECT DISTINCT * FROM duplicatas)) AS installments, (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM matches WHERE status = 'CONFIRMED') AS confirmed")
def statistics_row(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    m = load(spark, d, "matches")
    out = n(load(spark, d, "documentos"), "documents")
    for x in (n(distinct_trans(spark, d), "transactions"), n(load(spark, d, "duplicatas").dropDuplicates(["id"]), "installments"), m.agg(F.count("*").alias("matches"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"))):
        out = out.crossJoin(x)  # one row each
    return out


@query("open_documents", f"SELECT d.id, d.doc_type, d.entity_tag, d.status, t.id AS transaction_id, t.supplier_clean, t.amount_cents, t.due_date FROM documentos d LEFT JOIN {TR} t ON t.doc_id = d.id WHERE d.{OPEN}")
def open_documents(spark, d):
    t = distinct_trans(spark, d).select(F.col("id").alias("transaction_id"), F.col("doc_id").alias("id"), "supplier_clean", "amount_cents", "due_date")
    return load(spark, d, "documentos").filter(OPEN).select("id", "doc_type", "entity_tag", "status").join(t, "id", "left").select("id", "doc_type", "entity_tag", "status", "transaction_id", "supplier_clean", "amount_cents", "due_date")


@query("lifecycle_filter", f"SELECT d.id, d.status, d.created_at, t.amount_cents FROM documentos d LEFT JOIN {TR} t ON t.doc_id = d.id WHERE d.status IN ('PARSED', 'PENDING', 'MATCHED') ORDER BY d.created_at DESC, d.id")
def lifecycle_filter(spark, d):
    t = distinct_trans(spark, d).select(F.col("doc_id").alias("id"), "amount_cents")
    return load(spark, d, "documentos").filter(F.col("status").isin("PARSED", "PENDING", "MATCHED")).select("id", "status", "created_at").join(t, "id", "left").orderBy(F.desc("created_at"), "id")


def filtered(df, **values):
    """Conjunction of the values that are given."""
    for k, v in values.items():
        if v:
            df = df.filter(F.col(k) == v)
    return df


@query("filtered_list", "SELECT id, entity_tag, doc_type, status, doc_number FROM documentos WHERE entity_tag = 'T1' AND doc_type = 'BOLETO' ORDER BY id DESC")
def filtered_list(spark, d):
    return filtered(load(spark, d, "documentos"), entity_tag="T1", doc_type="BOLETO", status=None).select("id", "entity_tag", "doc_type", "status", "doc_number").orderBy(F.desc("id"))


@query("document_details", f"SELECT d.id, d.doc_type, d.status, d.doc_number, d.access_key, t.supplier_clean, t.amount_cents, t.emission_date, t.due_date, t.payment_date, t.bank_code, t.sisbb_auth FROM documentos d LEFT JOIN {TR} t ON t.doc_id = d.id WHERE d.doc_number IS NOT NULL")
def document_details(spark, d):
    t = distinct_trans(spark, d).select(F.col("doc_id").alias("id"), "supplier_clean", "amount_cents", "emission_date", "due_date", "payment_date", "bank_code", "sisbb_auth")
    return load(spark, d, "documentos").filter("doc_number is not null").select("id", "doc_type", "status", "doc_number", "access_key").join(t, "id", "left")


@query("quick_search", f"SELECT t.id, t.supplier_clean FROM {TR} t WHERE contains(lower(concat_ws(' ', t.id, t.supplier_clean, t.amount_cents, t.due_date)), 'tratores')")
def quick_search(spark, d):
    row = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "supplier_clean", F.col("amount_cents").cast("string"), "due_date"))
    return distinct_trans(spark, d).filter(F.contains(row, F.lit("tratores"))).select("id", "supplier_clean")


@query("orphans", f"SELECT t.id, t.doc_id, t.amount_cents FROM {TR} t JOIN documentos d ON d.id = t.doc_id WHERE (t.link_id IS NULL OR t.link_id = 0) AND d.{OPEN}")
def orphans(spark, d):
    docs = load(spark, d, "documentos").filter(OPEN).select(F.col("id").alias("doc_id"))
    return distinct_trans(spark, d, "link_id is null or link_id = 0").join(docs, "doc_id", "left_semi").select("id", "doc_id", "amount_cents")


@query("unreconciled_slips", f"SELECT t.id, t.supplier_clean, t.amount_cents FROM {TR} t JOIN documentos d ON d.id = t.doc_id WHERE d.doc_type = 'BOLETO' AND d.status <> 'RECONCILED' AND coalesce(t.is_scheduled, 0) = 0 ORDER BY t.amount_cents DESC, t.id")
def unreconciled_slips(spark, d):
    docs = load(spark, d, "documentos").filter("doc_type = 'BOLETO' and status <> 'RECONCILED'").select(F.col("id").alias("doc_id"))
    return distinct_trans(spark, d, "coalesce(is_scheduled, 0) = 0").join(docs, "doc_id").select("id", "supplier_clean", "amount_cents").orderBy(F.desc("amount_cents"), "id")


@query("open_by_supplier", f"SELECT t.supplier_clean, count(*) AS n, sum(t.amount_cents)::BIGINT AS cents FROM {TR} t JOIN documentos d ON d.id = t.doc_id WHERE d.{OPEN} AND t.supplier_clean IS NOT NULL GROUP BY 1")
def open_by_supplier(spark, d):
    docs = load(spark, d, "documentos").filter(OPEN).select(F.col("id").alias("doc_id"))
    return distinct_trans(spark, d, "supplier_clean is not null").join(docs, "doc_id").groupBy("supplier_clean").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query("installments_of_invoice", "SELECT nfe_id, seq_num, amount_cents, count(*) OVER (PARTITION BY nfe_id) AS parts, concat('PARC_', seq_num, '-', count(*) OVER (PARTITION BY nfe_id)) AS label FROM (SELECT DISTINCT * FROM duplicatas) ORDER BY nfe_id, seq_num")
def installments_of_invoice(spark, d):
    n = F.count("*").over(Window.partitionBy("nfe_id"))
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).withColumn("parts", n)
    return u.select("nfe_id", "seq_num", "amount_cents", "parts", F.concat(F.lit("PARC_"), F.col("seq_num"), F.lit("-"), F.col("parts")).alias("label")).orderBy("nfe_id", "seq_num")


@query("installment_counts", "SELECT nfe_id, count(*) AS n, sum(amount_cents)::BIGINT AS cents FROM (SELECT DISTINCT * FROM duplicatas) GROUP BY nfe_id")
def installment_counts(spark, d):
    return load(spark, d, "duplicatas").dropDuplicates(["id"]).groupBy("nfe_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


@query("supplier_distinct", "SELECT DISTINCT supplier_clean FROM transacoes WHERE supplier_clean IS NOT NULL")
def supplier_distinct(spark, d):
    return load(spark, d, "transacoes").filter("supplier_clean is not null").select("supplier_clean").distinct()


@query("next_link_id", "SELECT coalesce(max(link_id), 0) + 1 AS next_id FROM transacoes")
def next_link_id(spark, d):
    return load(spark, d, "transacoes").agg((F.coalesce(F.max("link_id"), F.lit(0)) + 1).alias("next_id"))


@query("matches_for_documents", "SELECT m.id, m.parent_doc_id, m.child_doc_id, p.doc_type AS parent_type, c.doc_type AS child_type FROM matches m JOIN documentos p ON p.id = m.parent_doc_id JOIN documentos c ON c.id = m.child_doc_id WHERE p.doc_type = 'NFE' OR c.doc_type = 'NFE'")
def matches_for_documents(spark, d):
    docs = load(spark, d, "documentos")
    p, c = docs.select(F.col("id").alias("parent_doc_id"), F.col("doc_type").alias("parent_type")), docs.select(F.col("id").alias("child_doc_id"), F.col("doc_type").alias("child_type"))
    return load(spark, d, "matches").select("id", "parent_doc_id", "child_doc_id").join(p, "parent_doc_id").join(c, "child_doc_id").filter("parent_type = 'NFE' or child_type = 'NFE'").select("id", "parent_doc_id", "child_doc_id", "parent_type", "child_type")


@query("latest_per_document", f"SELECT doc_id, id, amount_cents FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM {TR}) WHERE k = 1")
def latest_per_document(spark, d):
    return T.latest(distinct_trans(spark, d), ["doc_id"], F.desc_nulls_last("created_at"), F.desc("id")).select("doc_id", "id", "amount_cents")


@query("top_history", f"SELECT id, doc_id, created_at FROM {TR} ORDER BY created_at DESC NULLS LAST, id LIMIT 100")
def top_history(spark, d):
    return distinct_trans(spark, d).select("id", "doc_id", "created_at").orderBy(F.desc_nulls_last("created_at"), "id").limit(100)


def _day(c: str) -> str:
    """SQL of a typed date."""
    from .scalars import _iso

    return _iso(c)


GROUPS = f"""
SELECT link_id,
       bool_or(doc_type IN ('NFE', 'NFSE')) AS has_invoice, bool_or(doc_type = 'BOLETO') AS has_slip, bool_or(doc_type = 'COMPROVANTE') AS has_receipt,
       count(*) AS members,
       arg_min(day, (prio, id)) FILTER (day IS NOT NULL) AS master_date,
       arg_max(supplier_clean, id) FILTER (supplier_clean IS NOT NULL) AS supplier,
       arg_max(amount_cents, id) FILTER (amount_cents > 0) AS amount_cents,
       CASE WHEN has_invoice AND has_slip AND has_receipt THEN 'RECONCILED' WHEN (has_invoice OR has_slip) AND NOT has_receipt THEN 'MATCHED' ELSE 'PENDING' END AS state
FROM (
  SELECT t.link_id, t.id, t.supplier_clean, d.doc_type,
         CASE d.doc_type WHEN 'COMPROVANTE' THEN t.payment_date WHEN 'BOLETO' THEN t.due_date ELSE coalesce(t.emission_date, t.due_date) END AS day, t.amount_cents,
         CASE d.doc_type WHEN 'COMPROVANTE' THEN 1 WHEN 'BOLETO' THEN 2 ELSE CASE WHEN t.emission_date IS NOT NULL THEN 3 ELSE 4 END END AS prio
  FROM (SELECT id, doc_id, link_id, supplier_clean, amount_cents, {_day('payment_date')} AS payment_date, {_day('due_date')} AS due_date, {_day('emission_date')} AS emission_date FROM {TR}) t JOIN documentos d ON d.id = t.doc_id WHERE t.link_id IS NOT NULL AND d.doc_type IN ('NFE', 'NFSE', 'BOLETO', 'COMPROVANTE'))
GROUP BY link_id"""


@query("group_summary", GROUPS)
def group_summary(spark, d):
    """Composition, master date by priority and last supplier of every link group, in one shuffle."""
    docs = load(spark, d, "documentos").filter(F.col("doc_type").isin("NFE", "NFSE", "BOLETO", "COMPROVANTE")).select(F.col("id").alias("doc_id"), "doc_type")
    t = distinct_trans(spark, d, "link_id is not null").select("id", "doc_id", "link_id", "supplier_clean", "amount_cents", "emission_date", "due_date", "payment_date")
    kind = F.col("doc_type")
    day = F.when(kind == "COMPROVANTE", F.col("payment_date")).when(kind == "BOLETO", F.col("due_date")).otherwise(F.coalesce("emission_date", "due_date"))
    prio = F.when(kind == "COMPROVANTE", 1).when(kind == "BOLETO", 2).when(F.col("emission_date").isNotNull(), 3).otherwise(4)
    t = t.withColumns({c: dates.parse_date(F.col(c)) for c in ("emission_date", "due_date", "payment_date")})
    j = t.join(docs, "doc_id").withColumn("day", day).withColumn("prio", prio)
    g = j.groupBy("link_id").agg(
        F.bool_or(kind.isin("NFE", "NFSE")).alias("has_invoice"), F.bool_or(kind == "BOLETO").alias("has_slip"), F.bool_or(kind == "COMPROVANTE").alias("has_receipt"), F.count("*").alias("members"),
        F.min_by("day", F.when(F.col("day").isNotNull(), F.struct("prio", "id"))).alias("master_date"), F.max_by("supplier_clean", F.when(F.col("supplier_clean").isNotNull(), F.col("id"))).alias("supplier"),
        F.max_by("amount_cents", F.when(F.col("amount_cents") > 0, F.col("id"))).alias("amount_cents"),
    )
    n, b, r = F.col("has_invoice"), F.col("has_slip"), F.col("has_receipt")
    return g.withColumn("state", F.when(n & b & r, "RECONCILED").when((n | b) & ~r, "MATCHED").otherwise("PENDING"))


@query("dedup_ingest", "SELECT id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS k FROM documentos WHERE lote_id >= 3) WHERE k = 1 AND file_hash NOT IN (SELECT file_hash FROM documentos WHERE lote_id < 3 AND file_hash IS NOT NULL)")
def dedup_ingest(spark, d):
    docs = load(spark, d, "documentos")
    return T.ingest_new(docs.filter("lote_id >= 3"), docs.filter("lote_id < 3"), "file_hash", "id").filter("file_hash is not null").select("id", "file_hash")


@query("upsert_fields", f"""
WITH o AS (SELECT doc_id AS id, arg_min(amount_cents, id) AS amount_cents, arg_min(due_date, id) FILTER (due_date IS NOT NULL) AS due_date FROM {TR} GROUP BY doc_id),
     n AS (SELECT boleto_id AS id, arg_min(amount_cents, id) AS amount_cents, arg_min(due_date, id) AS due_date FROM (SELECT DISTINCT * FROM duplicatas) WHERE boleto_id IS NOT NULL GROUP BY boleto_id)
SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.amount_cents, 0), o.amount_cents) AS amount_cents, coalesce(n.due_date, o.due_date) AS due_date FROM o FULL JOIN n ON n.id = o.id""")
def upsert_fields(spark, d):
    """Fields of every document, from its first transaction, overwritten by the installment that names it."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    old = distinct_trans(spark, d).withColumn("k", F.col("doc_id")).groupBy("k").agg(first("amount_cents"), first("due_date")).withColumnRenamed("k", "id")
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).filter("boleto_id is not null")
    new = u.groupBy("boleto_id").agg(first("amount_cents"), first("due_date")).withColumnRenamed("boleto_id", "id")
    return T.upsert(old, new, "id", ["amount_cents"], ["due_date"])


@query("bulk_edit", "SELECT id, CASE WHEN id IN (SELECT boleto_id FROM duplicatas) THEN 'T9' ELSE entity_tag END AS entity_tag, status FROM documentos")
def bulk_edit(spark, d):
    ids = load(spark, d, "duplicatas").select(F.col("boleto_id").alias("id"))
    return T.bulk_edit(load(spark, d, "documentos").select("id", "entity_tag", "status"), ids, "id", {"entity_tag": "T9", "status": " "})


@query("cascade_delete", """
WITH x AS (SELECT id FROM documentos WHERE status = 'ERROR')
SELECT 'documentos' AS tbl, count(*) AS n FROM documentos WHERE id NOT IN (FROM x)
UNION ALL SELECT 'transacoes', count(*) FROM transacoes WHERE doc_id NOT IN (FROM x) OR doc_id IS NULL
UNION ALL SELECT 'duplicatas', count(*) FROM duplicatas WHERE (nfe_id NOT IN (FROM x) OR nfe_id IS NULL) AND (boleto_id NOT IN (FROM x) OR boleto_id IS NULL)
UNION ALL SELECT 'matches', count(*) FROM matches WHERE (parent_doc_id NOT IN (FROM x) OR parent_doc_id IS NULL) AND (child_doc_id NOT IN (FROM x) OR child_doc_id IS NULL)""")
def cascade_delete(spark, d):
    docs = load(spark, d, "documentos")
    kept = T.cascade_delete(docs.filter("status = 'ERROR'"), "id", {"documentos": (docs, ["id"]), "transacoes": (load(spark, d, "transacoes"), ["doc_id"]), "duplicatas": (load(spark, d, "duplicatas"), ["nfe_id", "boleto_id"]), "matches": (load(spark, d, "matches"), ["parent_doc_id", "child_doc_id"])})
    out = None
    for name, t in kept.items():
        n = t.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("archive_group", f"SELECT d.id, CASE WHEN d.id IN (SELECT doc_id FROM {TR} WHERE link_id IS NOT NULL) THEN 'ARCHIVED' ELSE d.status END AS status FROM documentos d")
def archive_group(spark, d):
    ids = distinct_trans(spark, d, "link_id is not null").select(F.col("doc_id").alias("id"))
    return T.bulk_edit(load(spark, d, "documentos").select("id", "status"), ids, "id", {"status": "ARCHIVED"})


@query("confirm_match", "SELECT id, CASE WHEN confidence >= 0.9 AND confidence <= 1 THEN 'CONFIRMED' ELSE status END AS status FROM matches")
def confirm_match(spark, d):
    return load(spark, d, "matches").select("id", F.when(F.col("confidence").between(0.9, 1), "CONFIRMED").otherwise(F.col("status")).alias("status"))


@query("new_matches", "SELECT DISTINCT parent_doc_id, child_doc_id FROM matches a WHERE a.match_type = 'FUZZY' AND a.parent_doc_id IS NOT NULL AND a.child_doc_id IS NOT NULL AND NOT EXISTS (FROM matches b WHERE b.match_type = 'EXACT' AND b.parent_doc_id = a.parent_doc_id AND b.child_doc_id = a.child_doc_id)")
def new_matches(spark, d):
    m = load(spark, d, "matches").filter("parent_doc_id is not null and child_doc_id is not null")
    pair = ["parent_doc_id", "child_doc_id"]
    return m.filter("match_type = 'FUZZY'").select(pair).distinct().join(m.filter("match_type = 'EXACT'").select(pair), pair, "left_anti")


@query("corrections", f"""
SELECT t.id, field, old_value, new_value FROM (
  SELECT t.id, unnest(['supplier', 'due_date']) AS field, unnest([t.supplier_clean, t.due_date]) AS old_value, unnest([upper(trim(t.supplier_clean)), nullif(trim(t.due_date), '')]) AS new_value FROM {TR} t) t
WHERE old_value IS DISTINCT FROM new_value""")
def corrections(spark, d):
    """Difference of old and edited values in long form, one row a changed field."""
    t = distinct_trans(spark, d)
    pair = lambda n, a, b: F.struct(F.lit(n).alias("field"), a.alias("old_value"), b.alias("new_value"))
    both = F.array(pair("supplier", F.col("supplier_clean"), F.upper(F.trim("supplier_clean"))), pair("due_date", F.col("due_date"), F.nullif(F.trim("due_date"), F.lit(""))))
    return t.select("id", F.inline(both)).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


@query("segment_pages", """
WITH p AS (SELECT lote_id AS doc_id, id AS page_num, doc_type FROM documentos),
     f AS (SELECT *, CASE WHEN lag(doc_type) OVER w IS NULL OR (lag(doc_type) OVER w <> doc_type AND lag(doc_type) OVER w <> 'UNKNOWN' AND doc_type <> 'UNKNOWN') THEN 1 ELSE 0 END AS s FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
     g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY page_num) AS segment FROM f)
SELECT doc_id, page_num, segment::BIGINT AS segment, first(doc_type) OVER (PARTITION BY doc_id, segment ORDER BY page_num) AS segment_kind FROM g""")
def segment_pages(spark, d):
    """Documents of a batch read as pages of one scan."""
    p = load(spark, d, "documentos").select(F.col("lote_id").alias("doc_id"), F.col("id").alias("page_num"), "doc_type")
    return T.segments(p, "doc_id", "page_num", "doc_type").select("doc_id", "page_num", F.col("segment").cast("bigint"), "segment_kind")


@query("rename_plan", f"""
WITH n AS (SELECT t.id, concat(concat_ws('_', coalesce(replace(substr(t.due_date, 1, 10), '-', '.'), 'SEM DATA'), d.entity_tag, trim(substr(regexp_replace(t.supplier_clean, '[<>:"/\\\\|?*]', '', 'g'), 1, 30)), d.doc_type), '.pdf') AS target FROM {TR} t JOIN documentos d ON d.id = t.doc_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) - 1 AS c FROM n)
SELECT id, target, CASE WHEN c = 0 THEN target ELSE concat(substr(target, 1, length(target) - 4), ' (', c, ').pdf') END AS final_name FROM k""")
def rename_plan(spark, d):
    """Target names with a counter where they collide."""
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), "entity_tag", "doc_type")
    t = distinct_trans(spark, d).join(docs, "doc_id")
    day = F.coalesce(F.replace(F.substring("due_date", 1, 10), F.lit("-"), F.lit(".")), F.lit("SEM DATA"))
    supplier = F.trim(F.substring(F.regexp_replace("supplier_clean", r'[<>:"/\\|?*]', ""), 1, 30))
    n = t.select("id", F.concat(F.concat_ws("_", day, "entity_tag", supplier, "doc_type"), F.lit(".pdf")).alias("target"))
    return T.collision_names(n, "target", "id", "final_name")


@query("accuracy_by_type", """
SELECT ground_truth.doc_type AS doc_type, count(*) AS n, round(avg(extraction_confidence), 6) AS confidence,
       round(100.0 * count(*) FILTER (contains(file, ground_truth.numero_documento)) / count(*), 4) AS number_pct
FROM golden_dataset GROUP BY 1""")
def accuracy_by_type(spark, d):
    g = load(spark, d, "golden_dataset")
    hit = F.count_if(F.contains("file", F.col("ground_truth.numero_documento")))
    return g.groupBy(F.col("ground_truth.doc_type").alias("doc_type")).agg(F.count("*").alias("n"), F.round(F.avg("extraction_confidence"), 6).alias("confidence"), F.round(100.0 * hit / F.count("*"), 4).alias("number_pct"))


@query("confusion_matrix", """
WITH x AS (SELECT meta.is_verified AS truth, extraction_confidence >= 0.8 AS said FROM golden_dataset WHERE extraction_confidence IS NOT NULL AND meta.is_verified IS NOT NULL),
     c AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / greatest(1, tp + fp), 6) AS prec, round(tp / greatest(1, tp + fn), 6) AS recall FROM c""")
def confusion_matrix(spark, d):
    g = load(spark, d, "golden_dataset").select(F.col("meta.is_verified").alias("truth"), (F.col("extraction_confidence") >= 0.8).alias("said")).filter("truth is not null and said is not null")
    c = g.agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth") & F.col("said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("said")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("said")).alias("tn"))
    ratio = lambda b: F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col(b)), 6)
    return c.select("tp", "fp", "fn", "tn", ratio("fp").alias("prec"), ratio("fn").alias("recall"))


@query("error_category", """
WITH u AS (SELECT *, sum(amount_cents) OVER (PARTITION BY nfe_id) AS total FROM (SELECT DISTINCT * FROM duplicatas)),
x AS (SELECT t.id, u.amount_cents AS truth, u.total, coalesce(t.amount_cents, 0) AS got FROM u JOIN (SELECT DISTINCT * FROM transacoes) t ON t.doc_id = u.boleto_id),
y AS (SELECT *, CASE WHEN got = 0 THEN 'EXTRACAO_VAZIA' WHEN abs(got - truth) <= greatest(floor(truth * 0.01), 10) THEN 'OK' WHEN abs(got - total) <= greatest(floor(total * 0.01), 10) THEN 'TOTAL_VS_PARCELA' WHEN got BETWEEN truth * 1.9 AND truth * 2.1 THEN 'DOBRO_DO_VALOR' WHEN got BETWEEN truth * 0.48 AND truth * 0.52 THEN 'METADE_DO_VALOR' WHEN got > truth * 3 THEN 'VALOR_MUITO_MAIOR' WHEN got * 3 < truth THEN 'VALOR_MUITO_MENOR' WHEN abs(got - truth) * 100 <= truth * 20 THEN 'DIFERENCA_PEQUENA' ELSE 'DIFERENCA_GRANDE' END AS category FROM x)
SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM y GROUP BY category""")
def error_category(spark, d):
    """Errors of slip amounts against the installments that name them: nothing read, right, the invoice's total, double, half, far more or less, near, other; with shares of all."""
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).withColumn("total", F.sum("amount_cents").over(Window.partitionBy("nfe_id"))).filter("boleto_id is not null").select(F.col("boleto_id").alias("doc_id"), F.col("amount_cents").alias("truth"), "total")
    x = distinct_trans(spark, d).select("doc_id", F.coalesce("amount_cents", F.lit(0)).alias("got")).join(u, "doc_id")
    got, truth, total = F.col("got"), F.col("truth"), F.col("total")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.floor(b * 0.01), F.lit(10))
    cat = (
        F.when(got == 0, "EXTRACAO_VAZIA").when(near(got, truth), "OK").when(near(got, total), "TOTAL_VS_PARCELA")
        .when(got.between(truth * 1.9, truth * 2.1), "DOBRO_DO_VALOR").when(got.between(truth * 0.48, truth * 0.52), "METADE_DO_VALOR")
        .when(got > truth * 3, "VALOR_MUITO_MAIOR").when(got * 3 < truth, "VALOR_MUITO_MENOR")
        .when(F.abs(got - truth) * 100 <= truth * 20, "DIFERENCA_PEQUENA").otherwise("DIFERENCA_GRANDE")
    )
    n = x.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))
    return n.select("category", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


@query("mail_stats", "SELECT source, count(*) AS n, count(DISTINCT email_message_id) AS mails, count_if(email_subject IS NOT NULL) AS with_subject FROM documentos GROUP BY source")
def mail_stats(spark, d):
    return load(spark, d, "documentos").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("email_message_id").alias("mails"), F.count_if(F.col("email_subject").isNotNull()).alias("with_subject"))


@query("batch_statistics", "SELECT lote_id, count(*) AS found, count(*) FILTER (raw_text IS NOT NULL) AS processed, count(*) FILTER (status = 'ERROR') AS errors, min(id) AS first_id, max(id) AS last_id FROM documentos GROUP BY lote_id")
def batch_statistics(spark, d):
    return load(spark, d, "documentos").groupBy("lote_id").agg(F.count("*").alias("found"), F.count("raw_text").alias("processed"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
