"""Which source a field of a document is taken from, and how sure the whole is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import ORACLES, query
from ..functions import dates, filenames, ids, money
from ..functions import text as X
from . import fields, scalars  # noqa: F401  their SQL is used here
from .reports import TR, distinct_trans, load

_N = filenames.sql("file")


@query("file_names", f"SELECT file, {_N['date']} AS day, {_N['supplier']} AS supplier, {_N['amount']} AS amount_cents, {_N['number']} AS number FROM golden_dataset")
def file_names(spark, d):
    """Day, supplier, amount and number that file names carry."""
    f = F.col("file")
    return load(spark, d, "golden_dataset").select("file", filenames.file_date(f).alias("day"), filenames.file_supplier(f).alias("supplier"), filenames.file_amount(f).alias("amount_cents"), filenames.file_number(f).alias("number"))


@query("name_accuracy", f"""
WITH x AS (SELECT ground_truth.doc_type AS doc_type, ground_truth.valor_centavos AS v, ground_truth.numero_documento AS n, upper(trim(ground_truth.fornecedor)) AS s, {_N['amount']} AS got, {_N['number']} AS num, upper(trim({_N['supplier']})) AS sup FROM golden_dataset)
SELECT doc_type, count(*) AS n, round(100.0 * count(*) FILTER (abs(got - v) <= greatest(floor(v * 0.01), 10)) / count(*), 4) AS amount_pct, round(100.0 * count(*) FILTER (contains(num, n) OR contains(n, num)) / count(*), 4) AS number_pct, round(100.0 * count(*) FILTER (contains(sup, s) OR contains(s, sup)) / count(*), 4) AS supplier_pct FROM x GROUP BY 1""")
def name_accuracy(spark, d):
    """Share of file names whose amount, number and supplier agree with the ground truth, by kind."""
    f, g = F.col("file"), "ground_truth."
    x = load(spark, d, "golden_dataset").select(F.col(g + "doc_type").alias("doc_type"), F.col(g + "valor_centavos").alias("v"), F.col(g + "numero_documento").alias("no"), F.upper(F.trim(g + "fornecedor")).alias("s"), filenames.file_amount(f).alias("got"), filenames.file_number(f).alias("num"), F.upper(F.trim(filenames.file_supplier(f))).alias("sup"))
    pct = lambda c, name: F.round(100.0 * F.count_if(c) / F.count("*"), 4).alias(name)
    either = lambda a, b: F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    return x.groupBy("doc_type").agg(F.count("*").alias("n"), pct(F.abs(F.col("got") - F.col("v")) <= F.greatest(F.floor(F.col("v") * 0.01), F.lit(10)), "amount_pct"), pct(either("num", "no"), "number_pct"), pct(either("sup", "s"), "supplier_pct"))


def ranked(name: str, *sources: tuple[str, Column]) -> list[Column]:
    """The first value that is not null, as ``name``, and where it comes from, as ``name_source``."""
    source = F.lit(None).cast("string")
    for label, value in reversed(sources):
        source = F.when(value.isNotNull(), label).otherwise(source)
    return [F.coalesce(*[v for _, v in sources]).alias(name), source.alias(f"{name}_source")]


_P = filenames.sql("d.original_path")
_KEY = "regexp_replace(d.access_key, '[^0-9]', '', 'g')"


@query("field_precedence", f"""
WITH n AS ({ORACLES['doc_number']}), a AS ({ORACLES['amount_ranked']}), t AS ({ORACLES['dates_extract']}),
x AS (SELECT d.id, {_P['number']} AS n1, CASE WHEN d.doc_type IN ('NFE', 'NFSE') AND length({_KEY}) = 44 THEN substr({_KEY}, 26, 9)::BIGINT::VARCHAR END AS n2, n.number AS n3,
  CASE WHEN d.doc_type = 'BOLETO' THEN t.due END AS d1, {_P['date']} AS d2, t.due AS d3, nullif({_P['amount']}, 0) AS a1, nullif(a.cents, 0) AS a2
  FROM documentos d LEFT JOIN n ON n.id = d.id LEFT JOIN a ON a.id = d.id LEFT JOIN t ON t.id = d.id)
SELECT id, coalesce(n1, n2, n3) AS number, CASE WHEN n1 IS NOT NULL THEN 'filename' WHEN n2 IS NOT NULL THEN 'access_key' WHEN n3 IS NOT NULL THEN 'text' END AS number_source,
  coalesce(d1, d2, d3) AS due, CASE WHEN d1 IS NOT NULL THEN 'anchor' WHEN d2 IS NOT NULL THEN 'filename' WHEN d3 IS NOT NULL THEN 'text' END AS due_source,
  coalesce(a1, a2) AS amount, CASE WHEN a1 IS NOT NULL THEN 'filename' WHEN a2 IS NOT NULL THEN 'text' END AS amount_source FROM x""")
def field_precedence(spark, d):
    """Number: file name, access key, text; due date: label of a slip, file name, text; amount: file name, text.

    One narrow pass over the documents: every source is a column and the first that says something wins.
    """
    docs = load(spark, d, "documentos").select("id", "doc_type", "raw_text", "original_path", "access_key")
    path, kind = F.col("original_path"), F.col("doc_type")
    key = ids.digits_only(F.col("access_key"))
    from_key = F.when(kind.isin("NFE", "NFSE") & (F.length(key) == 44), F.substring(key, 26, 9).cast("bigint").cast("string"))
    due = X.labelled_dates(F.col("raw_text"))[0]
    text_number, text_amount = X.document_number(F.col("raw_text"), kind)[0], money.ranked_amount(F.col("raw_text"))[0]
    return docs.select(
        "id",
        *ranked("number", ("filename", filenames.file_number(path)), ("access_key", from_key), ("text", text_number)),
        *ranked("due", ("anchor", F.when(kind == "BOLETO", due)), ("filename", filenames.file_date(path)), ("text", due)),
        *ranked("amount", ("filename", F.nullif(filenames.file_amount(path), F.lit(0))), ("text", F.nullif(text_amount, F.lit(0)))),
    )


# Weights of the sources of a reading.
WEIGHTS = {"regex_validated": 10.0, "native_text": 5.0, "barcode": 4.0, "gemini": 3.5, "paddle_ocr": 2.0, "surya": 1.8, "florence2": 1.5, "extract_hybrid": 1.5, "regex_specific": 1.2, "gliner": 1.0, "filename": 0.9, "regex_fallback": 0.8, "tesseract": 0.7, "qwen2_vlm": 0.5}
TAX = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"


def number_score(c: Column) -> Column:
    """Share of figures, separators, currency signs and blanks; 0.2 less with characters beyond ASCII; 0 for nothing."""
    n = F.length(F.regexp_replace(c, r"[^0-9,.R$ ]", "")) / F.length(c)
    return F.when(F.length(c) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), n - F.when(c.rlike(r"[^\x00-\x7F]"), 0.2).otherwise(0.0)))).otherwise(0.0)


def date_form_score(c: Column) -> Column:
    """1 for a day, month and year, 0.5 for any figure, else 0."""
    return F.when(c.rlike(r"[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}"), 1.0).when(c.rlike("[0-9]"), 0.5).otherwise(0.0)


def tax_form_score(c: Column) -> Column:
    """1 for a written company number, 0.8 for its 14 figures, 0.3 for any other text, 0 for nothing."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).when(c.rlike(TAX), 1.0).when(F.length(ids.digits_only(c)) == 14, 0.8).otherwise(0.3)


@query("field_scores", f"""SELECT id, round(CASE WHEN length(coalesce(due_date, '')) > 0 THEN greatest(0.0, least(1.0, length(regexp_replace(due_date, '[^0-9,.R$ ]', '', 'g')) / length(due_date) - CASE WHEN regexp_matches(due_date, '[^\\x00-\\x7F]') THEN 0.2 ELSE 0 END)) ELSE 0 END, 6)::DOUBLE AS number_score,
CASE WHEN regexp_matches(coalesce(due_date, ''), '[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}}') THEN 1.0 WHEN regexp_matches(coalesce(due_date, ''), '[0-9]') THEN 0.5 ELSE 0 END::DOUBLE AS date_score,
CASE WHEN coalesce(sisbb_auth, '') = '' THEN 0 WHEN regexp_matches(sisbb_auth, '{TAX}') THEN 1 WHEN length(regexp_replace(sisbb_auth, '[^0-9]', '', 'g')) = 14 THEN 0.8 ELSE 0.3 END::DOUBLE AS tax_score FROM {TR}""")
def field_scores(spark, d):
    """How well readings have the form of a number, a date and a company number."""
    t = distinct_trans(spark, d)
    return t.select("id", F.round(number_score(F.col("due_date")), 6).alias("number_score"), date_form_score(F.col("due_date")).alias("date_score"), tax_form_score(F.col("sisbb_auth")).alias("tax_score"))


def choose(cands, keys: list[str]):
    """One reading of each key, in one aggregate: a valid check figure vetoes all others (0.99, regex_validated), else sure native text, else the largest weight times confidence; ties go to the first by ``ord``.

    ``cands`` has value, source, confidence, valid and ord.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("source")), F.lit(1.0))
    tier = F.when(F.col("valid"), 0).when((F.col("source") == "native_text") & (F.col("confidence") >= 0.8), 1).otherwise(2)
    best = F.min(F.struct(tier.alias("t"), F.when(tier == 2, -weight * F.col("confidence")).otherwise(0.0).alias("w"), "ord", "value", "source", "confidence")).alias("b")
    g = cands.filter(F.col("value").isNotNull() & (F.col("value") != "")).groupBy(*keys).agg(best, F.count("*").alias("readings"))
    sure = F.col("b.t") == 0
    return g.select(*keys, F.col("b.value").alias("value"), F.when(sure, "regex_validated").otherwise(F.col("b.source")).alias("source"), F.when(sure, 0.99).otherwise(F.col("b.confidence")).alias("confidence"), "readings")


@query("chosen_number", f"""
WITH n AS ({ORACLES['doc_number']}), k AS ({ORACLES['key_check']}),
c AS (SELECT d.id, n.number AS value, 'regex_specific' AS source, 0.9 AS confidence, false AS valid, 1 AS ord FROM documentos d JOIN n ON n.id = d.id
  UNION ALL SELECT d.id, substr({_KEY}, 26, 9)::BIGINT::VARCHAR, 'barcode', 0.9, coalesce(k.ok, false), 2 FROM documentos d JOIN (SELECT id, valid AS ok FROM k) k ON k.id = d.id WHERE length({_KEY}) = 44
  UNION ALL SELECT d.id, {_P['number']}, 'filename', 0.99, false, 3 FROM documentos d
  UNION ALL SELECT d.id, nullif(regexp_extract(d.doc_number, '([0-9]+)', 1), ''), 'native_text', CASE WHEN d.doc_type = 'UNKNOWN' THEN 0.5 ELSE 0.85 END, false, 4 FROM documentos d),
w AS (SELECT *, CASE WHEN valid THEN 0 WHEN source = 'native_text' AND confidence >= 0.8 THEN 1 ELSE 2 END AS t, CASE source WHEN 'regex_specific' THEN 1.2 WHEN 'barcode' THEN 4 WHEN 'filename' THEN 0.9 ELSE 5 END * confidence AS s FROM c WHERE value <> '')
SELECT id, arg_min(value, (t, CASE WHEN t = 2 THEN -s ELSE 0 END, ord)) AS value, CASE WHEN min(t) = 0 THEN 'regex_validated' ELSE arg_min(source, (t, CASE WHEN t = 2 THEN -s ELSE 0 END, ord)) END AS source, CASE WHEN min(t) = 0 THEN 0.99 ELSE arg_min(confidence, (t, CASE WHEN t = 2 THEN -s ELSE 0 END, ord)) END::DOUBLE AS confidence, count(*) AS readings FROM w GROUP BY id""")
def chosen_number(spark, d):
    """The number of each document among its readings: text, access key (vetoes if its check figure holds), file name, typed column."""
    docs = load(spark, d, "documentos").select("id", "doc_type", "raw_text", "original_path", "access_key", "doc_number")
    key = ids.digits_only(F.col("access_key"))
    reading = lambda v, s, c, ok, o: F.struct(v.alias("value"), F.lit(s).alias("source"), c.alias("confidence"), ok.alias("valid"), F.lit(o).alias("ord"))
    no = F.lit(False)
    all_ = F.array(
        reading(X.document_number(F.col("raw_text"), F.col("doc_type"))[0], "regex_specific", F.lit(0.9), no, 1),
        reading(F.when(F.length(key) == 44, F.substring(key, 26, 9).cast("bigint").cast("string")), "barcode", F.lit(0.9), F.coalesce(ids.is_access_key(F.col("access_key")), no), 2),
        reading(filenames.file_number(F.col("original_path")), "filename", F.lit(0.99), no, 3),
        reading(F.nullif(F.regexp_extract("doc_number", "([0-9]+)", 1), F.lit("")), "native_text", F.when(F.col("doc_type") == "UNKNOWN", 0.5).otherwise(0.85), no, 4),
    )
    return choose(docs.select("id", F.inline(all_)), ["id"])


@query("completeness", f"SELECT id, least(1.0, round(0.7 * ((nullif(due_date, '') IS NOT NULL)::INT + (coalesce(amount_cents, 0) <> 0)::INT + (nullif(sisbb_auth, '') IS NOT NULL)::INT + (nullif(supplier_clean, '') IS NOT NULL)::INT) / 4 + 0.3 * ((nullif(emission_date, '') IS NOT NULL)::INT + (nullif(barcode, '') IS NOT NULL)::INT + (nullif(digitable_line, '') IS NOT NULL)::INT) / 3 + CASE WHEN nullif(barcode, '') IS NOT NULL THEN 0.1 ELSE 0 END, 6))::DOUBLE AS confidence FROM {TR}")
def completeness(spark, d):
    """Seven tenths for four required fields, three tenths for three others, a tenth more with a barcode; at most 1."""
    has = lambda c: F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), 1).otherwise(0)
    required = has("due_date") + F.when(F.coalesce("amount_cents", F.lit(0)) != 0, 1).otherwise(0) + has("sisbb_auth") + has("supplier_clean")
    other = has("emission_date") + has("barcode") + has("digitable_line")
    return distinct_trans(spark, d).select("id", F.least(F.lit(1.0), F.round(F.lit(0.7) * required / 4 + F.lit(0.3) * other / 3 + has("barcode") * 0.1, 6)).alias("confidence"))


@query("document_validity", f"""
WITH l AS ({ORACLES['line_check']}), g AS ({ORACLES['date_logic']}), k AS ({ORACLES['key_check']}), t AS (SELECT t.*, d.access_key FROM {TR} t LEFT JOIN documentos d ON d.id = t.doc_id),
x AS (SELECT t.id, CASE WHEN k.id IS NOT NULL THEN CASE WHEN k.valid THEN 1.0 ELSE -1.0 END END AS key_i, CASE WHEN l.id IS NOT NULL THEN CASE WHEN l.valid THEN 0.9 ELSE -1.0 END END AS line_i, CASE WHEN nullif(t.emission_date, '') IS NOT NULL OR nullif(t.due_date, '') IS NOT NULL THEN CASE WHEN coalesce(g.issues, '') = '' THEN 0.5 ELSE 0 END END AS date_i
 FROM t LEFT JOIN k ON k.id = t.doc_id LEFT JOIN (SELECT id, valid FROM l) l ON l.id = t.id LEFT JOIN (SELECT id, issues FROM g) g ON g.id = t.id)
SELECT id, coalesce(least(key_i, line_i, date_i), 0) > -0.5 AS valid, round(greatest(0.0, least(1.0, 0.5 + 0.1 * (coalesce(key_i, 0) + coalesce(line_i, 0) + coalesce(date_i, 0)))), 6)::DOUBLE AS confidence FROM x""")
def document_validity(spark, d):
    """Half sure, a tenth of what the checks of access key, slip line and dates add or take; invalid if a check figure fails."""
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), "access_key")
    t = distinct_trans(spark, d).join(docs, "doc_id", "left")
    e, u, p = (dates.parse_date(F.col(c)) for c in ("emission_date", "due_date", "payment_date"))
    issues = F.size(dates.date_issues(e, u, p, F.lit("2024-06-30").cast("date")))
    dated = F.nullif(F.col("emission_date"), F.lit("")).isNotNull() | F.nullif(F.col("due_date"), F.lit("")).isNotNull()
    key = F.when(F.length(ids.digits_only(F.col("access_key"))) == 44, F.when(ids.is_access_key(F.col("access_key")), 1.0).otherwise(-1.0))
    line = F.when(F.length("digitable_line") == 47, F.when(ids.is_slip_line(F.col("digitable_line")), 0.9).otherwise(-1.0))
    day = F.when(dated, F.when(issues == 0, 0.5).otherwise(0.0))
    x = t.select("id", key.alias("k"), line.alias("l"), day.alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.lit(0.5) + F.lit(0.1) * (zero("k") + zero("l") + zero("y"))
    return x.select("id", (F.coalesce(F.least("k", "l", "y"), F.lit(0.0)) > -0.5).alias("valid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6).alias("confidence"))


@query("stored_rows", f"""SELECT 'transaction' AS kind, id, coalesce(nullif(entidade_pagadora, ''), 'UNKNOWN') AS payer, amount_cents, 0 AS reconciled FROM {TR}
UNION ALL SELECT 'installment', id, NULL, amount_cents, coalesce(reconciled, 0) FROM (SELECT DISTINCT * FROM duplicatas)""")
def stored_rows(spark, d):
    """Transactions and installments as they are stored: an unknown payer is named so, an installment begins unreconciled."""
    t = distinct_trans(spark, d).select(F.lit("transaction").alias("kind"), "id", F.coalesce(F.nullif(F.col("entidade_pagadora"), F.lit("")), F.lit("UNKNOWN")).alias("payer"), "amount_cents", F.lit(0).alias("reconciled"))
    u = load(spark, d, "duplicatas").dropDuplicates(["id"])
    return t.unionByName(u.select(F.lit("installment").alias("kind"), "id", F.lit(None).cast("string").alias("payer"), "amount_cents", F.coalesce("reconciled", F.lit(0)).alias("reconciled")))


@query("work_lists", "SELECT id, status IN ('PARSED', 'RECONCILED', 'INGESTED') AS rename, status IN ('PENDING', 'IMPORTED') AS pending, doc_type IN ('NFE', 'NFSE') AND status <> 'RECONCILED' AS open_bill FROM documentos WHERE status IN ('PARSED', 'RECONCILED', 'INGESTED', 'PENDING', 'IMPORTED') OR doc_type IN ('NFE', 'NFSE') AND status <> 'RECONCILED'")
def work_lists(spark, d):
    """Documents to be renamed, to be read and to be reconciled, in one pass."""
    st, kind = F.col("status"), F.col("doc_type")
    rename, pending, bill = st.isin("PARSED", "RECONCILED", "INGESTED"), st.isin("PENDING", "IMPORTED"), kind.isin("NFE", "NFSE") & (st != "RECONCILED")
    return load(spark, d, "documentos").filter(st.isin("PARSED", "RECONCILED", "INGESTED", "PENDING", "IMPORTED") | bill).select("id", rename.alias("rename"), pending.alias("pending"), bill.alias("open_bill"))


@query("correction_texts", f"""
WITH c AS (SELECT id, doc_id, supplier_clean AS old_value, upper(trim(supplier_clean)) AS new_value FROM {TR} WHERE supplier_clean IS DISTINCT FROM upper(trim(supplier_clean)))
SELECT c.id, d.doc_type, c.old_value, c.new_value, d.raw_text IS NOT NULL AND contains(upper(d.raw_text), c.new_value) AS printed, t.n FROM c JOIN documentos d ON d.id = c.doc_id LEFT JOIN (SELECT doc_id, upper(supplier_clean) AS s, count(*) AS n FROM {TR} GROUP BY 1, 2) t ON t.doc_id = c.doc_id AND t.s = upper(c.old_value)""")
def correction_texts(spark, d):
    """Corrected suppliers with their documents and the number of its transactions of that supplier, compared in upper case."""
    t = distinct_trans(spark, d)
    c = t.select("id", "doc_id", F.col("supplier_clean").alias("old_value"), F.upper(F.trim("supplier_clean")).alias("new_value")).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), "doc_type", F.upper("raw_text").alias("up"))
    n = t.groupBy("doc_id", F.upper("supplier_clean").alias("s")).agg(F.count("*").alias("n"))
    j = c.withColumn("s", F.upper("old_value")).join(docs, "doc_id").join(n, ["doc_id", "s"], "left")
    return j.select("id", "doc_type", "old_value", "new_value", F.coalesce(F.contains("up", F.col("new_value")), F.lit(False)).alias("printed"), "n")


@query("mail_labels", "SELECT id, CASE WHEN status = 'ERROR' THEN ['Processed', 'Error'] WHEN raw_text IS NULL OR trim(raw_text, ' ') = '' THEN ['Processed', 'Unread'] ELSE ['Processed', doc_type] END AS labels, [CASE WHEN ends_with(lower(original_path), '.pdf') THEN 'PDF' ELSE 'OTHER' END, CASE WHEN email_subject IS NOT NULL THEN 'MAIL' ELSE 'FILE' END] AS content FROM documentos WHERE doc_type IS NOT NULL")
def mail_labels(spark, d):
    """Labels of a landed paper by its outcome, and the kinds of content it came with."""
    unread = F.col("raw_text").isNull() | (F.trim("raw_text") == "")
    second = F.when(F.col("status") == "ERROR", "Error").when(unread, "Unread").otherwise(F.col("doc_type"))
    content = F.array(F.when(F.lower("original_path").endswith(".pdf"), "PDF").otherwise("OTHER"), F.when(F.col("email_subject").isNotNull(), "MAIL").otherwise("FILE"))
    return load(spark, d, "documentos").filter("doc_type is not null").select("id", F.array(F.lit("Processed"), second).alias("labels"), content.alias("content"))


@query("best_due_date", f"""
WITH r AS (SELECT doc_id, due_date AS day, 0.9 AS c FROM {TR} WHERE nullif(due_date, '') IS NOT NULL UNION ALL SELECT boleto_id, due_date, 0.95 FROM (SELECT DISTINCT * FROM duplicatas) WHERE boleto_id IS NOT NULL AND nullif(due_date, '') IS NOT NULL),
s AS (SELECT doc_id, {scalars._iso('day')} AS d, c FROM r)
SELECT doc_id, arg_min(d, (-c, d)) AS due, max(c)::DOUBLE AS confidence FROM s WHERE d IS NOT NULL GROUP BY doc_id""")
def best_due_date(spark, d):
    """The due date of each document among its readings: the surest, the earliest of equally sure ones."""
    t = distinct_trans(spark, d).select("doc_id", "due_date", F.lit(0.9).alias("c"))
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).filter("boleto_id is not null").select(F.col("boleto_id").alias("doc_id"), "due_date", F.lit(0.95).alias("c"))
    r = t.unionByName(u).withColumn("d", dates.parse_date(F.col("due_date"))).filter("d is not null")
    return r.groupBy("doc_id").agg(F.min_by("d", F.struct(-F.col("c"), F.col("d"))).alias("due"), F.max("c").alias("confidence"))
