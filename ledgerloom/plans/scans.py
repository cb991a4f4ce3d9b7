"""Dictionaries, layout of words, links and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import ids
from ..operators import dictionary, entities, layout
from ..sources import files
from ..sources.mail import route
from ..streaming.files import session_counts, windowed_counts
from .reports import TR, distinct_trans, load

KNOWN = "k AS (SELECT supplier AS name, supplier AS canonical, supplier AS ord FROM (SELECT DISTINCT upper(trim(split_part(file, '_', 3))) AS supplier FROM golden_dataset) WHERE length(supplier) > 2)"


def known(spark, d):
    s = files.suppliers_of_filenames(load(spark, d, "golden_dataset"))
    return s.select("name", F.col("name").alias("canonical"), F.col("name").alias("ord"))


@query("supplier_dictionary", f"""
WITH {KNOWN}, n AS (SELECT DISTINCT upper(trim(supplier_clean)) AS name FROM {TR} WHERE trim(supplier_clean) <> ''),
one AS (SELECT n.name, k.canonical, 1.0 AS score, 1 AS tier FROM n JOIN k ON k.name = n.name), r1 AS (SELECT name FROM n WHERE name NOT IN (SELECT name FROM one)),
t2 AS (SELECT r.name, k.canonical, k.ord, length(r.name) / greatest(length(k.name), length(r.name)) AS score FROM r1 r JOIN k ON contains(k.name, r.name) OR contains(r.name, k.name)),
two AS (SELECT name, arg_min(canonical, ord) AS canonical, arg_min(score, ord) AS score, 2 AS tier FROM t2 WHERE score >= 0.6 GROUP BY name), r2 AS (SELECT name FROM r1 WHERE name NOT IN (SELECT name FROM two)),
w AS (SELECT name, list_distinct(regexp_split_to_array(name, '\\s+')) AS ws FROM r2), kw AS (SELECT *, list_distinct(regexp_split_to_array(name, '\\s+')) AS ks FROM k),
t3 AS (SELECT w.name, kw.canonical, kw.ord, len(list_intersect(ws, ks)) / least(len(ws), len(ks)) AS score FROM w JOIN kw ON len(list_intersect(ws, ks)) > 0),
three AS (SELECT name, arg_min(canonical, (-score, ord)) AS canonical, max(score) AS score, 3 AS tier FROM t3 WHERE score >= 0.6 GROUP BY name)
SELECT name, canonical, round(score, 6)::DOUBLE AS score, tier FROM (FROM one UNION ALL FROM two UNION ALL FROM three)""")
def supplier_dictionary(spark, d):
    return dictionary.match_names(distinct_trans(spark, d), known(spark, d), "supplier_clean", fuzzy=False).withColumn("score", F.round("score", 6))


@query("supplier_fuzzy")
def supplier_fuzzy(spark, d):
    """All four tiers; the last has no SQL form and is tested against a plain loop."""
    return dictionary.match_names(distinct_trans(spark, d), known(spark, d), "supplier_clean").withColumn("score", F.round("score", 6))


@query("closest_known")
def closest_known(spark, d):
    """Suppliers by equal, begun or similar known names; tested against a plain loop."""
    return entities.closest_known(distinct_trans(spark, d), known(spark, d), "supplier_clean")


@query("entity_validation")
def entity_validation(spark, d):
    """Suppliers and company numbers of documents against the numbers that access keys pair with names; tested on literal rows."""
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), "access_key", F.regexp_extract("raw_text", r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}", 0).alias("cnpj"))
    t = distinct_trans(spark, d, "supplier_clean is not null").join(docs, "doc_id")
    k = t.withColumn("f", ids.key_fields(F.col("access_key"))).filter("f is not null").groupBy(F.col("f.cnpj").alias("cnpj")).agg(F.min("supplier_clean").alias("name"))
    return entities.cross_validate(t.select("id", "cnpj", F.col("supplier_clean").alias("name")), k, "id").withColumn("confidence", F.round("confidence", 6))


@query("banned_filter", f"WITH b(n) AS (VALUES ('BANCO'), ('DIVERSOS'), ('PNEUS')), n AS (SELECT DISTINCT upper(trim(supplier_clean)) AS name FROM {TR} WHERE trim(supplier_clean) <> '') SELECT name FROM n WHERE EXISTS (FROM b WHERE contains(name, b.n) OR contains(b.n, name))")
def banned_filter(spark, d):
    b = spark.createDataFrame([("BANCO",), ("DIVERSOS",), ("PNEUS",)], "name string")
    return dictionary.unwanted(distinct_trans(spark, d), b, "supplier_clean")


# Words of printed lines, with coordinates made from their places: the same expressions on both engines.
WORDS = """
l AS (SELECT id AS doc_id, unnest(string_split(replace(raw_text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(raw_text, chr(13), ''), chr(10)), 1) - 1 AS li FROM documentos WHERE raw_text IS NOT NULL),
w AS (SELECT doc_id, li, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS wi FROM l),
words AS (SELECT doc_id, wi * 60.0 AS x0, li * 20.0 AS y0, wi * 60.0 + 50 AS x1, li * 20.0 + 10 AS y1, text, li // 3 AS block, li * 1000 + wi AS word FROM w WHERE text <> '')"""


def words(spark, d):
    t = load(spark, d, "documentos").filter("raw_text is not null").select(F.col("id").alias("doc_id"), F.posexplode(F.split(F.replace("raw_text", F.lit("\r"), F.lit("")), "\n")).alias("li", "line"))
    w = t.select("doc_id", "li", F.posexplode(F.split("line", " ")).alias("wi", "text")).filter("text <> ''")
    return w.select("doc_id", (F.col("wi") * 60.0).alias("x0"), (F.col("li") * 20.0).alias("y0"), (F.col("wi") * 60.0 + 50).alias("x1"), (F.col("li") * 20.0 + 10).alias("y1"), "text", F.floor(F.col("li") / 3).cast("int").alias("block"), (F.col("li") * 1000 + F.col("wi")).alias("word"))


@query("region_text", f"WITH {WORDS} SELECT doc_id, trim(string_agg(text, ' ' ORDER BY floor(y0 / 3), x0, word)) AS text FROM words WHERE greatest(0, least(x1, 300) - greatest(x0, 0)) * greatest(0, least(y1, 45) - greatest(y0, 0)) > (x1 - x0) * (y1 - y0) * 0.4 GROUP BY doc_id")
def region_text(spark, d):
    return layout.region_text(words(spark, d), 0, 0, 300, 45)


@query("value_right", f"""
WITH {WORDS}, p AS (SELECT *, lead(text) OVER v AS t1, lead(x1) OVER v AS nx, lead(y1) OVER v AS ny FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY word)),
a AS (SELECT doc_id, arg_min(greatest(x1, nx), word) AS ax1, arg_min(y0, word) AS ay0, arg_min(greatest(y1, ny), word) AS ay1 FROM p WHERE contains(upper(text), 'VALOR') AND contains(upper(t1), 'DO') GROUP BY doc_id)
SELECT w.doc_id, trim(string_agg(text, ' ' ORDER BY floor(y0 / 3), x0, word)) AS value FROM words w JOIN a USING (doc_id)
WHERE greatest(0, least(x1, ax1 + 200) - greatest(x0, ax1)) * greatest(0, least(y1, ay1 + 2) - greatest(y0, ay0 - 2)) > (x1 - x0) * (y1 - y0) * 0.4 GROUP BY w.doc_id""")
def value_right(spark, d):
    return layout.value_near(words(spark, d), "valor do", "right")


@query("layout_top_blocks", f"WITH {WORDS}, b AS (SELECT doc_id, block, min(y0) AS y, string_agg(text, ' ' ORDER BY word) AS text FROM words GROUP BY 1, 2) SELECT doc_id, place::INT AS place, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, block) AS place FROM b) WHERE place <= 5")
def layout_top_blocks(spark, d):
    return layout.top_blocks(words(spark, d))


@query("supplier_header", f"WITH {WORDS}, b AS (SELECT doc_id, block, string_agg(text, ' ' ORDER BY word) AS t FROM words WHERE y1 < 200 GROUP BY 1, 2) SELECT doc_id, arg_min(t, block) AS header FROM b WHERE length(t) > 5 AND NOT (contains(upper(t), 'DANFE') OR contains(upper(t), 'NOTA FISCAL') OR contains(upper(t), 'BOLETO') OR contains(upper(t), 'COMPROVANTE')) GROUP BY doc_id")
def supplier_header(spark, d):
    return layout.supplier_header(words(spark, d))


# Words that tremble: every seventh place of a line lies up to 12 units lower, so lines touch and the rules differ.
TREMBLE = f"{WORDS}, jw AS (SELECT doc_id, word, text, x0, y0 + 5 + ((word * 5) % 7) * 2 AS y FROM words)"


def trembling(spark, d):
    lower = (F.col("word") * 5) % 7 * 2
    return words(spark, d).withColumns({"y0": F.col("y0") + lower, "y1": F.col("y1") + lower})


@query("gapped_lines", f"WITH {TREMBLE}, g AS (SELECT *, CASE WHEN y - lag(y) OVER v >= 10 OR lag(y) OVER v IS NULL THEN 1 ELSE 0 END AS b FROM jw WINDOW v AS (PARTITION BY doc_id ORDER BY y, x0, word)), ln AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY y, x0, word ROWS UNBOUNDED PRECEDING) AS line FROM g) SELECT doc_id, string_agg(text, ' ' ORDER BY x0, word) AS text, line::BIGINT AS line FROM ln GROUP BY doc_id, line")
def gapped_lines(spark, d):
    return layout.gapped_lines(trembling(spark, d))


@query("anchored_lines", f"""WITH RECURSIVE {TREMBLE}, ys AS (SELECT DISTINCT doc_id, y FROM jw),
a(doc_id, line, top) AS (SELECT doc_id, 1, min(y) FROM ys GROUP BY doc_id UNION ALL SELECT a.doc_id, a.line + 1, min(ys.y) FROM a JOIN ys ON ys.doc_id = a.doc_id AND ys.y > a.top + 15 GROUP BY a.doc_id, a.line)
SELECT jw.doc_id, string_agg(text, ' ' ORDER BY x0, word) AS text, a.line::INT AS line FROM jw JOIN a ON a.doc_id = jw.doc_id AND jw.y BETWEEN a.top AND a.top + 15 GROUP BY jw.doc_id, a.line""")
def anchored_lines(spark, d):
    return layout.anchored_lines(trembling(spark, d))


@query("mail_route", "SELECT id, CASE WHEN ends_with(lower(original_path), '.xml') THEN 'xml' WHEN ends_with(lower(original_path), '.pdf') THEN 'pdf' WHEN email_subject IS NOT NULL AND length(trim(email_subject)) > 0 THEN 'link' WHEN length(trim(coalesce(raw_text, ''), ' ')) > 0 THEN 'text' ELSE 'skip' END AS route FROM documentos")
def mail_route(spark, d):
    m = load(spark, d, "documentos").select("id", F.col("email_subject").alias("html_body"), F.col("raw_text").alias("text_body"), F.array(F.struct(F.col("original_path").alias("filename"))).alias("attachments"))
    return route(m).select("id", "route")


@query("event_windows", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The windowed count of the stream, run over the table."""
    return windowed_counts(load(spark, d, "events"), "ts", "event_type")


@query("event_sessions", """
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, d):
    return session_counts(load(spark, d, "events"), "ts", "user_id")


@query("value_below", f"""
WITH {WORDS}, a AS (SELECT doc_id, arg_min(x0, word) AS ax0, arg_min(y1, word) AS ay1 FROM words WHERE contains(upper(text), 'VENCIMENTO') GROUP BY doc_id)
SELECT w.doc_id, trim(string_agg(text, ' ' ORDER BY floor(y0 / 3), x0, word)) AS value FROM words w JOIN a USING (doc_id)
WHERE greatest(0, least(x1, ax0 + 150) - greatest(x0, ax0 - 5)) * greatest(0, least(y1, ay1 + 200) - greatest(y0, ay1)) > (x1 - x0) * (y1 - y0) * 0.4 GROUP BY w.doc_id""")
def value_below(spark, d):
    return layout.value_near(words(spark, d), "vencimento", "below")


@query("slip_anchors", f"""
WITH {WORDS}, p AS (SELECT *, lead(text) OVER v AS t1, lead(text, 2) OVER v AS t2, lead(x0, 2) OVER v AS bx0, lead(x1, 2) OVER v AS bx1, lead(y1, 2) OVER v AS by1 FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY word)),
r AS (SELECT doc_id, 'due' AS field, arg_max(x0, word) - 20 AS rx0, arg_max(y1, word) AS ry0, arg_max(x1, word) + 100 AS rx1, arg_max(y1, word) + 35 AS ry1 FROM p WHERE contains(upper(text), 'VENCIMENTO') GROUP BY doc_id
  UNION ALL SELECT doc_id, 'amount', arg_max(bx0, word) - 20, arg_max(by1, word), arg_max(bx1, word) + 80, arg_max(by1, word) + 35 FROM p WHERE contains(upper(text), 'VALOR') AND contains(concat(upper(t1), ' ', upper(t2)), 'DOCUMENTO') AND t2 IS NOT NULL GROUP BY doc_id),
b AS (SELECT r.doc_id, field, trim(string_agg(text, ' ' ORDER BY floor(y0 / 3), x0, word)) AS t FROM words w JOIN r ON r.doc_id = w.doc_id WHERE greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) > (x1 - x0) * (y1 - y0) * 0.4 GROUP BY r.doc_id, field)
SELECT doc_id, field, CASE field WHEN 'due' THEN regexp_extract(t, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1) ELSE regexp_extract(t, '([0-9.]*[0-9][0-9.]*,?[0-9]*)', 1) END AS value FROM b WHERE regexp_matches(t, CASE field WHEN 'due' THEN '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}' ELSE '[0-9]' END)""")
def slip_anchors(spark, d):
    """Due date and amount in the boxes below their labels; of several labels the last counts."""
    return layout.slip_anchors(words(spark, d))


@query("largest_below", f"""
WITH {WORDS}, h AS (SELECT doc_id, max(y1) * 0.6 AS cut FROM words GROUP BY doc_id),
b AS (SELECT w.doc_id, block, string_agg(text, ' ' ORDER BY word) AS t FROM words w JOIN h USING (doc_id) GROUP BY w.doc_id, block HAVING max(y1) > min(cut)),
v AS (SELECT doc_id, try_cast(replace(replace(regexp_extract(t, '[0-9][0-9.]*,[0-9]{{2}}'), '.', ''), ',', '') AS BIGINT) AS cents FROM b)
SELECT doc_id, max(cents) AS cents FROM v WHERE cents IS NOT NULL GROUP BY doc_id""")
def largest_below(spark, d):
    """The largest of the blocks' first amounts in the lower part of a page."""
    return layout.largest_below(words(spark, d))


@query("reader_lines", f"WITH {WORDS} SELECT doc_id, string_agg(text, chr(10) ORDER BY word) AS text FROM words WHERE (word * 37) % 100 >= 60 GROUP BY doc_id")
def reader_lines(spark, d):
    """Words that their reader is sure of, joined by line breaks."""
    w = words(spark, d).withColumn("confidence", (F.col("word") * 37) % 100 / 100)
    return layout.sure_text(w, "confidence", 0.6)


TAX = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"


@query("supplier_tax", f"""
WITH x AS (SELECT id, upper(raw_text) AS up, regexp_extract_all(raw_text, '{TAX}') AS c, regexp_split_to_array(raw_text, '{TAX}') AS p FROM documentos WHERE regexp_matches(raw_text, '{TAX}')),
k AS (SELECT id, up, c, p, unnest(range(1, len(c) + 1)) AS k FROM x),
s AS (SELECT id, k, c[k] AS cnpj, list_sum(list_transform(p[1:k], lambda q: length(q))) + 18 * (k - 1) AS pos, up FROM k),
w AS (SELECT id, cnpj, pos, substr(up, greatest(0, pos - 150)::BIGINT + 1, least(150, pos)::BIGINT) AS before FROM s),
g AS (SELECT id, cnpj, pos, round(1.0 - CASE WHEN regexp_matches(before, 'PAGADOR|SACADO|DESTINAT|CLIENTE') THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(before, 'BENEFICIARIO|CEDENTE|EMITENTE|FAVORECIDO|FORNECEDOR') THEN 0.5 ELSE 0 END, 6) AS score FROM w)
SELECT id, arg_min(cnpj, (-score, pos)) AS cnpj, round(least(0.9, 0.5 + max(score) * 0.4), 6)::DOUBLE AS confidence FROM g GROUP BY id HAVING max(score) > 0.3""")
def supplier_tax(spark, d):
    """The company number of the issuer: numbers after words for the payer lose, after words for the issuer gain; the first of the best, if above 0.3."""
    t = load(spark, d, "documentos").select("id", "raw_text").filter(F.col("raw_text").rlike(TAX))
    x = t.select("id", F.upper("raw_text").alias("up"), F.split("raw_text", TAX).alias("p"), F.posexplode(F.regexp_extract_all("raw_text", F.lit(TAX), F.lit(0))).alias("k", "cnpj"))
    at = F.aggregate(F.slice("p", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, q: a + F.length(q)) + F.col("k") * 18
    w = x.select("id", "cnpj", at.alias("at"), "up").select("id", "cnpj", "at", F.substr("up", F.greatest(F.lit(0), F.col("at") - 150) + 1, F.least(F.lit(150), F.col("at"))).alias("before"))
    score = F.lit(1.0) - F.when(F.col("before").rlike("PAGADOR|SACADO|DESTINAT|CLIENTE"), 0.8).otherwise(0.0) + F.when(F.col("before").rlike("BENEFICIARIO|CEDENTE|EMITENTE|FAVORECIDO|FORNECEDOR"), 0.5).otherwise(0.0)
    b = w.groupBy("id").agg(F.min(F.struct(-F.round(score, 6), "at", "cnpj")).alias("b"))
    return b.select("id", F.col("b.cnpj").alias("cnpj"), (-F.col("b.col1")).alias("s")).filter("s > 0.3").select("id", "cnpj", F.round(F.least(F.lit(0.9), 0.5 + F.col("s") * 0.4), 6).alias("confidence"))


@query("usage_stats", "SELECT coalesce(meta.verified_by, '') AS source, count(*) AS requests, count(*) FILTER (meta.is_verified) AS good, count(*) - count(*) FILTER (meta.is_verified) AS bad, round(count(*) FILTER (meta.is_verified) / count(*), 6)::DOUBLE AS rate, round(avg(extraction_confidence), 6) AS mean FROM golden_dataset GROUP BY 1")
def usage_stats(spark, d):
    """Requests of each source, how many went well, their share and the mean of a measure."""
    g = load(spark, d, "golden_dataset")
    good = F.count_if(F.col("meta.is_verified"))
    return g.groupBy(F.coalesce("meta.verified_by", F.lit("")).alias("source")).agg(F.count("*").alias("requests"), good.alias("good"), (F.count("*") - good).alias("bad"), F.round(good / F.count("*"), 6).alias("rate"), F.round(F.avg("extraction_confidence"), 6).alias("mean"))
