"""Scalar functions run over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, ids, money, text
from ..functions import similarity as S
from .reports import TR, distinct_trans, load

# SQL fragments shared by the oracles
FOLD = f"upper(translate(%s, '{text.ACCENTED}', '{text.BARE}'))"


def _sum(up: str, words) -> str:
    w = words if isinstance(words, dict) else dict.fromkeys(words, 1)
    return "(" + " + ".join(f"CASE WHEN contains({up}, '{k}') THEN {v} ELSE 0 END" for k, v in w.items()) + ")"


def _any(up: str, words) -> str:
    return "(" + " OR ".join(f"contains({up}, '{k}')" for k in words) + ")"


UP = "SELECT id, coalesce(" + FOLD % "raw_text" + ", '') AS up, raw_text FROM documentos"


@query("amount_cents", "SELECT id, CAST(trunc(try_cast(replace(regexp_replace(v, '[R$ .]', '', 'g'), ',', '.') AS DOUBLE) * 100) AS BIGINT) AS cents, CAST(replace(regexp_replace(v, '[R$ .]', '', 'g'), ',', '.')::DECIMAL(20,4) * 100 AS BIGINT) AS exact_cents FROM (SELECT id, regexp_extract(raw_text, 'R\\$ ([0-9.]+,[0-9]{2})', 0) AS v FROM documentos) WHERE v <> ''")
def amount_cents(spark, d):
    v = load(spark, d, "documentos").select("id", F.regexp_extract("raw_text", r"R\$ ([0-9.]+,[0-9]{2})", 0).alias("v")).filter("v <> ''")
    return v.select("id", money.amount_to_cents(F.col("v")).alias("cents"), money.amount_to_cents(F.col("v"), exact=True).alias("exact_cents"))


@query("cents_display", f"SELECT id, translate(format('{{:,.2f}}', amount_cents / 100), ',.', '.,') AS shown FROM {TR} WHERE amount_cents IS NOT NULL")
def cents_display(spark, d):
    return distinct_trans(spark, d, "amount_cents is not null").select("id", money.cents_to_display(F.col("amount_cents")).alias("shown"))


@query("money_forms", f"SELECT id, amount_cents AS brazilian, amount_cents AS american FROM {TR} WHERE amount_cents IS NOT NULL")
def money_forms(spark, d):
    """Round trip: an amount shown in either form reads back."""
    t = distinct_trans(spark, d, "amount_cents is not null")
    return t.select("id", money.parse_money(money.cents_to_display(F.col("amount_cents"))).alias("brazilian"), money.parse_money(F.format_number(F.col("amount_cents") / 100, 2)).alias("american"))


AMOUNTS = [(p.replace("\\", "\\"), c) for p, c in money.AMOUNT_LABELS]
_HIT = ", ".join(f"nullif(try_cast(replace(replace(regexp_extract(up, '{p}', 1), '.', ''), ',', '') AS BIGINT), 0) AS h{i}" for i, (p, _) in enumerate(money.AMOUNT_LABELS))


@query("amount_ranked", f"""
WITH u AS (SELECT id, upper(raw_text) AS up FROM documentos), h AS (SELECT id, {_HIT}, list_max(list_transform(regexp_extract_all(up, '{money.MONEY}', 1), lambda x: replace(replace(x, '.', ''), ',', '')::BIGINT)) AS largest FROM u)
SELECT id, coalesce({', '.join(f'h{i}' for i in range(len(money.AMOUNT_LABELS)))}, nullif(largest, 0)) AS cents,
       CASE {' '.join(f'WHEN h{i} IS NOT NULL THEN {c}' for i, (_, c) in enumerate(money.AMOUNT_LABELS))} WHEN largest > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM h""")
def amount_ranked(spark, d):
    cents, conf = money.ranked_amount(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", cents.alias("cents"), conf.alias("confidence"))


ISO = "CASE WHEN regexp_matches(s, '^[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}$') THEN concat(substr(s, 7, 4), '-', substr(s, 4, 2), '-', substr(s, 1, 2)) WHEN regexp_matches(s, '^[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}$') THEN concat(CASE WHEN substr(s, 7, 2)::INT >= 50 THEN '19' ELSE '20' END, substr(s, 7, 2), '-', substr(s, 4, 2), '-', substr(s, 1, 2)) WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN s END"


@query("date_normalise", f"SELECT id, {ISO} AS iso, strftime(try_cast({ISO} AS DATE), '%d/%m/%Y') AS shown FROM (SELECT id, substr(trim(due_date), 1, 10) AS s FROM {TR})")
def date_normalise(spark, d):
    c = F.col("due_date")
    return distinct_trans(spark, d).select("id", dates.normalise_date(c).alias("iso"), dates.to_brazilian(dates.parse_date(c)).alias("shown"))


def _iso(c: str) -> str:
    return f"try_cast({ISO.replace('(s,', f'(substr(trim({c}), 1, 10),').replace(' THEN s END', f' THEN substr(trim({c}), 1, 10) END')} AS DATE)"


@query("date_logic", f"""
WITH x AS (SELECT id, {_iso('emission_date')} AS e, {_iso('due_date')} AS u, {_iso('payment_date')} AS p FROM {TR})
SELECT id, CASE WHEN u < e THEN u ELSE e END AS emission, CASE WHEN u < e THEN e ELSE u END AS due,
       concat_ws(',', CASE WHEN e > DATE '2024-06-30' THEN 'emission_in_future' END, CASE WHEN u < e THEN 'due_before_emission' END, CASE WHEN p < e THEN 'payment_before_emission' END, CASE WHEN year(e) < 2020 OR year(e) > 2025 THEN 'year_out_of_range' END) AS issues FROM x""")
def date_logic(spark, d):
    e, u, p = (dates.parse_date(F.col(c)) for c in ("emission_date", "due_date", "payment_date"))
    first, last = dates.ordered_dates(e, u)
    return distinct_trans(spark, d).select("id", first.alias("emission"), last.alias("due"), F.array_join(dates.date_issues(e, u, p, F.lit("2024-06-30").cast("date")), ",").alias("issues"))


KD = "regexp_replace(access_key, '[^0-9]', '', 'g')"


@query("key_fields", f"SELECT id, substr({KD}, 26, 9)::BIGINT AS number, substr({KD}, 7, 14) AS cnpj, substr({KD}, 3, 4) AS month FROM documentos WHERE length({KD}) = 44")
def key_fields(spark, d):
    x = load(spark, d, "documentos").select("id", ids.key_fields(F.col("access_key")).alias("k")).filter("k is not null")
    return x.select("id", "k.number", "k.cnpj", "k.month")


@query("slip_line_fields", f"SELECT id, nullif(substr(digitable_line, 38, 10)::BIGINT, 0) AS cents, DATE '1997-10-07' + nullif(substr(digitable_line, 34, 4)::INT, 0) AS due FROM {TR} WHERE length(digitable_line) = 47")
def slip_line_fields(spark, d):
    c = F.col("digitable_line")
    return distinct_trans(spark, d).filter(F.length(c) == 47).select("id", ids.slip_value(c).alias("cents"), ids.slip_due(c).alias("due"))


def _mod11(expr: str, weights: list[int]) -> str:
    s = " + ".join(f"substr({expr}, {i + 1}, 1)::INT * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({s}) % 11 < 2 THEN 0 ELSE 11 - ({s}) % 11 END)"


_CN = "regexp_replace(regexp_extract(raw_text, 'CNPJ ([0-9./-]{18})', 1), '[^0-9]', '', 'g')"


@query("cnpj_check", f"SELECT id, c AS cnpj, {_mod11('c', ids.CNPJ_1)} = substr(c, 13, 1)::INT AND {_mod11('c', ids.CNPJ_2)} = substr(c, 14, 1)::INT AND c <> repeat(substr(c, 1, 1), 14) AS valid FROM (SELECT id, {_CN} AS c FROM documentos) WHERE length(c) = 14")
def cnpj_check(spark, d):
    x = load(spark, d, "documentos").select("id", ids.digits_only(F.regexp_extract("raw_text", r"CNPJ ([0-9./-]{18})", 1)).alias("cnpj")).filter("length(cnpj) = 14")
    return x.withColumn("valid", ids.is_cnpj(F.col("cnpj")))


_CP = "regexp_replace(regexp_extract(raw_text, '([0-9]{3}[.][0-9]{3}[.][0-9]{3}-[0-9]{2})', 1), '[^0-9]', '', 'g')"


@query("cpf_check", f"SELECT id, {_mod11('c', ids.CPF_1)} = substr(c, 10, 1)::INT AND {_mod11('c', ids.CPF_2)} = substr(c, 11, 1)::INT AND c <> repeat(substr(c, 1, 1), 11) AS valid FROM (SELECT id, {_CP} AS c FROM documentos) WHERE length(c) = 11")
def cpf_check(spark, d):
    x = load(spark, d, "documentos").select("id", ids.digits_only(F.regexp_extract("raw_text", r"([0-9]{3}[.][0-9]{3}[.][0-9]{3}-[0-9]{2})", 1)).alias("c")).filter("length(c) = 11")
    return x.select("id", ids.is_cpf(F.col("c")).alias("valid"))


@query("key_check", f"SELECT id, {_mod11('k', ids.KEY)} = substr(k, 44, 1)::INT AS valid FROM (SELECT id, {KD} AS k FROM documentos) WHERE length(k) = 44")
def key_check(spark, d):
    x = load(spark, d, "documentos").filter(F.length(ids.digits_only(F.col("access_key"))) == 44)
    return x.select("id", ids.is_access_key(F.col("access_key")).alias("valid"))


@query("key_repair")
def key_repair(spark, d):
    """Each readable key with its first repair; tested against trying every candidate."""
    x = load(spark, d, "documentos").filter("access_key is not null").select("id", ids.digits_only(F.col("access_key")).alias("key"))
    return x.withColumn("repaired", ids.repaired_key(F.col("key"))).withColumn("valid", ids.is_access_key(F.col("repaired")))


def _mod10(expr: str, start: int, n: int) -> str:
    s = " + ".join(f"(substr({expr}, {start + i}, 1)::INT * {w}) // 10 + (substr({expr}, {start + i}, 1)::INT * {w}) % 10" for i, w in ((i, 2 if (n - 1 - i) % 2 == 0 else 1) for i in range(n)))
    return f"((10 - ({s}) % 10) % 10 = substr({expr}, {start + n}, 1)::INT)"


@query("line_check", f"SELECT id, {_mod10('digitable_line', 1, 9)} AND {_mod10('digitable_line', 11, 10)} AND {_mod10('digitable_line', 22, 10)} AS valid FROM {TR} WHERE length(digitable_line) = 47")
def line_check(spark, d):
    return distinct_trans(spark, d, "length(digitable_line) = 47").select("id", ids.is_slip_line(F.col("digitable_line")).alias("valid"))


def _weighted_sql() -> str:
    s = {k: _sum("up", w) for k, w in text.WEIGHTED.items()}
    return f"""
WITH u AS ({UP}), a AS (SELECT id, up, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM u),
     b AS (SELECT *, BOLETO + CASE WHEN (contains(up, 'LINHA DIGITAVEL') OR contains(up, 'NOSSO NUMERO')) AND NFE < 15 THEN 10 ELSE 0 END AS sl FROM a),
     c AS (SELECT *, CASE WHEN sl > 0 AND sl >= COMPROVANTE THEN 0 ELSE COMPROVANTE END AS rc, CASE WHEN contains(up, 'DANFE') AND NFE >= 15 THEN sl // 2 ELSE sl END AS sp FROM b),
     t AS (SELECT *, greatest(sp, NFE, NFSE, rc, APOLICE) AS top FROM c)
SELECT id, CASE WHEN top = 0 THEN 'UNKNOWN' WHEN sp = top THEN 'BOLETO' WHEN NFE = top THEN 'NFE' WHEN NFSE = top THEN 'NFSE' WHEN rc = top THEN 'COMPROVANTE' ELSE 'APOLICE' END AS kind, least(top / 50.0, 1.0)::DOUBLE AS confidence FROM t"""


@query("classify_weighted", _weighted_sql())
def classify_weighted(spark, d):
    kind, conf = text.classify_weighted(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", kind.alias("kind"), conf.cast("double").alias("confidence"))


_PG = ", ".join(f"{_sum('up', w)} AS {k}" for k, w in text.COUNTED.items())


@query("classify_page", f"""
WITH u AS ({UP}), a AS (SELECT id, {_PG} FROM u), t AS (SELECT *, greatest({', '.join(text.COUNTED)}) AS top FROM a)
SELECT id, CASE WHEN top = 0 THEN 'UNKNOWN' {' '.join(f"WHEN {k} = top THEN '{k}'" for k in text.COUNTED)} END AS kind,
       round(CASE WHEN top = 0 THEN 0 {' '.join(f'WHEN {k} = top THEN top / {len(w)}' for k, w in text.COUNTED.items())} END, 6)::DOUBLE AS share FROM t""")
def classify_page(spark, d):
    kind, share = text.classify_page(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", kind.alias("kind"), F.round(share, 6).alias("share"))


@query("classify_rules", f"WITH u AS ({UP}) SELECT id, CASE {' '.join(f'WHEN {_any(chr(117) + chr(112), w)} THEN {chr(39)}{k}{chr(39)}' for k, w in text.ORDERED)} ELSE 'UNKNOWN' END AS kind FROM u")
def classify_rules(spark, d):
    return load(spark, d, "documentos").select("id", text.classify_ordered(F.col("raw_text")).alias("kind"))


@query("text_router", "SELECT id, CASE WHEN length(trim(coalesce(raw_text, ''), ' ')) >= 200 THEN 'DIGITAL_OK' ELSE 'NEEDS_OCR' END AS route FROM documentos")
def text_router(spark, d):
    return load(spark, d, "documentos").select("id", text.route_by_length(F.col("raw_text")).alias("route"))


@query("junk_text", f"""
WITH x AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), y AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(t) AS share FROM x)
SELECT doc_id, CASE WHEN length(t) < 10 THEN true WHEN share < 0.4 THEN true ELSE share < 0.6 AND NOT {_any('upper(t)', text.SANE)} END AS junk FROM y""")
def junk_text(spark, d):
    return load(spark, d, "documents").select("doc_id", text.is_junk(F.col("text")).alias("junk"))


@query("payment_state", f"""
WITH u AS ({UP}), a AS (SELECT id, {_sum('up', text.COUNT_PLANNED)} AS planned, {_sum('up', text.COUNT_MADE)} + CASE WHEN regexp_matches(up, '{text.MARK}') THEN 3 ELSE 0 END AS made FROM u)
SELECT id, CASE WHEN planned > made THEN 'PLANNED' WHEN made > 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS state, round(CASE WHEN planned > made THEN least(0.9, 0.6 + planned * 0.1) WHEN made > 0 THEN least(0.95, 0.7 + made * 0.1) ELSE 0.5 END, 6)::DOUBLE AS confidence, planned, made FROM a""")
def payment_state(spark, d):
    state, sure, planned, made = text.payment_state(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", state.alias("state"), sure.alias("confidence"), planned.alias("planned"), made.alias("made"))


@query("bank_payment", f"""
WITH u AS ({UP}), a AS (SELECT id, {_any('up', text.PLANNED)} AS planned, {_any('up', text.CONFIRMED)} AS said, nullif(regexp_extract(up, '{text.AUTHENTICATION}'), '') AS auth, {_any('up', text.SCHEDULED)} AND NOT {_any('up', text.DENIED)} AS scheduled FROM u)
SELECT id, CASE WHEN planned THEN 'PLANNED' WHEN said AND auth IS NOT NULL THEN 'CONFIRMED' WHEN said THEN 'CONFIRMED_UNSIGNED' WHEN auth IS NOT NULL THEN 'PROBABLE' ELSE 'NOTHING' END AS reason, auth, scheduled FROM a""")
def bank_payment(spark, d):
    """What a receipt says about its payment, its authentication, and whether it is only scheduled."""
    reason, auth = text.bank_payment(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", reason.alias("reason"), auth.alias("auth"), text.is_planned(F.col("raw_text")).alias("scheduled"))


def _number_sql() -> str:
    num, conf = "", ""
    for k, forms in text.NUMBER.items():
        for p, c in forms:
            v = f"ltrim(regexp_extract(up, '{p}', 1), '0')"
            num += f" WHEN doc_type = '{k}' AND length({v}) >= 3 THEN {v}"
            conf += f" WHEN doc_type = '{k}' AND length({v}) >= 3 THEN {c}"
    return f"SELECT id, CASE{num} END AS number, (CASE{conf} ELSE 0 END)::DOUBLE AS confidence FROM (SELECT id, doc_type, upper(coalesce(raw_text, '')) AS up FROM documentos)"


@query("doc_number", _number_sql())
def doc_number(spark, d):
    n, c = text.document_number(F.col("raw_text"), F.col("doc_type"))
    return load(spark, d, "documentos").select("id", n.alias("number"), c.alias("confidence"))


@query("installments_extract", """
WITH x AS (SELECT id, unnest(regexp_extract_all(raw_text, '(?:^|\\s)[0-9]{3}\\s+[0-9]{2}/[0-9]{2}/[0-9]{4}\\s+[0-9.]*[0-9],[0-9]{2}')) AS v FROM documentos WHERE doc_type = 'NFE')
SELECT id, regexp_extract(v, '([0-9]{3})\\s', 1)::INT AS seq_num, concat(regexp_extract(v, '/([0-9]{4})', 1), '-', regexp_extract(v, '/([0-9]{2})/', 1), '-', regexp_extract(v, '([0-9]{2})/[0-9]{2}/', 1)) AS due_date, replace(replace(regexp_extract(v, '([0-9.]*[0-9],[0-9]{2})$', 1), '.', ''), ',', '')::BIGINT AS amount_cents FROM x""")
def installments_extract(spark, d):
    return load(spark, d, "documentos").filter("doc_type = 'NFE'").select("id", F.inline(text.installments_of(F.col("raw_text"))))


@query("access_keys", "SELECT id, nullif(regexp_replace(regexp_extract(raw_text, '((?:[0-9]{4}\\s?){10}[0-9]{4})', 1), '\\s', '', 'g'), '') AS key FROM documentos")
def access_keys(spark, d):
    return load(spark, d, "documentos").select("id", text.access_key(F.col("raw_text")).alias("key"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(upper(trim(%s)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in S.COMMON) + "))"


@query("supplier_normalise", f"SELECT id, coalesce(array_to_string({_WORDS % 'supplier_clean'}, ' '), '') AS name FROM {TR}")
def supplier_normalise(spark, d):
    return distinct_trans(spark, d).select("id", S.normalise_supplier(F.col("supplier_clean")).alias("name"))


_LEGAL = S.LEGAL.replace("\\b", "\\b")


@query("company_normalise", f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(supplier_clean, '{text.ACCENTED}', '{text.BARE}')), '[^a-z0-9_\\s]', ' ', 'g'), '{_LEGAL}', '', 'g'), '\\s+', ' ', 'g')) AS name FROM {TR} WHERE supplier_clean IS NOT NULL")
def company_normalise(spark, d):
    return distinct_trans(spark, d, "supplier_clean is not null").select("id", S.normalise_company(F.col("supplier_clean")).alias("name"))


_PAIRS = f"SELECT DISTINCT a.supplier_clean AS a, b.supplier_clean AS b FROM {TR} a JOIN matches m ON m.parent_doc_id = a.doc_id JOIN {TR} b ON b.doc_id = m.child_doc_id WHERE a.supplier_clean IS NOT NULL AND b.supplier_clean IS NOT NULL"


def matched_names(spark, d):
    """Distinct pairs of suppliers on matched documents."""
    t = distinct_trans(spark, d, "supplier_clean is not null").select("doc_id", "supplier_clean")
    m = load(spark, d, "matches").select("parent_doc_id", "child_doc_id")
    return m.join(t.toDF("parent_doc_id", "a"), "parent_doc_id").join(t.toDF("child_doc_id", "b"), "child_doc_id").select("a", "b").distinct()


@query("supplier_similarity", f"""
WITH p AS ({_PAIRS}), w AS (SELECT a, b, list_distinct({_WORDS % 'a'}) AS wa, list_distinct({_WORDS % 'b'}) AS wb, array_to_string({_WORDS % 'a'}, ' ') AS x, array_to_string({_WORDS % 'b'}, ' ') AS y FROM p)
SELECT a, b, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 6)::DOUBLE AS similarity,
       round(CASE WHEN least(len(wa), len(wb)) > 0 THEN len(list_intersect(wa, wb)) / least(len(wa), len(wb)) ELSE 0 END, 6)::DOUBLE AS overlap FROM w""")
def supplier_similarity(spark, d):
    a, b = F.col("a"), F.col("b")
    return matched_names(spark, d).select("a", "b", F.round(S.word_similarity(a, b), 6).alias("similarity"), F.round(S.overlap_coefficient(a, b), 6).alias("overlap"))


@query("supplier_ratios")
def supplier_ratios(spark, d):
    """Ratios without a SQL form: insertions and deletions, sorted words, word sets, matching blocks; tested against definitions."""
    a, b = S.normalise_company(F.col("a")), S.normalise_company(F.col("b"))
    p = matched_names(spark, d).select("a", "b", a.alias("x"), b.alias("y"))
    return p.select("a", "b", *[F.round(S.pair_udf(f)("x", "y"), 6).alias(n) for n, f in (("indel", S.indel_ratio), ("token_sort", S.token_sort_ratio), ("token_set", S.token_set_ratio), ("sequence", S.sequence_ratio))])


@query("golden_filename", """
WITH x AS (SELECT file, regexp_extract(file, '^([0-9]{2}[.][0-9]{2}[.][0-9]{4})_', 1) AS day, split_part(file, '_', 2) AS tag, split_part(file, '_', 3) AS supplier, split_part(file, '_', 4) AS amount, split_part(file, '_', 5) AS kind FROM golden_dataset)
SELECT file, try_cast(concat(substr(day, 7, 4), '-', substr(day, 4, 2), '-', substr(day, 1, 2)) AS DATE) AS due, tag, supplier, try_cast(replace(replace(amount, '.', ''), ',', '') AS BIGINT) AS cents, kind FROM x""")
def golden_filename(spark, d):
    """Truth read from names such as DD.MM.YYYY_TAG_SUPPLIER_VALUE_TYPE_NUMBER.pdf."""
    part = lambda i: F.split_part(F.col("file"), F.lit("_"), F.lit(i))
    return load(spark, d, "golden_dataset").select("file", dates.parse_date(F.regexp_extract("file", r"^([0-9]{2}[.][0-9]{2}[.][0-9]{4})_", 1)).alias("due"), part(2).alias("tag"), part(3).alias("supplier"), F.regexp_replace(part(4), r"[.,]", "").try_cast("bigint").alias("cents"), part(5).alias("kind"))


@query("json_flatten", f"SELECT id, supplier_clean AS supplier, amount_cents AS cents FROM {TR}")
def json_flatten(spark, d):
    """A fenced JSON answer built from each row and read back into columns."""
    t = distinct_trans(spark, d)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("supplier_clean").alias("supplier"), F.struct(F.col("amount_cents").alias("cents")).alias("amount")), {"ignoreNullFields": "false"}), F.lit("\n```"))
    x = t.select("id", text.json_answer(answer, "supplier string, amount struct<cents: bigint>").alias("j"))
    return x.select("id", F.col("j.supplier").alias("supplier"), F.col("j.amount.cents").alias("cents"))


@query("link_score", f"""
WITH x AS (SELECT id, lower(regexp_extract(raw_text, '(?i)(www\\.[^\\s]+)', 1)) AS url FROM documentos)
SELECT id, url, round(least(0.15 * 1 + least(0.10 * len(regexp_extract_all(url, '{text.LINK_PATTERN}')), 0.3) + CASE WHEN contains(url, '.pdf') THEN 0.3 ELSE 0 END + CASE WHEN {_any('url', text.LINK_KNOWN)} THEN 0.25 ELSE 0 END, 1), 6)::DOUBLE AS confidence
FROM x WHERE url <> '' AND NOT {_any('url', text.LINK_IGNORED)}""")
def link_score(spark, d):
    """Addresses printed on papers, scored as links labelled 'segunda via'."""
    x = load(spark, d, "documentos").select("id", F.lower(F.regexp_extract("raw_text", r"(?i)(www\.[^\s]+)", 1)).alias("url")).filter("url <> ''")
    return x.withColumn("confidence", F.round(text.link_confidence(F.col("url"), F.lit("segunda via")), 6)).filter("confidence > 0")


@query("positional_vote", """
WITH x AS (SELECT doc_id, digitable_line AS v, id FROM (SELECT DISTINCT * FROM transacoes) WHERE digitable_line IS NOT NULL),
     l AS (SELECT bank, n FROM (SELECT substr(v, 1, 3) AS bank, length(v) AS n, count(*) AS c, row_number() OVER (PARTITION BY substr(v, 1, 3) ORDER BY count(*) DESC, length(v)) AS k FROM x GROUP BY 1, 2) WHERE k = 1),
     p AS (SELECT l.bank, i, substr(v, i, 1) AS ch, count(*) AS c, min(id) AS first FROM x JOIN l ON substr(v, 1, 3) = l.bank AND length(v) = l.n, range(1, 48) t(i) WHERE i <= l.n GROUP BY 1, 2, 3)
SELECT bank, string_agg(ch, '' ORDER BY i) AS voted FROM (SELECT *, row_number() OVER (PARTITION BY bank, i ORDER BY c DESC, first) AS k FROM p) WHERE k = 1 GROUP BY bank""")
def positional_vote(spark, d):
    """Most frequent character at each position among readings of the most frequent length, by bank; ties go to the earliest reading."""
    from ..operators.voting import positional_vote as vote

    t = distinct_trans(spark, d, "digitable_line is not null").select(F.substring("digitable_line", 1, 3).alias("bank"), F.col("digitable_line").alias("v"), "id")
    return vote(t, "bank", "v", "id", "voted")


_SEP = "regexp_replace(doc_number, '[^0-9,.]', '', 'g')"
_FIX = "trim(regexp_replace(doc_number, 'R\\$', '', 'gi'))"
_TAXED = "regexp_extract(upper(raw_text), 'CNPJ[: ]*([0-9A-Z?./-]{14,20})', 1)"
_TAX14 = f"regexp_replace(translate(upper({_TAXED}), '{ids.CNPJ_READ_AS}', '{ids.CNPJ_MEANT}'), '[^0-9]', '', 'g')"


@query("misread_fields", f"""SELECT id, CASE WHEN doc_number IS NOT NULL THEN coalesce(CASE WHEN length(regexp_replace({_SEP}, '[0-9]', '', 'g')) >= 2 THEN try_cast(regexp_replace({_SEP}, '[,.]', '', 'g') AS BIGINT) ELSE trunc(try_cast(replace({_SEP}, ',', '.') AS DECIMAL(20,4)) * 100)::BIGINT END, 0) END AS cents,
CASE WHEN regexp_matches({_FIX}, '(?i)[OIDSZGL]') THEN translate({_FIX}, '{money.READ_AS}', '{money.MEANT}') ELSE {_FIX} END AS mended,
CASE WHEN length({_TAX14}) = 14 THEN regexp_replace({_TAX14}, '^(\\d{{2}})(\\d{{3}})(\\d{{3}})(\\d{{4}})(\\d{{2}})$', '\\1.\\2.\\3/\\4-\\5') END AS cnpj FROM documentos""")
def misread_fields(spark, d):
    """Amounts with any separators, letters read for figures put right, and company numbers put right."""
    tax = F.regexp_extract(F.upper("raw_text"), r"CNPJ[: ]*([0-9A-Z?./-]{14,20})", 1)
    return load(spark, d, "documentos").select("id", money.parse_separated(F.col("doc_number")).alias("cents"), money.fix_currency_text(F.col("doc_number")).alias("mended"), ids.fixed_cnpj(tax).alias("cnpj"))


@query("line_lengths", f"SELECT id, length(regexp_replace(digitable_line, '[^0-9]', '', 'g')) IN (44, 47, 48) AS line_ok, length(regexp_replace(barcode, '[^0-9]', '', 'g')) IN (44, 47, 48) AS code_ok FROM {TR}")
def line_lengths(spark, d):
    """Whether slip lines and bar codes have a length in use."""
    return distinct_trans(spark, d).select("id", ids.line_length_ok(F.col("digitable_line")).alias("line_ok"), ids.line_length_ok(F.col("barcode")).alias("code_ok"))
