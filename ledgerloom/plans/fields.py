"""Scores of matches, votes on fields and extraction of dates and entities."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import dates, ids, scores
from ..functions import similarity as S
from ..functions import text as X
from ..operators import graph
from .matching import BN, sides, view
from .reports import TR, distinct_trans, load
from .scalars import _iso, matched_names


@query("match_scores", f"""{BN}, p AS (SELECT b.id AS slip, n.id AS bill, b.v AS bv, n.v AS nv, date_diff('day', n.made, b.due) AS gap FROM b JOIN n ON b.s = n.s WHERE abs(b.v - n.v) <= 0.1 * b.v),
s AS (SELECT *, CASE WHEN abs(bv - nv) <= 5 THEN 1.0 WHEN abs(bv - nv) / bv <= 0.02 THEN 0.85 WHEN abs(bv - nv) / bv <= 0.05 THEN 0.7 WHEN abs(bv - nv) / bv <= 0.1 THEN 0.5 ELSE 0.0 END AS value, CASE WHEN gap IS NULL THEN 0.5 WHEN gap < 0 THEN 0.3 WHEN gap <= 45 THEN 1.0 WHEN gap <= 90 THEN 0.7 WHEN gap <= 180 THEN 0.5 ELSE 0.3 END AS day FROM p)
SELECT slip, bill, value::DOUBLE AS value, day::DOUBLE AS day, round(0.40 * value + 0.25 * day + 0.25 + 0.05, 3)::DOUBLE AS confidence FROM s""")
def match_scores(spark, d):
    b, n = sides(spark, d)
    from ..operators.ranges import ratio_join

    p = ratio_join(b, n, "b_v", "n_v", 11.2, [("b_s", "n_s")]).filter(F.abs(F.col("b_v") - F.col("n_v")) <= F.col("b_v") * 0.1)
    value, day = scores.value_score(F.col("b_v"), F.col("n_v")), scores.date_score(F.col("n_made"), F.col("b_due"))
    return p.select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), value.alias("value"), day.alias("day"), F.round(scores.confidence(value, day, F.lit(1.0)), 3).alias("confidence"))


@query("match_costs", f"""{BN}, p AS (SELECT b.id AS slip, n.id AS bill, date_diff('day', n.made, b.due) AS gap, b.tag AS bt, n.tag AS nt, b.s AS bs, n.s AS ns FROM b JOIN n ON substr(b.s, 1, 8) = substr(n.s, 1, 8) AND abs(b.v - n.v) * 100 <= 10 * least(b.v, n.v))
SELECT slip, bill, round(least(1.0, CASE WHEN gap IS NULL THEN 0.2 WHEN abs(gap) > 45 THEN 0.5 ELSE abs(gap) / 45.0 * 0.3 END + CASE WHEN bs = ns THEN 0 WHEN contains(bs, ns) OR contains(ns, bs) THEN 0.1 ELSE 0.3 END + CASE WHEN bt IS NOT NULL AND nt IS NOT NULL AND bt <> nt THEN 1 ELSE 0 END), 6)::DOUBLE AS cost FROM p""")
def match_costs(spark, d):
    b, n = sides(spark, d)
    from ..operators.ranges import ratio_join

    p = ratio_join(b.withColumn("p", F.substring("b_s", 1, 8)), n.withColumn("q", F.substring("n_s", 1, 8)), "b_v", "n_v", 10.0, [("p", "q")])
    return p.select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), F.round(scores.match_cost(F.col("n_made"), F.col("b_due"), F.col("b_s"), F.col("n_s"), F.col("b_tag"), F.col("n_tag")), 6).alias("cost"))


@query("match_costs_all")
def match_costs_all(spark, d):
    """Costs of all slips and bills within ten per cent, whatever and even without suppliers; tested against trying all pairs.

    Slips are split by a salt and bills repeated for each, as amounts have few bins.
    """
    b, n = sides(spark, d)
    from ..operators.ranges import ratio_join

    salts = 12
    b = b.withColumn("salt", F.pmod(F.xxhash64("b_id"), F.lit(salts)))
    n = n.withColumn("salt_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    p = ratio_join(b, n, "b_v", "n_v", 10.0, [("salt", "salt_n")])
    cost = scores.match_cost(F.col("n_made"), F.col("b_due"), F.col("b_s"), F.col("n_s"), F.col("b_tag"), F.col("n_tag"))
    return p.select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), F.round(cost, 6).alias("cost"))


@query("persist_pairs", """
WITH g AS (SELECT parent_doc_id AS doc, min(child_doc_id) AS island FROM matches WHERE confidence BETWEEN 0.9 AND 1 AND parent_doc_id IS NOT NULL AND child_doc_id IS NOT NULL GROUP BY 1),
     h AS (SELECT doc, min(doc) OVER (PARTITION BY island) AS head FROM g)
SELECT head AS parent_doc_id, doc AS child_doc_id, 'EXACT' AS match_type FROM h WHERE doc <> head""")
def persist_pairs(spark, d):
    """Members of an island as rows of the match table, each with the island's smallest member, so an island of n gives n - 1 rows; islands here are documents with one smallest partner."""
    m = load(spark, d, "matches").filter("confidence between 0.9 and 1 and parent_doc_id is not null and child_doc_id is not null")
    g = m.groupBy(F.col("parent_doc_id").alias("doc")).agg(F.min("child_doc_id").alias("island"))
    head = g.groupBy("island").agg(F.min("doc").alias("parent_doc_id"))
    return g.join(head, "island").filter("doc <> parent_doc_id").select("parent_doc_id", F.col("doc").alias("child_doc_id"), F.lit("EXACT").alias("match_type"))


_DAYS = ", ".join(f"{_iso(c)} AS {c}" for c in ("payment_date", "due_date", "emission_date"))


def dated(t):
    """Transactions with their three dates parsed: what is blank or no day is null."""
    return t.withColumns({c: dates.parse_date(F.col(c)) for c in ("payment_date", "due_date", "emission_date")})


@query("master_date_latest", f"SELECT link_id, arg_max(day, (prio, day)) AS master_date FROM (SELECT link_id, coalesce(payment_date, due_date, emission_date) AS day, CASE WHEN payment_date IS NOT NULL THEN 3 WHEN due_date IS NOT NULL THEN 2 ELSE 1 END AS prio FROM (SELECT link_id, {_DAYS} FROM {TR} WHERE link_id IS NOT NULL)) WHERE day IS NOT NULL GROUP BY link_id")
def master_date_latest(spark, d):
    """The last date of the best kind in each group: payment, then due, then emission."""
    t = dated(distinct_trans(spark, d, "link_id is not null")).select("link_id", F.coalesce("payment_date", "due_date", "emission_date").alias("day"), F.when(F.col("payment_date").isNotNull(), 3).when(F.col("due_date").isNotNull(), 2).otherwise(1).alias("prio")).filter("day is not null")
    return t.groupBy("link_id").agg(F.max(F.struct("prio", "day")).alias("m")).select("link_id", F.col("m.day").alias("master_date"))


@query("segment_primaries", f"SELECT lote_id, arg_min(amount_cents, doc_id) FILTER (amount_cents > 0) AS amount_cents, arg_min(coalesce(due_date, emission_date), doc_id) FILTER (coalesce(due_date, emission_date) IS NOT NULL) AS day FROM (SELECT d.lote_id, t.doc_id, min(t.id) AS id, arg_min(t.amount_cents, t.id) AS amount_cents, arg_min(t.due_date, t.id) FILTER (t.due_date IS NOT NULL) AS due_date, arg_min(t.emission_date, t.id) FILTER (t.emission_date IS NOT NULL) AS emission_date FROM (SELECT id, doc_id, amount_cents, {_DAYS} FROM {TR}) t JOIN documentos d ON d.id = t.doc_id GROUP BY 1, 2) GROUP BY lote_id")
def segment_primaries(spark, d):
    """First amount above zero and first date of each batch, by page."""
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), "lote_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    t = dated(distinct_trans(spark, d)).join(docs, "doc_id").groupBy("lote_id", "doc_id").agg(first("amount_cents"), first("due_date"), first("emission_date")).withColumn("day", F.coalesce("due_date", "emission_date"))
    return t.groupBy("lote_id").agg(F.min_by("amount_cents", F.when(F.col("amount_cents") > 0, F.col("doc_id"))).alias("amount_cents"), F.min_by("day", F.when(F.col("day").isNotNull(), F.col("doc_id"))).alias("day"))


@query("total_consistency", "SELECT l_orderkey, abs(sum(floor(l_extendedprice * 100)::BIGINT) - floor(o_totalprice * 100)::BIGINT) <= 100 AS consistent, sum(floor(l_extendedprice * 100)::BIGINT)::BIGINT AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice")
def total_consistency(spark, d):
    """Whether an order's items add up to its total."""
    cents = lambda c: F.floor(F.col(c) * 100).cast("bigint")
    s = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("items"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("t"))
    return s.join(o, "l_orderkey").select("l_orderkey", (F.abs(F.col("items") - F.col("t")) <= 100).alias("consistent"), "items")


@query("longest_reading", f"SELECT doc_id, arg_max(supplier_clean, (length(regexp_replace(supplier_clean, '[^\\p{{L}}\\p{{N}}]', '', 'g')), -id)) AS reading FROM {TR} WHERE supplier_clean IS NOT NULL GROUP BY doc_id")
def longest_reading(spark, d):
    """The reading with most letters and figures; ties go to the smallest id."""
    n = F.length(F.regexp_replace("supplier_clean", r"[^\p{L}\p{N}]", ""))
    return distinct_trans(spark, d, "supplier_clean is not null").groupBy("doc_id").agg(F.max_by("supplier_clean", F.struct(n, -F.col("id"))).alias("reading"))


@query("arbitration", f"""
SELECT t.id, CASE WHEN t.amount_cents = u.amount_cents THEN 'BOTH' WHEN t.amount_cents IS NULL OR t.amount_cents = 0 THEN 'INSTALLMENT' WHEN abs(t.amount_cents - u.amount_cents) <= 0.01 * u.amount_cents THEN 'SLIP' ELSE 'CONFLICT' END AS winner,
       CASE WHEN t.amount_cents = u.amount_cents THEN 1.0 WHEN t.amount_cents IS NULL OR t.amount_cents = 0 THEN 0.8 WHEN abs(t.amount_cents - u.amount_cents) <= 0.01 * u.amount_cents THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM {TR} t JOIN (SELECT DISTINCT * FROM duplicatas) u ON u.boleto_id = t.doc_id""")
def arbitration(spark, d):
    """Two readings of an amount compared: which wins and how surely."""
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).filter("boleto_id is not null").select(F.col("boleto_id").alias("doc_id"), F.col("amount_cents").alias("v"))
    w, c = scores.arbitrate_numbers(F.col("amount_cents"), F.col("v"), "SLIP", "INSTALLMENT")
    return distinct_trans(spark, d).join(u, "doc_id").select("id", w.alias("winner"), c.alias("confidence"))


@query("dates_extract", """
WITH u AS (SELECT id, upper(raw_text) AS t FROM documentos)
SELECT id, nullif(regexp_extract(t, 'VENCIMENTO[:\\s]*([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '') AS due, nullif(regexp_extract(t, 'EMISS[ÃA]O[:\\s]*([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '') AS emission, nullif(regexp_extract(t, '(?:PAGO EM|PAGAMENTO EM)\\s+([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '') AS payment FROM u""")
def dates_extract(spark, d):
    due, emission, payment = X.labelled_dates(F.col("raw_text"))
    return load(spark, d, "documentos").select("id", due.alias("due"), emission.alias("emission"), payment.alias("payment"))


@query("entity_lookup", """
WITH k AS (SELECT substr(regexp_replace(access_key, '[^0-9]', '', 'g'), 7, 14) AS cnpj, min(doc_number) AS label FROM documentos WHERE length(regexp_replace(access_key, '[^0-9]', '', 'g')) = 44 GROUP BY 1),
     x AS (SELECT DISTINCT id, regexp_replace(unnest(regexp_extract_all(raw_text, '[0-9]{2}\\.[0-9]{3}\\.[0-9]{3}/[0-9]{4}-[0-9]{2}')), '[^0-9]', '', 'g') AS cnpj FROM documentos)
SELECT x.id, x.cnpj, k.label FROM x LEFT JOIN k ON substr(k.cnpj, 1, 8) = substr(x.cnpj, 1, 8)""")
def entity_lookup(spark, d):
    """Company numbers in texts looked up by their first eight figures in a dimension of known ones."""
    docs = load(spark, d, "documentos")
    f = ids.key_fields(F.col("access_key"))
    k = docs.withColumn("f", f).filter("f is not null").groupBy(F.col("f.cnpj").alias("known")).agg(F.min("doc_number").alias("label"))
    x = docs.select("id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"), F.lit(0))).alias("c")).select("id", ids.digits_only(F.col("c")).alias("cnpj")).distinct()
    return x.join(k, F.substring("known", 1, 8) == F.substring("cnpj", 1, 8), "left").select("id", "cnpj", "label")


@query("cross_validation")
def cross_validation(spark, d):
    """Names on matched documents: approved, doubtful or rejected by their word sets; the ratio is tested on literal rows."""
    p = matched_names(spark, d)
    r = S.pair_udf(S.token_set_ratio)(S.normalise_company(F.col("a")), S.normalise_company(F.col("b")))
    return p.withColumn("ratio", F.round(r, 6)).withColumn("verdict", F.when(F.col("ratio") >= 0.8, "APPROVED").when(F.col("ratio") >= 0.6, "WARNING").otherwise("REJECTED"))


@query("exploded_installments", f"SELECT u.nfe_id, u.id, round(100.0 * u.amount_cents / sum(u.amount_cents) OVER (PARTITION BY u.nfe_id), 4)::DOUBLE AS pct, u.seq_num = max(u.seq_num) OVER (PARTITION BY u.nfe_id) AS last FROM (SELECT DISTINCT * FROM duplicatas) u")
def exploded_installments(spark, d):
    w = Window.partitionBy("nfe_id")
    u = load(spark, d, "duplicatas").dropDuplicates(["id"])
    return u.select("nfe_id", "id", F.round(100.0 * F.col("amount_cents") / F.sum("amount_cents").over(w), 4).alias("pct"), (F.col("seq_num") == F.max("seq_num").over(w)).alias("last"))


@query("fraction_match", f"{BN}, tot AS (SELECT n.id AS bill, n.s, n.v, unnest([2, 3, 4, 5, 6, 10, 12]) AS parts FROM n) SELECT tot.bill, b.id AS slip, tot.parts FROM tot JOIN b ON b.s = tot.s AND abs(b.v - tot.v // tot.parts) <= 50")
def fraction_match(spark, d):
    """Slips near an equal fraction of a bill."""
    from ..operators.ranges import tolerance_join

    b, n = sides(spark, d)
    f = n.withColumn("parts", F.explode(F.array(*[F.lit(x) for x in (2, 3, 4, 5, 6, 10, 12)]))).withColumn("part_v", F.floor(F.col("n_v") / F.col("parts")).cast("bigint"))
    return tolerance_join(b, f, "b_v", "part_v", 50, [("b_s", "n_s")]).select(F.col("n_id").alias("bill"), F.col("b_id").alias("slip"), "parts")


@query("flow_totals")
def flow_totals(spark, d):
    """Payments and all other papers of their supplier joined by flow: each pair carries what both have left, dearest pairs last, unless both name different entities; capacities are tested."""
    x = view(spark, d)
    p, n = x.filter("k = 'COMPROVANTE'"), x.filter("k is null or k <> 'COMPROVANTE'")
    return graph.supplier_flow(p.withColumn("day", F.col("due")), n.withColumn("day", F.col("made")))


@query("flow_optimum")
def flow_optimum(spark, d):
    """Profit of the greedy flow of each supplier and of the best flow, where its pairs are few enough; the best flow is tested against trying all."""
    x = view(spark, d)
    p, n = x.filter("k = 'COMPROVANTE'"), x.filter("k is null or k <> 'COMPROVANTE'")
    return graph.flow_gap(p.withColumn("day", F.col("due")), n.withColumn("day", F.col("made")))
