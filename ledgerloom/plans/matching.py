"""Tolerance joins, graph edges, components, subset sums and assignment over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..functions import similarity as S
from ..operators import graph, ranges, subsets, voting
from .reports import TR, distinct_trans, load
from .scalars import _iso

VIEW = f"x AS (SELECT t.id, t.doc_id, upper(trim(t.supplier_clean)) AS s, t.amount_cents AS v, d.doc_type AS k, d.entity_tag AS tag, {_iso('t.due_date')} AS due, {_iso('t.emission_date')} AS made, t.digitable_line AS line FROM {TR} t JOIN documentos d ON d.id = t.doc_id WHERE t.amount_cents > 0)"
SLIP, BILL = "k = 'BOLETO'", "k IN ('NFE', 'NFSE')"


def view(spark, d):
    docs = load(spark, d, "documentos").select(F.col("id").alias("doc_id"), F.col("doc_type").alias("k"), F.col("entity_tag").alias("tag"))
    t = distinct_trans(spark, d, "amount_cents > 0")
    return t.join(docs, "doc_id").select("id", "doc_id", F.upper(F.trim("supplier_clean")).alias("s"), F.col("amount_cents").alias("v"), "k", "tag", dates.parse_date(F.col("due_date")).alias("due"), dates.parse_date(F.col("emission_date")).alias("made"), F.col("digitable_line").alias("line"))


def sides(spark, d):
    """Slips with prefix b, bills with prefix n."""
    x = view(spark, d)
    return x.filter(SLIP).toDF(*[f"b_{c}" for c in x.columns]), x.filter(BILL).toDF(*[f"n_{c}" for c in x.columns])


BN = f"WITH {VIEW}, b AS (SELECT * FROM x WHERE {SLIP}), n AS (SELECT * FROM x WHERE {BILL})"


@query("match_one_to_one", f"{BN} SELECT b.id AS slip, n.id AS bill, abs(b.v - n.v) AS diff FROM b JOIN n ON b.s = n.s AND abs(b.v - n.v) <= 5")
def match_one_to_one(spark, d):
    b, n = sides(spark, d)
    return ranges.tolerance_join(b, n, "b_v", "n_v", 5, [("b_s", "n_s")]).select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), F.abs(F.col("b_v") - F.col("n_v")).alias("diff"))


@query("match_two_to_one", f"{BN} SELECT n.id AS bill, b1.id AS i1, b2.id AS i2, b1.v + b2.v AS total FROM n JOIN b b1 ON b1.s = n.s JOIN b b2 ON b2.s = n.s AND b1.id < b2.id WHERE abs(n.v - b1.v - b2.v) <= 5")
def match_two_to_one(spark, d):
    """Bills paid by two slips of the same supplier."""
    x = view(spark, d).filter("s is not null")
    return subsets.pair_sums(x.filter(BILL), x.filter(SLIP), "s", "v", "v", "id", "id", 5).withColumnRenamed("id", "bill")


@query("subset_sums")
def subset_sums(spark, d):
    """Bills with the first set of up to five of all their supplier's slips that adds up to them; tested against trying all sets."""
    x = view(spark, d).filter("s is not null")
    return subsets.first_sets(x.filter(BILL), x.filter(SLIP), "s", "v", "v", "id", "id", 5, 5).select(F.col("id").alias("bill"), F.array_join(F.transform("parts", lambda i: i.cast("string")), ",").alias("slips"), "total")


@query("group_candidates", f"{BN} SELECT n.id AS bill, b.id AS slip, abs(b.v - n.v) AS diff FROM n JOIN b ON b.s = n.s AND abs(b.v - n.v) <= greatest(100, floor(n.v * 0.05))")
def group_candidates(spark, d):
    """Tolerance that grows with the amount: five per cent, at least one unit; small amounts by width, others by ratio."""
    b, n = sides(spark, d)
    small = ranges.tolerance_join(b, n.filter("n_v < 2000"), "b_v", "n_v", 100, [("b_s", "n_s")])
    large = ranges.ratio_join(b, n.filter("n_v >= 2000"), "b_v", "n_v", 5.3, [("b_s", "n_s")])
    tol = F.greatest(F.lit(100), F.floor(F.col("n_v") * 0.05))
    return small.unionByName(large).filter(F.abs(F.col("b_v") - F.col("n_v")) <= tol).select(F.col("n_id").alias("bill"), F.col("b_id").alias("slip"), F.abs(F.col("b_v") - F.col("n_v")).alias("diff"))


@query("interval_candidates", f"{BN} SELECT b.id AS slip, n.id AS bill FROM b JOIN n ON b.s = n.s AND (n.made IS NULL OR n.made BETWEEN b.due - 45 AND b.due + 15)")
def interval_candidates(spark, d):
    """Slips and bills of one supplier, the bill made up to 45 days before or 15 after the due date; a bill without a date is not excluded."""
    b, n = sides(spark, d)
    dated = ranges.interval_join(n, b, "n_made", F.date_sub("b_due", 45), F.date_add("b_due", 15), 30, [("n_s", "b_s")])
    undated = n.filter("n_made is null").join(b, F.col("n_s") == F.col("b_s"))
    return dated.select("b_id", "n_id").unionByName(undated.select("b_id", "n_id")).select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"))


@query("entity_tolerant", f"{BN} SELECT b.id AS slip, n.id AS bill FROM b JOIN n ON b.s = n.s AND b.made = n.made WHERE b.tag IS NULL OR n.tag IS NULL OR b.tag = n.tag")
def entity_tolerant(spark, d):
    """Slips and bills of one supplier and emission date unless both name different entities."""
    b, n = sides(spark, d)
    b, n = b.withColumn("kb", F.concat("b_s", F.lit("|"), F.col("b_made").cast("string"))), n.withColumn("kn", F.concat("n_s", F.lit("|"), F.col("n_made").cast("string")))
    return ranges.null_tolerant_join(b, n, "b_tag", "n_tag", ("kb", "kn")).select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"))


@query("installment_match", f"WITH {VIEW}, b AS (SELECT * FROM x WHERE {SLIP}) SELECT u.id AS installment, b.id AS slip FROM (SELECT DISTINCT * FROM duplicatas) u JOIN {TR} t ON t.doc_id = u.nfe_id JOIN b ON b.s = upper(trim(t.supplier_clean)) AND abs(u.amount_cents - b.v) <= 5 GROUP BY ALL")
def installment_match(spark, d):
    b, _ = sides(spark, d)
    t = distinct_trans(spark, d).select(F.col("doc_id").alias("nfe_id"), F.upper(F.trim("supplier_clean")).alias("u_s"))
    u = load(spark, d, "duplicatas").dropDuplicates(["id"]).join(t, "nfe_id").select(F.col("id").alias("installment"), F.col("amount_cents").alias("u_v"), "u_s").distinct()
    return ranges.tolerance_join(b, u, "b_v", "u_v", 5, [("b_s", "u_s")]).select("installment", F.col("b_id").alias("slip")).distinct()


def edges(spark, d):
    """Edges of all rules: (src, dst, weight, reason, priority)."""
    x = view(spark, d)
    a, b = x.select(F.col("id").alias("src"), F.col("k").alias("ka"), F.col("v").alias("va"), F.col("s").alias("sa"), F.col("line").alias("la")), x.select(F.col("id").alias("dst"), F.col("k").alias("kb"), F.col("v").alias("vb"), F.col("s").alias("sb"), F.col("line").alias("lb"))
    tag = lambda e, w, r, p: e.select("src", "dst", F.lit(w).alias("weight"), F.lit(r).alias("reason"), F.lit(p).alias("priority"))
    value = ranges.tolerance_join(a, b, "va", "vb", 5, [("sa", "sb")]).filter("src < dst and ka <> kb")
    near = ranges.ratio_join(a, b, "va", "vb", 2.0, [("sa", "sb")]).filter("src < dst and ka <> kb and abs(va - vb) > 5")
    line = a.withColumn("p", F.substring("la", 1, 20)).join(b.withColumn("q", F.substring("lb", 1, 20)), (F.col("p") == F.col("q")) & (F.col("src") < F.col("dst")))
    return tag(value, 0.8, "value_exact", 1).unionByName(tag(near, 0.5, "value_near", 1)).unionByName(tag(line, 1.0, "barcode", 2))


EDGES = f"""WITH RECURSIVE {VIEW}, p AS (SELECT a.id AS src, b.id AS dst, a.v AS va, b.v AS vb FROM x a JOIN x b ON a.s = b.s AND a.id < b.id AND a.k <> b.k),
e AS (SELECT src, dst, 0.8 AS weight, 'value_exact' AS reason, 1 AS priority FROM p WHERE abs(va - vb) <= 5
  UNION ALL SELECT src, dst, 0.5, 'value_near', 1 FROM p WHERE abs(va - vb) > 5 AND (greatest(va, vb) - least(va, vb)) * 100 <= 2 * least(va, vb)
  UNION ALL SELECT a.id, b.id, 1.0, 'barcode', 2 FROM x a JOIN x b ON substr(a.line, 1, 20) = substr(b.line, 1, 20) AND a.id < b.id),
g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY priority, weight DESC, reason) = 1)"""


@query("edges_best", f"{EDGES} SELECT src, dst, weight::DOUBLE AS weight, reason FROM g")
def edges_best(spark, d):
    return graph.best_edges(edges(spark, d)).select("src", "dst", F.col("weight").cast("double"), "reason")


@query("edges_summary", f"{EDGES} SELECT reason, count(*) AS n, count(DISTINCT src) AS sources FROM g GROUP BY reason")
def edges_summary(spark, d):
    return graph.best_edges(edges(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("components", f"""{EDGES}, ends AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), lab(v, l) USING KEY (v) AS (
  SELECT a, min(least(a, b)) FROM ends GROUP BY a
  UNION SELECT b.b AS v, min(s.l) AS l FROM lab s JOIN ends b ON b.a = s.v JOIN recurring.lab r ON r.v = b.b WHERE s.l < r.l GROUP BY b.b)
SELECT v AS id, l AS component FROM lab""")
def components(spark, d):
    return graph.components(graph.best_edges(edges(spark, d)))


@query("island_composition", f"""{EDGES}, ends AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), lab(v, l) USING KEY (v) AS (
  SELECT a, min(least(a, b)) FROM ends GROUP BY a
  UNION SELECT b.b AS v, min(s.l) AS l FROM lab s JOIN ends b ON b.a = s.v JOIN recurring.lab r ON r.v = b.b WHERE s.l < r.l GROUP BY b.b),
m AS (SELECT l, count(*) AS members, count(*) FILTER ({BILL}) AS bills, count(*) FILTER ({SLIP}) AS slips FROM lab JOIN x ON x.id = lab.v GROUP BY l),
w AS (SELECT lab.l, round(avg(g.weight), 6)::DOUBLE AS confidence FROM g JOIN lab ON lab.v = g.src GROUP BY 1)
SELECT m.l AS component, members, bills, slips, bills > 0 AND slips > 0 AS complete, coalesce(confidence, 0) AS confidence FROM m LEFT JOIN w USING (l)""")
def island_composition(spark, d):
    """Members by kind, completeness and mean edge weight of every component."""
    from ..session import cut

    g = cut(graph.best_edges(edges(spark, d)))
    lab = cut(graph.components(g))
    m = lab.join(view(spark, d).select("id", "k"), "id").groupBy("component").agg(F.count("*").alias("members"), F.count_if(F.col("k").isin("NFE", "NFSE")).alias("bills"), F.count_if(F.col("k") == "BOLETO").alias("slips"))
    w = g.join(lab.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.round(F.avg("weight"), 6).alias("confidence"))
    return m.join(w, "component", "left").select("component", "members", "bills", "slips", ((F.col("bills") > 0) & (F.col("slips") > 0)).alias("complete"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("greedy_allocation")
def greedy_allocation(spark, d):
    """Slips and bills of a supplier paired by smallest difference, each once; tested against the sequential loop."""
    b, n = sides(spark, d)
    p = ranges.ratio_join(b, n, "b_v", "n_v", 10.0, [("b_s", "n_s")]).select(F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), F.abs(F.col("b_v") - F.col("n_v")).alias("diff"))
    return graph.greedy_pairs(p, "slip", "bill", F.col("diff"), F.col("slip"), F.col("bill"))


@query("assignment")
def assignment(spark, d):
    """Slips and bills of a supplier paired with the largest total gain; tested against trying all assignments."""
    b, n = sides(spark, d)
    p = ranges.ratio_join(b, n, "b_v", "n_v", 2.0, [("b_s", "n_s")])  # joined by supplier, so no component crosses one
    gain = F.lit(100) - F.floor(F.abs(F.col("b_v") - F.col("n_v")) * 1000 / F.least("b_v", "n_v")).cast("bigint")
    return graph.assignment(p.select(F.col("b_s").alias("s"), F.col("b_id").alias("slip"), F.col("n_id").alias("bill"), gain.alias("gain")).filter("gain > 0"), "slip", "bill", "gain", "s")


@query("vote_supplier")
def vote_supplier(spark, d):
    """Supplier of each numbered document by weighted vote among its readings; tested against a plain loop."""
    docs = load(spark, d, "documentos").filter("access_key is not null").select(F.col("id").alias("doc_id"), F.regexp_replace("access_key", r"\D", "").alias("paper"))
    t = distinct_trans(spark, d, "supplier_clean is not null").join(docs, "doc_id")
    c = t.select("paper", F.upper("supplier_clean").alias("value"), F.when(F.col("is_scheduled") == 1, 0.5).otherwise(0.9).alias("confidence"), F.lit(1.0).alias("weight"), "id")
    return voting.weighted_vote(c, ["paper"], "value", "confidence", "weight", "id").withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))


@query("divergence", f"""
WITH c AS (SELECT regexp_replace(d.access_key, '[^0-9]', '', 'g') AS paper, upper(t.supplier_clean) AS v, count(*) AS n FROM {TR} t JOIN documentos d ON d.id = t.doc_id WHERE d.access_key IS NOT NULL AND t.supplier_clean IS NOT NULL GROUP BY 1, 2),
     s AS (SELECT paper, sum(n)::BIGINT AS readings, sum(n * (n - 1) / 2) AS same FROM c GROUP BY 1)
SELECT paper, readings, round(CASE WHEN readings > 1 THEN same / (readings * (readings - 1) / 2) ELSE 1 END, 6)::DOUBLE AS agreement, CASE WHEN readings > 1 THEN same / (readings * (readings - 1) / 2) ELSE 1 END < 0.6 AS diverges FROM s""")
def divergence(spark, d):
    docs = load(spark, d, "documentos").filter("access_key is not null").select(F.col("id").alias("doc_id"), F.regexp_replace("access_key", r"\D", "").alias("paper"))
    t = distinct_trans(spark, d, "supplier_clean is not null").join(docs, "doc_id").select("paper", F.upper("supplier_clean").alias("v"))
    return voting.divergence(t, ["paper"], "v")


@query("fuzzy_names")
def fuzzy_names(spark, d):
    """Distinct pairs of suppliers on matched documents that match loosely."""
    from .scalars import matched_names

    return matched_names(spark, d).withColumn("same", S.fuzzy_match(F.col("a"), F.col("b")))
