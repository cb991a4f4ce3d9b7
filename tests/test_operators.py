"""Operators against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dictionary, graph, layout, ranges, subsets, tables, voting


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tolerance_and_ratio_joins(spark):
    r = random.Random(3)
    a, b = [(i, r.choice("xy"), r.randrange(1, 400)) for i in range(60)], [(i, r.choice("xy"), r.randrange(1, 400)) for i in range(60)]
    x, y = spark.createDataFrame(a, "i long, k string, u long"), spark.createDataFrame(b, "j long, l string, v long")
    assert rows(ranges.tolerance_join(x, y, "u", "v", 5, [("k", "l")]).select("i", "j")) == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and abs(p[2] - q[2]) <= 5)
    assert rows(ranges.ratio_join(x, y, "u", "v", 7).select("i", "j")) == sorted((p[0], q[0]) for p in a for q in b if abs(p[2] - q[2]) * 100 <= 7 * min(p[2], q[2]))


def test_interval_and_null_tolerant_joins(spark):
    a = spark.createDataFrame([(i, f"2024-01-{i:02d}", "t" if i % 2 else None) for i in range(1, 29)], "i long, d string, t string").withColumn("d", F.to_date("d")).withColumn("k", F.lit(1))
    b = spark.createDataFrame([(j, f"2024-01-{j:02d}", "u" if j % 3 else None) for j in range(1, 29)], "j long, e string, u string").withColumn("e", F.to_date("e")).withColumn("l", F.lit(1))
    got = rows(ranges.interval_join(a, b, "d", F.date_sub("e", 3), F.date_add("e", 2), 4).select("i", "j"))
    assert got == sorted((i, j) for i in range(1, 29) for j in range(1, 29) if j - 3 <= i <= j + 2)
    assert ranges.null_tolerant_join(a, b, "t", "u", ("k", "l")).count() == 14 * 28 + 14 * 9
    assert ranges.interval_join(a.limit(0), b, "d", F.col("e"), F.col("e")).count() == 0


def test_components(spark):
    r = random.Random(4)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (None, 3)]
    lab = {}
    find = lambda v: v if lab.setdefault(v, v) == v else find(lab[v])
    for a, b in e:
        if a is not None:
            p, q = find(a), find(b)
            lab[max(p, q)] = min(p, q)
    got = graph.components(spark.createDataFrame(e, "src long, dst long"))
    assert rows(got) == sorted((v, find(v)) for v in lab)
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_greedy_pairs(spark):
    r = random.Random(5)
    p = [(a, b, r.randrange(6)) for a in range(12) for b in range(12) if r.random() < 0.4]
    used, want = set(), []
    for a, b, d in sorted(p, key=lambda x: (x[2], x[0], x[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.append((a, b, d))
    assert rows(graph.greedy_pairs(spark.createDataFrame(p, "a long, b long, d long"), "a", "b", F.col("d"), F.col("a"), F.col("b"))) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_auction_is_optimal(spark, seed):
    r = random.Random(seed)
    p = {(a, b): r.randrange(1, 20) for a in range(5) for b in range(5) if r.random() < 0.6}
    best = 0
    for n in range(1, 6):
        for xs in itertools.combinations(range(5), n):
            for ys in itertools.permutations(range(5), n):
                best = max(best, sum(p[x, y] for x, y in zip(xs, ys) if (x, y) in p))
    got = graph.auction_assignment(spark.createDataFrame([(a, b, g) for (a, b), g in p.items()], "a long, b long, g long"), "a", "b", "g").collect()
    assert sum(x["g"] for x in got) == best and len({x["a"] for x in got}) == len(got) == len({x["b"] for x in got})


def test_subset_of():
    r = random.Random(6)
    for _ in range(150):
        v, t = [r.randrange(30) for _ in range(r.randrange(9))], r.randrange(60)
        want = [c for n in range(1, 5) for c in itertools.combinations(range(len(v)), n) if abs(sum(v[i] for i in c) - t) <= 2]
        assert subsets.subset_of(v, t, 2, 4, first=False) == want
        assert subsets.subset_of(v, t, 2, 4) == want[:1]


def test_subset_matches(spark):
    t, i = spark.createDataFrame([(1, "k", 100), (2, "k", 999), (3, None, 5)], "t long, k string, v long"), spark.createDataFrame([(1, "k", 60), (2, "k", 41), (3, "k", 7), (4, "m", 100)], "i long, k string, w long")
    got = subsets.subset_matches(t, i, "k", "v", "w", "t", "i", 5, 3).collect()
    assert [(x["t"], x["parts"], x["total"]) for x in got] == [(1, [1, 2], 101)]


def test_tables(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, h string")
    old = spark.createDataFrame([(9, "b"), (8, None)], "id long, h string")
    assert rows(tables.ingest_new(new, old, "h", "id").select("id")) == [(1,), (4,), (5,)]
    names = spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "y"), (4, "x.pdf")], "id long, n string")
    assert [r[1] for r in rows(tables.collision_names(names, "n", "id", "o").select("id", "o"))] == ["x.pdf", "x (1).pdf", "y", "x (2).pdf"]
    up = tables.upsert(spark.createDataFrame([(1, 10, "a")], "id long, v long, d string"), spark.createDataFrame([(1, 0, None), (2, 5, "b")], "id long, v long, d string"), "id", ["v"], ["d"])
    assert rows(up) == [(1, 10, "a"), (2, 5, "b")]


def test_weighted_vote(spark):
    c = [("p", 1, "ACME PNEUS", 0.9), ("p", 2, "ACME PNEU", 0.8), ("p", 3, "OTHER", 0.95), ("q", 4, None, 0.9), ("q", 5, "SOLO", 0.6)]
    got = voting.weighted_vote(spark.createDataFrame(c, "k string, id long, v string, c double").withColumn("w", F.lit(1.0)), ["k"], "v", "c", "w", "id").collect()
    by = {r["k"]: r for r in got}
    assert by["p"]["v"] == "ACME PNEUS" and round(by["p"]["score"], 6) == round(1.7 * 1.2, 6) and by["q"]["v"] == "SOLO" and by["q"]["votes"] == 1


def test_dictionary(spark):
    known = spark.createDataFrame([("ACME TRATORES", "ACME", 1), ("BETA PNEUS", "BETA", 2)], "name string, canonical string, ord int")
    names = spark.createDataFrame([("acme tratores",), ("ACME TRATORE",), ("PNEUS BETA SA",), ("BTEA PNUES",), ("ZZZ",), (None,), ("",)], "n string")
    got = {r["name"]: (r["canonical"], r["tier"]) for r in dictionary.match_names(names, known, "n").collect()}
    assert got == {"ACME TRATORES": ("ACME", 1), "ACME TRATORE": ("ACME", 2), "PNEUS BETA SA": ("BETA", 3), "BTEA PNUES": ("BETA", 4)}


def test_layout(spark):
    w = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 10.0, "Valor", 0, 0), (1, 60.0, 0.0, 90.0, 10.0, "do", 0, 1), (1, 100.0, 1.0, 150.0, 9.0, "10,00", 0, 2), (1, 0.0, 20.0, 50.0, 30.0, "abaixo", 1, 3)], "doc_id long, x0 double, y0 double, x1 double, y1 double, text string, block int, word int")
    assert rows(layout.value_near(w, "valor do", "right")) == [(1, "10,00")]
    assert rows(layout.value_near(w, "valor do", "below", 40)) == [(1, "abaixo")]
    assert len(rows(layout.anchored_lines(w))) == len(rows(layout.gapped_lines(w))) == 2
    assert layout.value_near(w.limit(0), "x", "right").count() == 0


def test_greedy_flow(spark):
    r = random.Random(8)
    ca, cb = {a: r.randrange(5, 30) for a in range(6)}, {b: r.randrange(5, 30) for b in range(6)}
    p = [(a, b, ca[a], cb[b], r.randrange(5)) for a in ca for b in cb if r.random() < 0.6]
    got = graph.greedy_flow(spark.createDataFrame(p, "a long, b long, cap_a long, cap_b long, cost long"), "a", "b").collect()
    la, lb, open_, want = dict(ca), dict(cb), {(a, b): c for a, b, _, _, c in p}, {}
    while True:
        best = min(((c, -min(la[a], lb[b]), a, b) for (a, b), c in open_.items() if la[a] and lb[b]), default=None)
        if best is None:
            break
        _, f, a, b = best
        want[a, b] = -f
        la[a] += f
        lb[b] += f
        del open_[a, b]
    assert {(x["a"], x["b"]): x["flow"] for x in got} == want


def test_scores(spark):
    from ledgerloom.functions import scores

    df = spark.createDataFrame([(100, 100), (1000, 1015), (0, 5), (1000, 2000)], "a long, b long")
    assert [x[0] for x in df.select(scores.value_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.85, 0.0, 0.0]


def test_supplier_flow(spark):
    """All pairs of a supplier, against the plain loop over them."""
    import datetime

    from ledgerloom.functions import scores

    random.seed(5)
    day = lambda: random.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=random.choice([random.randrange(70), random.randrange(200)]))])
    side = lambda n, at: [(at + i, f"s{i % 4}" if i % 13 else None, random.choice([5, 40, 40, 900, random.randrange(1, 500)]), day(), random.choice([None, "VG", "MV"])) for i in range(n)]
    a, b = side(90, 0), side(120, 1000)
    schema = "id long, s string, v long, day date, tag string"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = graph.supplier_flow(x, y).collect()
    cost = F.floor(scores.match_cost(F.col("n_day"), F.col("p_day"), F.col("p_s"), F.col("n_s"), F.col("p_tag"), F.col("n_tag")) * 100)
    j = x.toDF(*[f"p_{c}" for c in x.columns]).join(y.toDF(*[f"n_{c}" for c in y.columns]), F.col("p_s") == F.col("n_s")).filter("p_tag is null or n_tag is null or p_tag = n_tag")
    pairs = [tuple(r) for r in j.select("p_id", "n_id", cost.cast("long")).collect()]
    ca, cb, want = {r[0]: r[2] for r in a}, {r[0]: r[2] for r in b}, {}
    while pairs := [p for p in pairs if ca[p[0]] > 0 and cb[p[1]] > 0]:
        p, n, _ = min(pairs, key=lambda q: (q[2], -min(ca[q[0]], cb[q[1]]), q[0], q[1]))
        f = want[p, n] = min(ca[p], cb[n])
        ca[p] -= f
        cb[n] -= f
    assert {(r["payment"], r["bill"]): r["flow"] for r in got} == want


def test_flow_totals_pays_small_bills(spark, tmp_path, monkeypatch):
    """One payment covers a bill, a slip and an unknown paper far below its amount; other entities stay out."""
    import datetime

    from ledgerloom.plans import fields

    d = datetime.date(2024, 1, 1)
    rows = [(1, "COMPROVANTE", 1000, "VG"), (2, "NFE", 100, "VG"), (3, "BOLETO", 200, None), (4, "UNKNOWN", 300, "VG"), (5, "NFSE", 400, "MV")]
    x = spark.createDataFrame([(i, i, "S", v, k, t, d, d, None) for i, k, v, t in rows], "id long, doc_id long, s string, v long, k string, tag string, due date, made date, line string")
    monkeypatch.setattr(fields, "view", lambda *_: x)
    got = {(r["payment"], r["bill"]): r["flow"] for r in fields.flow_totals(spark, "").collect()}
    assert got == {(1, 2): 100, (1, 3): 200, (1, 4): 300}


def test_first_of():
    import numpy as np

    random.seed(8)
    for n, top in [(9, 60), (9, 400), (12, 3000), (7, 20)] * 12:
        v = [random.randrange(-3, top) for _ in range(n)]
        target = random.randrange(3 * top)
        for r in range(1, 6):
            want = next((list(c) for c in itertools.combinations(range(n), r) if abs(sum(v[i] for i in c) - target) <= 2), None)
            assert subsets.first_of(np.array(v), target, 2, r) == want


def test_subset_sums_takes_five_of_all_slips(spark, monkeypatch):
    """Five slips, and slips farther from the bill than fifty others; sums of the others miss it."""
    from ledgerloom.plans import matching

    slips = [("far", 900_000 + 1000 * i) for i in range(60)] + [("far", 1_007), ("far", 2_014), ("far", 4_028)] + [("five", 10_001), ("five", 20_010), ("five", 40_100), ("five", 81_000), ("five", 170_000)]
    bills = [("far", 7_049), ("five", 321_111), ("five", 500_000), ("none", 5)]
    rows = [(i, s, v, "BOLETO") for i, (s, v) in enumerate(slips)] + [(100 + i, s, v, "NFE") for i, (s, v) in enumerate(bills)]
    x = spark.createDataFrame(rows, "id long, s string, v long, k string")
    monkeypatch.setattr(matching, "view", lambda *_: x)
    got = {r["bill"]: (r["slips"], r["total"]) for r in matching.subset_sums(spark, "").collect()}
    assert got == {100: ("60,61,62", 7_049), 101: ("63,64,65,66,67", 321_111)}
    # sixty slips lie nearer to a dearer bill than two of its parts
    dear = spark.createDataFrame([*rows, (200, "far", 3 * 900_000 + 3000 + 1_007 + 2_014, "NFE")], x.schema)
    monkeypatch.setattr(matching, "view", lambda *_: dear)
    got = {r["bill"]: r["total"] for r in matching.subset_sums(spark, "").collect()}
    assert got[200] == 3 * 900_000 + 3000 + 1_007 + 2_014


def test_match_costs_all(spark, monkeypatch):
    """Every pair within ten per cent: unlike first words, a contained name, a missing name, different entities."""
    import datetime

    from ledgerloom.plans import fields

    random.seed(9)
    names = ["ALFA COMERCIO LTDA", "COMERCIAL ALFA COMERCIO LTDA", "ALFA", None, "BETA S/A"]
    day = lambda: random.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=random.randrange(90))])
    side = lambda n: [(i, random.choice(names), random.choice([100, 109, 110, 111, 5000, random.randrange(90, 130)]), day(), day(), random.choice([None, "VG", "MV"])) for i in range(n)]
    a, b = side(60), side(50)
    schema = "id long, s string, v long, due date, made date, tag string"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    monkeypatch.setattr(fields, "sides", lambda *_: (x.toDF(*[f"b_{c}" for c in x.columns]), y.toDF(*[f"n_{c}" for c in y.columns])))
    got = [(r["slip"], r["bill"], r["cost"]) for r in fields.match_costs_all(spark, "").collect()]
    want = []
    for i, s, v, due, _, tag in a:
        for j, s2, v2, _, made, tag2 in b:
            if abs(v - v2) * 100 <= 10 * min(v, v2):
                gap = abs((due - made).days) if due and made else None
                cost = 0.2 if gap is None else 0.5 if gap > 45 else gap / 45 * 0.3
                cost += 0 if s is None or s2 is None or s == s2 else 0.1 if s in s2 or s2 in s else 0.3
                want.append((i, j, round(min(1.0, cost + (tag is not None and tag2 is not None and tag != tag2)), 6)))
    assert len(got) == len(want) and {x[:2]: pytest.approx(x[2], abs=2e-6) for x in want} == {x[:2]: x[2] for x in got}
