"""Operators where many rows contend for few: they must end in few jobs and give the results of plain loops."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.operators import alike, dictionary, graph, ranges, subsets
from ledgerloom.plans import reconcile


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def few_jobs(monkeypatch):
    """Fails an operator of the graph module that writes more than 60 intermediate tables."""
    n, cut = [0], graph.cut

    def counted(*a, **k):
        n[0] += 1
        assert n[0] <= 60, "too many rounds"
        return cut(*a, **k)

    monkeypatch.setattr(graph, "cut", counted)


def test_assignment_of_contested_bills(spark, few_jobs):
    """Forty slips want the same twenty bills; prices bid up by one took thousands of rounds."""
    r = random.Random(9)
    p = {(a, 1000 + b): 80 + r.randrange(20) for a in range(40) for b in range(20)}
    got = rows(graph.assignment(spark.createDataFrame([(a, b, g) for (a, b), g in p.items()], "a long, b long, g long"), "a", "b", "g"))
    assert len(got) == len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == 20
    assert all(p[a, b] == g for a, b, g in got)
    # no exchange along a path of changed pairs gains anything: no positive cycle among bills and free slips
    mine = {b: a for a, b, _ in got}
    free = [a for a in range(40) if a not in mine.values()]
    nodes = [*mine, None]  # None: the free slips
    worth = lambda a, b: p[a, b]
    gain = {(x, y): (max(worth(a, y) for a in free) if x is None else worth(mine[x], y)) - worth(mine[y], y) for x in nodes for y in mine if x != y} | {(x, None): 0 for x in mine}
    dist = dict.fromkeys(nodes, 0)
    for _ in nodes:
        dist = {y: max(dist[y], *(dist[x] + gain[x, y] for x in nodes if (x, y) in gain)) for y in nodes}
    assert all(dist[y] >= dist[x] + gain[x, y] for x, y in gain)


def test_assignment_of_named_sides_and_groups(spark):
    p = [("g", "a", "x", 5), ("g", "b", "x", 9), ("g", "b", "y", 5), ("h", "x", "a", 2)]
    d = spark.createDataFrame(p, "k string, a string, b string, g long")
    assert rows(graph.assignment(d, "a", "b", "g")) == rows(graph.assignment(d, "a", "b", "g", "k")) == [("a", "x", 5), ("b", "y", 5), ("x", "a", 2)]
    assert graph.assignment(d.limit(0), "a", "b", "g").count() == 0


def made_names(n, seed):
    r = random.Random(seed)
    syllables = ["VEL", "BOF", "RES", "PLO", "DRA", "TRAN", "SEM", "ÇÃO", "LTDA", " ", " "]
    return sorted({"".join(r.choice(syllables) for _ in range(r.randrange(3, 11))).strip() or "X" for _ in range(n)})


def test_ratios_at_once_equal_difflib():
    a, b = made_names(900, 1), made_names(900, 2)
    n = min(len(a), len(b))
    a, b = [*a[:n], "", "A" * 250, ""], [*b[:n], "B", "A" * 240, ""]
    assert similarity.sequence_ratios(a, b) == [similarity.sequence_ratio(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("flipped", [False, True])
def test_most_alike_equals_a_loop_with_few_comparisons(monkeypatch, flipped):
    known = made_names(800, 3)
    names = [*made_names(60, 4), *[k[:2] + k[3:] for k in known[::40]], "A" * 70]
    compared, f = [0], alike.sequence_ratios
    monkeypatch.setattr(alike, "sequence_ratios", lambda a, b: (compared.__setitem__(0, compared[0] + len(a)), f(a, b))[1])
    ratio = lambda n, k: similarity.sequence_ratio(k, n) if flipped else similarity.sequence_ratio(n, k)
    for least in (0.6, 0.85):
        want = []
        for n in names:
            top = max(ratio(n, k) for k in known)
            want += [(n, k, top) for k in known if top >= least and ratio(n, k) == top]
        assert sorted(alike.most_alike(names, [least] * len(names), known, flipped)) == sorted(want)
    assert compared[0] < 0.25 * 2 * len(names) * len(known)


def test_most_words_equals_a_loop():
    known, names = made_names(700, 5), made_names(80, 6)
    want = []
    for n in names:
        top = max(similarity.token_set_ratio(n, k) for k in known)
        want += [(n, k, top) for k in known if top >= 0.95 and similarity.token_set_ratio(n, k) == top]
    assert want and sorted(alike.most_words(names, [0.95] * len(names), known)) == sorted(want)


def test_search_in_parts(spark, monkeypatch):
    known, names = made_names(90, 7), made_names(40, 8)
    d = spark.createDataFrame([(n, 0.6) for n in names], "name string, least double")
    k = spark.createDataFrame([(x,) for x in known], "known string")
    f = lambda n, c, x: alike.most_alike(n, c, x, False)
    monkeypatch.setattr(alike, "KNOWN", 30)
    got = {}
    for n, x, v in rows(alike.search(d, k, f)):
        got[n] = max(got.get(n, (0, "")), (v, x))
    want = {}
    for n, x, v in alike.most_alike(names, [0.6] * len(names), known, False):
        want[n] = max(want.get(n, (0, "")), (v, x))
    assert got == want and alike.search(d.limit(0), k, f).count() == alike.search(d, k.limit(0), f).count() == 0


def test_greedy_pairs_of_rows_that_want_the_same(spark, few_jobs):
    """Ninety slips want the same ninety bills in the same order; a round each took 180 tables."""
    p = [(a, b, b) for a in range(90) for b in range(90)] + [(200, 300, 1), (201, 300, 0)]
    got = graph.greedy_pairs(spark.createDataFrame(p, "a long, b long, d long"), "a", "b", F.col("a"), F.col("d"), F.col("b"))
    assert rows(got) == [(a, a, a) for a in range(90)] + [(200, 300, 1)]


def test_dictionary_is_not_sent_by_way_of_the_driver(spark):
    """An estimate of compressed columns let a dictionary of any size be collected and broadcast."""
    known = spark.createDataFrame([(x, x, x) for x in made_names(40, 9)], "name string, canonical string, ord string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dictionary.match_names(known.select(F.col("name").alias("n")), known, "n", fuzzy=False)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["tier"] for r in got.collect()} == {1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_runs_of_letters_are_not_broadcast(spark, monkeypatch, fuzzy):
    """Under Spark's own threshold the runs of letters of the dictionary, estimated as no larger than it, went by way of the driver."""
    plans, cut = [], dictionary.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for m in (dictionary, alike):
        monkeypatch.setattr(m, "cut", lambda df, *a, **k: (plan(df), cut(df, *a, **k))[1])
    x = made_names(60, 15)
    known = spark.createDataFrame([(n, n, n) for n in x[:40]], "name string, canonical string, ord string")
    got = dictionary.match_names(spark.createDataFrame([(n + e,) for n in x for e in ("", "S")], "n string"), known, "n", fuzzy=fuzzy)
    plan(got)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    assert "Join" in "".join(plans) and "Broadcast" not in "".join(plans)
    assert {1, 2} <= {r["tier"] for r in got.collect()}


def test_most_shared_words_equal_a_loop():
    known, names = made_names(300, 10), [*made_names(60, 11), "VEL VEL BOF", " VEL"]
    words = lambda t: set(re.split(r"\s+", t))
    want = {}
    for n in names:
        for k in known:
            share = len(words(n) & words(k)) / min(len(words(n)), len(words(k)))
            if share >= 0.6 and share > want.get(n, ("", 0))[1]:
                want[n] = (k, share)
    got = alike.most_shared(names, [0.6] * len(names), known)
    assert want and {n: (k, v) for n, k, v in got} == want and len(got) == len(want)


def test_close_names_equal_a_loop():
    names = [n for n in made_names(150, 12) + ["VEL", "VEL BOF", "XVEL BOF DRAX"] if "  " not in n]
    want = []
    for n in names:
        for k in names:
            x, y = set(n.split(" ")), set(k.split(" "))
            sim = 1.0 if n == k else 0.9 if n in k or k in n else len(x & y) / len(x | y)
            if x & y and sim >= 0.7:
                want.append((n, k, sim))
    assert len(want) > len(names) and sorted(alike.close_names(names, [0.7] * len(names), names)) == sorted(want)


def test_group_pairs_meet_once(spark, monkeypatch):
    """Names of several words met once for each word, and a wide distinct dropped the copies."""
    docs = spark.createDataFrame([(i, "PENDING") for i in range(40)], "id long, status string")
    t = spark.createDataFrame([(i, i, "ALFA BETA GAMA DELTA" if i % 2 else "ALFA BETA GAMA", 1000 + 7000 * (i % 3), None) for i in range(40)], "id long, doc_id long, supplier_clean string, amount_cents long, link_id long")
    monkeypatch.setattr(reconcile, "load", lambda s, d, *n: docs)
    monkeypatch.setattr(reconcile, "distinct_trans", lambda s, d: t)
    j = reconcile.group_pairs(spark, "")
    got = rows(j.select("id", "other", "confidence"))
    assert got == sorted((a, b, 1.0 if a % 2 == b % 2 else 0.95) for a in range(40) for b in range(40) if a != b and a % 3 == b % 3)
    assert "Distinct" not in j._jdf.queryExecution().logical().toString()


def test_parts_of_words_equal_a_loop(spark):
    """Of two texts without a common word one may still contain the other; these were left out."""
    odd = ["TRATOR", "TRATORES LEPRAFI", "OR", "ORES LE", "RES LEPRA", "TRATORES LEPRA", "ÇÃO", "DRAÇÃO ÇÃOX", "AA", "AAA AAAA", "A AA", "AAAA AAA", "XVEL BOFX", "VEL BOF", "X"]
    names = sorted({*odd, *(n for n in made_names(150, 16) if "  " not in n)})
    shares = lambda n, k: bool({*n.split(" ")} & {*k.split(" ")})
    want = [(n, k) for n in names for k in names if n != k and (n in k or k in n) and not shares(n, k)]
    assert len({n.count(" ") for n, _ in want}) > 1 and ("ORES LE", "TRATORES LEPRAFI") in want
    assert rows(alike.parts_of_words(spark.createDataFrame([(n,) for n in names], "name string"))) == want


def test_group_pairs_of_names_without_a_common_word(spark, monkeypatch):
    names = ["TRATOR", "TRATORES", "TRATORES LEPRAFI", "ORES LEPRA", "FERRAGENS LEPRAFI"]
    docs = spark.createDataFrame([(i, "PENDING") for i in range(5)], "id long, status string")
    t = spark.createDataFrame([(i, i, n, 1000, None) for i, n in enumerate(names)], "id long, doc_id long, supplier_clean string, amount_cents long, link_id long")
    monkeypatch.setattr(reconcile, "load", lambda s, d, *n: docs)
    monkeypatch.setattr(reconcile, "distinct_trans", lambda s, d: t)
    want = sorted((a, b, 0.95) for a in range(5) for b in range(5) if a != b and (names[a] in names[b] or names[b] in names[a]))
    assert rows(reconcile.group_scores(spark, "")) == want and {x for x, *_ in want} == {0, 1, 2, 3}
    # groups take the surest candidate, the smallest id of several
    assert rows(reconcile.auto_groups(spark, "").select("id", "partner", "confidence")) == [(0, 1, 0.95), (1, 0, 0.95), (2, 0, 0.95), (3, 2, 0.95)]


def test_pair_sums_are_not_shuffled(spark, monkeypatch):
    """Target-item pairs and the result itself were shuffled, which filled the disk for a hot key."""
    r = random.Random(13)
    monkeypatch.setattr(subsets, "HANDED", 50)
    monkeypatch.setattr(subsets, "SPREAD", 100)
    items = [(f"i{i}", "k" if i % 5 else None, r.choice([None, *range(1, 60)])) for i in range(90)]
    targets = [(i, r.choice(["k", "k", None]), r.choice([None, *range(2, 120)])) for i in range(40)]
    df = subsets.pair_sums(spark.createDataFrame(targets, "tid long, k string, t long"), spark.createDataFrame(items, "iid string, k string, v int"), "k", "t", "v", "tid", "iid", 2)
    kept = [x for x in items if x[1] and x[2] is not None]
    assert rows(df) == sorted((t, min(a[0], b[0]), max(a[0], b[0]), a[2] + b[2]) for t, k, x in targets if k and x is not None for a, b in itertools.combinations(kept, 2) if abs(a[2] + b[2] - x) <= 2)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    after = plan[: plan.index("MapInArrow")]  # what is done with the pairs stands above the step that makes them
    assert "Aggregate" not in after and "Join" not in after and dict(df.dtypes)["total"] == "int"


@pytest.mark.parametrize("share", [50, 10**9])
def test_value_pairs_equal_a_loop(spark, monkeypatch, share):
    """Rows of the few bins of a narrow range stayed in the few tasks that their bytes allow, and each pair was met twice."""
    monkeypatch.setattr(ranges, "SHARE", share)
    monkeypatch.setattr(ranges, "HANDED", 40)
    r = random.Random(14)
    x = [(i, r.choice(["A", "B", "C", None]), r.choice([r.randrange(1, 30), r.randrange(200, 320), r.randrange(9_900, 10_300), 0, None])) for i in r.sample(range(400), 300)]
    df = ranges.value_pairs(spark.createDataFrame([*x, x[0]], "id long, k string, v long"), "id", "k", "v", 5, 2)
    want = []
    for (i, k, v), (j, m, w) in itertools.combinations(sorted([*x, x[0]], key=lambda t: t[0]), 2):
        if i != j and k and m and k != m and v and w and (abs(v - w) <= 5 or abs(v - w) * 100 <= 2 * min(v, w)):
            want.append((i, j, abs(v - w) > 5))
    assert rows(df) == sorted(want) and len({p for _, _, p in want}) == 2
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
