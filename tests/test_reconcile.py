"""Reconciliation, precedence and file names against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import filenames, text
from ledgerloom.operators import dictionary, subsets
from ledgerloom.plans import precedence, reconcile
from ledgerloom.session import shared_dir, work_dir
from ledgerloom.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_containing(spark):
    r = random.Random(1)
    a = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 5))) for _ in range(40)})
    b = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(40)})
    got = rows(dictionary.containing(spark.createDataFrame([(x,) for x in a], "u string"), spark.createDataFrame([(x,) for x in b], "v string"), "u", "v"))
    assert got == sorted((x, y) for x in a for y in b if x and y and (x in y or y in x))


def test_dictionary_in_blocks(spark, monkeypatch):
    known = spark.createDataFrame([(f"ACMELOR{chr(65 + i)} BRENTUVAL", f"C{i}", i) for i in range(20)], "name string, canonical string, ord int")
    names = spark.createDataFrame([("ACMELARA BRENTOVAL",), ("ACMELORB BRENTUVAL",), ("ZZZ",), (None,), ("",)], "n string")
    one = rows(dictionary.match_names(names, known, "n"))
    monkeypatch.setattr(dictionary, "BROADCAST_LIMIT", 700)
    assert 1 < len(dictionary.blocks(known, "name")) < 9 and rows(dictionary.match_names(names, known, "n")) == one and len(one) == 2


def test_pair_sums_of_a_hot_key(spark):
    r = random.Random(2)
    items = [(i, r.choice("kkkl"), r.randrange(1, 300)) for i in range(60)]
    targets = [(100 + i, r.choice("kkl"), r.randrange(2, 600)) for i in range(20)]
    got = rows(subsets.pair_sums(spark.createDataFrame(targets, "tid long, k string, t long"), spark.createDataFrame(items, "iid long, k string, v long"), "k", "t", "v", "tid", "iid", 5))
    want = [(t[0], a[0], b[0], a[2] + b[2]) for t in targets for a, b in itertools.combinations(items, 2) if a[1] == b[1] == t[1] and abs(a[2] + b[2] - t[2]) <= 5]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_islands_are_split_by_the_best_assignment(spark, seed):
    r = random.Random(seed)
    members = [(1, i, "NFE") for i in range(4)] + [(1, 10 + i, "BOLETO") for i in range(3)] + [(1, 20, "COMPROVANTE"), (2, 30, "NFE"), (2, 31, "BOLETO")]
    pairs = [(1, i, 10 + j, r.choice([30, 50, 80, 100, 5])) for i in range(4) for j in range(3) if r.random() < 0.8] + [(2, 30, 31, 80)]
    got = [tuple(r) for r in reconcile.split_islands(spark.createDataFrame(members, "component long, id long, k string"), spark.createDataFrame(pairs, "component long, bill long, slip long, gain long")).collect()]
    gain = {(b, s): g for _, b, s, g in pairs if g >= 10}
    best = max(sum(gain.get(p, 0) for p in zip(pick, (10, 11, 12))) for pick in itertools.permutations(range(4), 3))
    part = {}
    for _, i, p in got:
        part.setdefault(p, []).append(i)
    assert sum(gain[(min(v), max(v))] for p, v in part.items() if p is not None) == best
    assert len(got) == len(members) and {30, 31, 20} <= set(part[None])


def test_choice_among_readings(spark):
    c = [
        (1, "a", "filename", 0.99, False, 1), (1, "b", "native_text", 0.85, False, 2), (1, "c", "barcode", 0.9, True, 3),
        (2, "a", "filename", 0.99, False, 1), (2, "b", "native_text", 0.85, False, 2),
        (3, "a", "filename", 0.99, False, 1), (3, "b", "native_text", 0.5, False, 2),
        (4, "a", "unheard", 0.9, False, 1), (4, "b", "unheard", 0.9, False, 2), (5, None, "barcode", 0.9, True, 1), (5, "", "barcode", 0.9, True, 1),
    ]
    got = {r["k"]: (r["value"], r["source"], r["confidence"]) for r in precedence.choose(spark.createDataFrame(c, "k int, value string, source string, confidence double, valid boolean, ord int"), ["k"]).collect()}
    assert got == {1: ("c", "regex_validated", 0.99), 2: ("b", "native_text", 0.85), 3: ("b", "native_text", 0.5), 4: ("a", "unheard", 0.9)}


NAMES = [
    ("01.11.2025_T1_ACME LTDA_3.060,00_BOLETO_4650.pdf", "2025-11-01", "ACME LTDA", 306000, "4650"),
    ("01.11.2025_T1_ACME_BOLETO_FECHAMENTO.pdf", "2025-11-01", "ACME", 0, "FECHAMENTO"),
    ("10.11.2025_T1_ACME_NFSE_196 pg 0311.pdf", "2025-11-10", "ACME", 0, "196 pg 0311"),
    ("/x/y/10.11.2025_T1_AB_12_34_z.pdf", "2025-11-10", None, 1200, "12_34"),
    ("scan.pdf", None, None, 0, None),
    ("", None, None, 0, None),
    (None, None, None, 0, None),
]


def test_file_names(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "f string")
    f = F.col("f")
    got = df.select("f", filenames.file_date(f), filenames.file_supplier(f), filenames.file_amount(f), filenames.file_number(f)).collect()
    assert [tuple(r) for r in got] == NAMES


def test_payment(spark):
    df = spark.createDataFrame([(1, "Comprovante PAGO"), (2, "Agendamento, solicitação de débito"), (3, None), (4, "SISBB: 1.234 agendado"), (5, "PAGAMENTO EFETUADO A.BC1.2DE.F34"), (6, "pix enviado"), (7, "A.BC1.2DE.F34"), (8, "PIX AGENDADO")], "i int, t string")
    state = [tuple(r) for r in df.select("i", *text.payment_state(F.col("t"))).collect()]
    assert state == [(1, "CONFIRMED", 0.9, 0, 2), (2, "PLANNED", 0.8, 2, 0), (3, "PENDING", 0.5, 0, 0), (4, "CONFIRMED", 0.95, 1, 3), (5, "PENDING", 0.5, 0, 0), (6, "PENDING", 0.5, 0, 0), (7, "PENDING", 0.5, 0, 0), (8, "PLANNED", 0.7, 1, 0)]
    assert [r[0] for r in df.filter("i > 4").select(text.bank_payment(F.col("t"))[0]).collect()] == ["CONFIRMED", "CONFIRMED_UNSIGNED", "PROBABLE", "PLANNED"]


def test_graph_in_pieces(spark):
    v, e = spark.createDataFrame([(1, i, "x") for i in range(25)], "g long, id long, kind string"), spark.createDataFrame([(1, 0, i, 0.5) for i in range(1, 25)], "g long, src long, dst long, weight double")
    got = files.graph_json(v, e, "g", 10).collect()
    assert sorted(r["piece"] for r in got) == [0, 1, 2] and max(r["graph"].count('"kind"') for r in got) == 10


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert work_dir(spark).startswith(shared_dir(spark))


@pytest.mark.parametrize("seed", range(6))
def test_best_flow(seed):
    """Against trying every integer flow."""
    import numpy as np

    from ledgerloom.operators.graph import best_flow

    r = random.Random(seed)
    a, b = [r.randrange(0, 4) for _ in range(2)], [r.randrange(0, 4) for _ in range(3)]
    profit = np.array([[r.choice([0, 500, 955, 1000]) for _ in b] for _ in a])
    best = 0
    for x in itertools.product(*[range(min(i, j) + 1) for i in a for j in b]):
        m = np.array(x).reshape(len(a), len(b))
        if (m.sum(axis=1) <= a).all() and (m.sum(axis=0) <= b).all():
            best = max(best, int((m * profit).sum()))
    x = best_flow(a, b, profit)
    assert int((x * profit).sum()) == best and (x.sum(axis=1) <= a).all() and (x.sum(axis=0) <= b).all() and (x >= 0).all()
    assert best_flow([], [3], np.zeros((0, 1))).sum() == 0 and best_flow([3], [], np.zeros((1, 0))).sum() == 0


def test_flow_gap(spark):
    rows_ = [("s", 1, 10, 0, None), ("s", 2, 10, 3, "x"), ("t", 3, 5, None, None)]
    cols = "s string, id long, v long, n int, tag string"
    a = spark.createDataFrame(rows_, cols).withColumn("day", F.expr("date_add(date'2024-01-01', n)"))
    b = spark.createDataFrame([("s", 7, 12, 2, "x"), ("s", 8, 6, 9, "y")], cols).withColumn("day", F.expr("date_add(date'2024-01-01', n)"))
    from ledgerloom.operators.graph import flow_gap

    (r,) = flow_gap(a, b).collect()
    assert (r["s"], r["payments"], r["bills"]) == ("s", 2, 2) and 0 < r["greedy"] <= r["best"]
    assert flow_gap(a, b, 1).collect()[0]["best"] is None


def test_closest_known(spark):
    from difflib import SequenceMatcher

    from ledgerloom.operators.entities import closest_known

    known = ["AGRO BELTRO", "AGRO BELTRO MAQ", "TRATORES UNIDOS", "ZIRCO"]
    names = ["agro beltro", "AGRO BELTRO MA", "AGRO BELTJO", "TRATORES UNIDAS SUL", "ZIRCA", "NADA DISSO", "AGRO BELTRO MAQUINAS AGRICOLAS", "", None]
    want = {}
    for n in {x.upper() for x in names if x}:
        cut = 0.75 if len(n) < 6 else 0.85
        begun = sorted(k for k in known if (n.startswith(k) or k.startswith(n)) and abs(len(n) - len(k)) < 10)
        near = sorted((-r, k) for k in known if (r := SequenceMatcher(None, k, n).ratio()) >= cut)
        if n in known:
            want[n] = (n, 1)
        elif begun:
            want[n] = (begun[0], 2)
        elif near:
            want[n] = (near[0][1], 3)
    got = closest_known(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(k,) for k in known], "name string"), "n")
    assert {r["name"]: (r["known"], r["tier"]) for r in got.collect()} == want and {v[1] for v in want.values()} == {1, 2, 3}


def test_cross_validation_of_entities(spark):
    from ledgerloom.operators.entities import cross_validate

    known = spark.createDataFrame([("11.222.333/0001-81", "ACMELOR PNEUS LTDA"), ("", "SEM NUMERO"), (None, None)], "cnpj string, name string")
    rows_ = [(1, "11222333000181", "Acmelor Pneus"), (2, "11.222.333/0001-81", "Outra Casa"), (3, "11.222.333/0001-99", "PNEUS ACMELOR ME"), (4, None, "Nada"), (5, None, None)]
    got = {r["i"]: (r["status"], r["confidence"], r["method"]) for r in cross_validate(spark.createDataFrame(rows_, "i int, cnpj string, name string"), known, "i").collect()}
    assert got == {1: ("APPROVED", 1.0, "NUMBER"), 2: ("WARNING", 0.9, "NUMBER_OTHER_NAME"), 3: ("APPROVED", 1.0, "NAME"), 4: ("REJECTED", 0.0, "NONE"), 5: ("REJECTED", 0.0, "NONE")}


def test_mime_parts(spark):
    import base64
    import json

    from ledgerloom.sources.mail import mime_parts

    enc = lambda t: base64.urlsafe_b64encode(t.encode()).decode()
    leaf = lambda m, t: {"mimeType": m, "body": {"data": enc(t)}}
    tree = {"mimeType": "multipart/mixed", "parts": [{"parts": [leaf("text/plain", "olá"), leaf("text/html", "<p>olá</p>")]}, {"filename": "a.PDF", "mimeType": "application/pdf", "body": {"attachmentId": "x1"}}, {"filename": "b.png", "body": {"attachmentId": "x2"}}, {"filename": "c.xml", "body": {}}]}
    deep = leaf("text/plain", "fundo")
    for _ in range(300):
        deep = {"parts": [deep]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(deep)), (3, None), (4, "{nonsense"), (5, "[1]")], "i long, p string")
    got = {r["i"]: (r["html"], r["text"], [a["attachment_id"] for a in r["attachments"]]) for r in mime_parts(df, "i", "p").collect()}
    assert got == {1: ("<p>olá</p>", "olá", ["x1"]), 2: (None, "fundo", []), 3: (None, None, []), 4: (None, None, []), 5: (None, None, [])}
