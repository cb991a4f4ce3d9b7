"""Column functions on literal rows."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import dates, ids, money, text
from ledgerloom.functions import similarity as S


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_money(spark):
    given = ["R$ 1.234,56", "19,99", "", "abc", None, "10"]
    assert values(spark, given, money.amount_to_cents) == [123456, 1998, 0, 0, None, 1000]
    assert values(spark, given, lambda c: money.amount_to_cents(c, exact=True)) == [123456, 1999, 0, 0, None, 1000]
    assert values(spark, ["1.234,56", "1,234.56", "12", "R$ 0,05"], money.parse_money) == [123456, 123456, 1200, 5]
    assert values(spark, ["1.234.56", "1.234,56", "12,5", None], money.parse_separated) == [123456, 123456, 1250, None]
    assert values(spark, [123456, 5, 0], money.cents_to_display, "bigint") == ["1.234,56", "0,05", "0,00"]
    assert values(spark, ["R$ 1.2OO,S0", "10,00"], money.fix_currency_text) == ["1.200,50", "10,00"]


def test_dates(spark):
    given = ["31/12/2024", "31.12.24", "2024-12-31 00:00:00", "31/02/2025", "01-02-75", "à vista", "", None]
    assert values(spark, given, dates.normalise_date) == ["2024-12-31", "2024-12-31", "2024-12-31", "2025-02-31", "1975-02-01", None, None, None]
    assert [d and str(d) for d in values(spark, given, dates.parse_date)] == ["2024-12-31", "2024-12-31", "2024-12-31", None, "1975-02-01", None, None, None]


def figure_11(d, w):
    r = sum(int(a) * b for a, b in zip(d, w)) % 11
    return 0 if r < 2 else 11 - r


def test_checksums(spark):
    assert values(spark, ["11.222.333/0001-81", "11.222.333/0001-99", "1"], ids.is_cnpj) == [True, False, False]
    assert values(spark, ["111.444.777-35", "111.444.777-36", "11111111111"], ids.is_cpf) == [True, False, False]
    assert values(spark, ["11111111111"], lambda c: ids.is_cpf(c, repeats=True)) == [True]


def test_key_repair_tries_in_order(spark):
    r = random.Random(2)
    keys = []
    for _ in range(12):
        k = "".join(str(r.randrange(10)) for _ in range(43))
        k += str(figure_11(k, ids.KEY))
        at = r.randrange(43)
        keys.append(k[:at] + str((int(k[at]) + r.randrange(10)) % 10) + k[at + 1 :])

    def brute(k):
        ok = lambda x: figure_11(x[:43], ids.KEY) == int(x[43])
        if ok(k):
            return k
        for i in range(43):
            for y in ids.CONFUSED.get(k[i], ""):
                if ok(k[:i] + y + k[i + 1 :]):
                    return k[:i] + y + k[i + 1 :]
        for i in range(20):
            for y in "0123456789":
                if y != k[i] and ok(k[:i] + y + k[i + 1 :]):
                    return k[:i] + y + k[i + 1 :]
        return None

    assert values(spark, [*keys, "123", None], ids.repaired_key) == [*map(brute, keys), None, None]


def test_text(spark):
    assert values(spark, ["Nao houve agendamento.", "agendada para amanhã", "", None], text.is_planned) == [False, True, False, False]
    assert values(spark, ["NOTA FISCAL No 12345 SÉRIE 1 NF-E N 12345"], lambda c: text.document_number(c, F.lit("NFE"))[0]) == ["12345"]
    assert values(spark, ["DANFE chave de acesso", "Comprovante Pix", "", None], lambda c: text.classify_weighted(c)[0]) == ["NFE", "COMPROVANTE", "UNKNOWN", "UNKNOWN"]
    assert values(spark, ["001 10/01/2024 1.000,50\n002 10/02/2024 2,00", "", None], lambda c: F.size(text.installments_of(c))) in ([2, 0, -1], [2, 0, None])
    assert values(spark, ["https://x.example/boleto.pdf", "https://facebook.com/boleto", None], lambda c: text.link_confidence(c, F.lit("baixar boleto"))) == [0.7, 0.0, 0.0]
    assert values(spark, ['```json\n{"a": 1}\n```', "no json"], lambda c: text.json_answer(c, "a int")["a"]) == [1, None]
    assert values(spark, ["x" * 20, "!!!! ???? ..... ,,,", "short", None], text.is_junk) == [False, True, True, True]


def test_similarity():
    assert S.indel_ratio("abc", "abc") == 1 and S.indel_ratio("", "") == 1 and S.indel_ratio("a", None) == 0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs_length(a, b) == t[-1][-1]
    assert S.token_sort_ratio("b a", "a b") == 1 and S.token_set_ratio("a b c", "b a") == 1


def test_word_similarity(spark):
    df = spark.createDataFrame([("A PNEUS LTDA", "PNEUS"), ("ALFA BETA", "BETA GAMA"), ("", "X"), (None, "X")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(S.word_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.333, 0.0, 0.0]
