import itertools
import random

from ledgerloom.llm.names import align, best_assignment, deletes, osa, parse_name, variant_pairs


def test_osa_and_index_agree():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(3, 7))) for _ in range(60)]
    for a, b in itertools.combinations(words, 2):
        if osa(a, b, 2) <= 2:
            assert deletes(a, 2) & deletes(b, 2)
    assert osa("abcd", "abdc") == 1 and osa("abc", "xyz") == 3


def test_assignment_is_optimal():
    r = random.Random(2)
    for _ in range(60):
        n, m = r.randrange(1, 4), r.randrange(1, 5)
        g = [[r.choice([0, 0.3, 1, 0.85]) for _ in range(m)] for _ in range(n)]
        best = max((sum(g[i][j] for i, j in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k)), default=0)
        assert abs(sum(g[i][j] for i, j in best_assignment(g)) - best) < 1e-9


def test_parse():
    assert parse_name("ACME BELTRÃO Pneus Ltda - ME") == (["ACME", "BELTRAO"], [], ["PNEUS"])
    assert parse_name("Xande de Souza") == (["SOUZA"], ["ALEXANDRE"], [])
    assert all(parse_name(x) is None for x in (None, "", " ", "-", "DIVERSOS", "Não identificado", "LTDA"))


def p(x):
    return parse_name(x)


def test_align():
    full = [("ACME BELTRAO PNEUS LTDA", "Beltrao Acme Pn."), ("ACMEBELTRAO PNEUS", "ACME BELTRAO PNEUS S/A"), ("ALEXANDRE PRADOS VENTURA", "Xande Prados Vemtura"), ("PRADOS VENTURA, ALEXANDRE", "ALEXANDRE PRADOS VENTURA")]
    assert all(align(p(a), p(b)) == "full" for a, b in full)
    assert align(p("ACME B. PNEUS"), p("ACME BELTRAO PNEUS")) == "part"
    differ = [("ACME BELTRAO PNEUS", "ACME BELTRAO SEGUROS"), ("ALEXANDRE PRADOS VENTURA", "HELENA PRADOS VENTURA"), ("ACME BELTRAO PNEUS", "ACME MOURENSE PNEUS")]
    assert all(align(p(a), p(b)) is None for a, b in differ)


def test_long_words_and_names():
    """Edits in words of any length, swaps at the edge of what the index looks at, and names of ten words and more."""
    assert osa("x" * 20_000, "x" * 10_000 + "y" + "x" * 9_999) == 1
    for a, b in (("abcdefghijklmnop", "abcdefghikjlmnop"), ("abcdefghijklmnop", "xabcdefghijlmnop"), ("abcdefghij" * 10, "abcdefghij" * 9 + "abcdefghi")):
        assert osa(a, b) <= 2 and deletes(a, 2) & deletes(b, 2)
    ten = "ALTOVEL BRANQUEL CASTAVEL DOMIVEL ESTAVREL FRANTOVEL GRANTUVEL HORTIVEL JANTOVREL LUMIVREL"
    assert align(p(ten), p(ten.replace("LUMIVREL", "LUMIVRAL"))) == "full"
    assert align(p(ten), p(" ".join(reversed(ten.split())))) == "full"


def test_short_words_and_shared_words(spark):
    """Words of two and three letters count, and a word that many suppliers share links none of them."""
    shared = [f"BRENTUVAL {w} PNEUS LTDA" for w in ("ACMELOR", "DOMINTRA", "FOLQUENT", "GARDUMES", "HESPIRUL", "JUNTOLAR", "KRIMBALO", "LOSTREVI")]
    rows = ["TIM XPO", "TIM XPOO", "TIM QRA", *shared, "Acmelor Brentuval Pneu's"]
    got = set(map(tuple, variant_pairs(spark.createDataFrame([(x,) for x in rows], "name string")).collect()))
    assert got == {("TIM XPO", "TIM XPOO"), tuple(sorted((shared[0], rows[-1])))}


def test_short_name_joins_the_closest_of_several(spark):
    """A short name that is equal to one supplier and close to another belongs to the first; equal to two, it stays apart."""
    rows = ["MORCINTO FELFRINI SEMENTES", "MORCINDO FRALGANE SEMENTES", "MORCINTO F. SEMENTES", "DALPRASO GUVISEL PNEUS", "DALPRASO GRERTAZI PNEUS", "DALPRASO G. PNEUS"]
    got = set(map(tuple, variant_pairs(spark.createDataFrame([(x,) for x in rows], "name string")).collect()))
    assert got == {("MORCINTO F. SEMENTES", "MORCINTO FELFRINI SEMENTES")}


def test_candidates_against_all_pairs(spark):
    """Every two forms that align and share a word within the edits that the shorter word allows, or one run together, are candidates."""
    from ledgerloom.llm.names import candidates, edits

    def close(a, b):
        k = min(edits(len(a)), edits(len(b)))
        return osa(a, b, k) <= k

    def shares(a, b):
        runs = lambda x: [p + q for p, q in itertools.permutations([w for w in x if len(w) >= 4], 2)]
        return any(close(v, w) for v in a for w in b if len(v) > 1 < len(w)) or any(close(v, w) for v in runs(a) for w in b if len(w) >= 8) or any(close(v, w) for v in a for w in runs(b) if len(v) >= 8)

    r = random.Random(7)
    syl = ["BRA", "TUL", "NEM", "DOR", "VIS", "CAL"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randrange(2, 4)))

    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + "X" + w[k:], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :], w[0]])

    names = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(1, 4))] + r.choice([["PNEUS"], [], ["SEMENTES"]]) + r.choice([[], ["MARIA"]])
        for _ in range(4):
            v = [typo(w) if w not in ("PNEUS", "SEMENTES", "MARIA") else w for w in base]
            r.shuffle(v)
            names.append(" ".join(v) if r.random() < 0.8 else "".join(v[:2]) + " " + " ".join(v[2:]))
    forms = {}
    for n in names:
        q = parse_name(n)
        if q:
            forms.setdefault(tuple(map(tuple, map(sorted, q))), q)
    rows = [(i, *q) for i, q in enumerate(forms.values())]
    df = spark.createDataFrame(rows, "fid long, core array<string>, given array<string>, biz array<string>")
    got = set(map(tuple, candidates(df).collect()))
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if align(tuple(a[1:]), tuple(b[1:])) and shares(a[1], b[1])}
    assert want and want <= got and len(got) < len(rows) * (len(rows) - 1) // 2


def test_pairs(spark):
    a = ["ACMELOR BELTRANO PNEUS LTDA", "Acmelor Beltrano Pn.", "BELTRANO ACMELOR PNEUS", "ACMELOR B. PNEUS", "ACMELORBELTRANO PNEUS ME", "acmelor beltrano pneus ltda", "Acmelor Beltramo Pneus - FILIAL 02"]
    b = ["ACMELOR BELTRANO SEGUROS S/A", "Seguros Acmelor Beltrano"]
    c = ["ALEXANDRE PRADOVIM VENTURIM", "Xande Pradovim Venturim", "PRADOVIM VENTURIM, A."]
    d = ["HELENA PRADOVIM VENTURIM"]
    rows = [(x, "z") for x in a + b + c + d + a] + [(None, "z"), ("", "z"), ("DIVERSOS", "z"), ("diversos", "z"), ("x" * 20_000, "z")]
    got = set(map(tuple, variant_pairs(spark.createDataFrame(rows, "name string, fid string")).collect()))
    want = {tuple(sorted(x)) for g in (a, b, c) for x in itertools.combinations(g, 2)}
    assert got == want
    assert variant_pairs(spark.createDataFrame([], "name string")).count() == 0
