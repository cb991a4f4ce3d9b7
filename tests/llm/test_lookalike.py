import itertools
import random

from ledgerloom.llm.lookalike import SPELL, same_looking_groups, same_looking_pairs, script_findings, script_use, spell, visual_form, with_visual_form

SAME = [
    ("À atenção do financeirο", "À atenção do financeiro"),
    ("ＡＢＣ １２", "ABC 12"),
    ("ﬁm", "fim"),
    ("a b c", "a b c"),
    ("pre­ço", "preço"),
    ("zero​width﻿", "zerowidth"),
    ("23‑45", "23-45"),
    ("é", "é"),
    ("Оplatа", "Oplata"),
    ("で", "で"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "2"), ("nº", "no"), ("a\nb", "a b"), ("0", "O"), ("l", "1"), ("x", "x!"), ("ё", "е"), ("ı", "i"), ("x²", "x2"), ("ʼ", "'")]


def test_forms():
    for a, b in SAME:
        assert visual_form(a) == visual_form(b), (a, b)
    for a, b in DIFFERENT:
        assert visual_form(a) != visual_form(b), (a, b)
    assert visual_form(None) is None and visual_form("") == ""
    for a, _ in SAME:
        assert visual_form(visual_form(a)) == visual_form(a)


def test_script_choice():
    assert spell("сор") == "cop"  # all shapes exist in Latin
    assert spell("оплaтa") == "оплата"  # only Cyrillic holds the whole token
    assert spell("жa") == spell("жа")


def test_script_sets():
    assert [script_use(x) for x in ("boleto", "bоleto", "рара", "привет", "日本カタカナ", "한국漢字", "Ａbc", "123", "")] == ["single", "mixed", "whole", "single", "single", "single", "single", "single", "single"]


def test_groups_and_findings(spark):
    df = spark.createDataFrame([(3, "boleto рара", "z"), (1, "bоleto papa", "z"), (2, "outro", "z"), (4, None, "z"), (5, " ", "z"), (6, "boleto papa", "z")], "doc_id long, text string, form string")
    assert {tuple(r) for r in same_looking_groups(df).collect()} == {(1, 1), (3, 1), (6, 1), (2, 2), (4, None), (5, None)}
    assert {tuple(r) for r in script_findings(df).collect()} == {(3, 0, 1), (1, 1, 0), (2, 0, 0), (4, None, None), (5, 0, 0), (6, 0, 0)}
    assert same_looking_groups(df.limit(0)).count() == script_findings(df.limit(0)).count() == 0


def test_any_swap_of_shapes_keeps_the_form():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("abcopxyjs жлдABCHKMPTX") for _ in range(r.randrange(1, 14)))
        u = "".join(r.choice(list(SPELL[c].values())) if c in SPELL else c for c in t)
        assert visual_form(t) == visual_form(u)


def test_pairs_against_all_pairs(spark):
    r = random.Random(2)
    base = ["boleto pago", "nota ﬁscal", "рара", "x y", "abc"]
    rows = [(i, r.choice([t, t, t.replace("o", "ο"), t.replace(" ", " "), t.upper(), t + "​"])) for i, t in enumerate(base * 8)] + [(900, None), (901, ""), (902, "  "), (903, "  "), (904, "​"), (None, "abc")]
    want = sorted((a[0], b[0]) for a, b in itertools.combinations([x for x in rows if x[0] is not None and x[1]], 2) if a[1] != b[1] and visual_form(a[1]) == visual_form(b[1]) and visual_form(a[1]).strip())
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, form string")
    assert sorted(map(tuple, same_looking_pairs(df).collect())) == want and want
    assert same_looking_pairs(df.limit(0)).count() == 0


def test_long_text(spark):
    t = "а" * 200_000
    assert with_visual_form(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()[0]["form"] == "a" * 200_000
