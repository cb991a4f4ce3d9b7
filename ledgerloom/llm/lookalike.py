"""One form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

# Letters that look the same, one row per shape, by script in the order of SCRIPTS ("." where a script has none).
SHAPES = """
AАΑ.Ꭺꓮ BВΒ.Ᏼꓐ CСϹ.Ꮯꓚ D...Ꭰꓓ EЕΕ.Ꭼꓰ F.Ϝ..ꓝ GԌ..Ꮐꓖ HНΗ.Ꮋꓧ IІΙ..ꓲ JЈͿ.Ꭻꓙ KКΚ.Ꮶꓗ L...Ꮮꓡ MМΜ.Ꮇꓟ N.Ν..ꓠ OОΟՕ.ꓳ PРΡ.Ꮲꓑ QԚ.... R...Ꭱꓣ SЅ.ՏᏚꓢ
TТΤ.Ꭲꓔ U..Ս.ꓴ VѴ..Ꮩꓦ WԜ..Ꮃꓪ XХΧ..ꓫ YҮΥ..ꓬ Z.Ζ.Ꮓꓜ
aаα... cсϲ... dԁ.... eе.... g..ց.. hһ.հ.. iі.... jјϳ... lӏ.... n..ո.. oоοօ.. pрρ... qԛ.զ.. sѕ.... u..ս.. vѵν... wԝ.... xх.... yу....
.ПΠ... .ГΓ... .ФΦ...
""".split()
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")
#: shape of a letter -> its spelling by script
SPELL = {}
for _row in SHAPES:
    _by = {s: c for s, c in zip(SCRIPTS, _row) if c != "."}
    for _c in _by.values():
        SPELL[_c] = _by
# Characters without width.
UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Kinds of blank and of hyphen.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe58\ufe63\uff0d"
TABLE = {ord(c): None for c in UNSEEN} | {c: None for c in range(0xFE00, 0xFE10)} | {ord(c): " " for c in BLANKS} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord(c): "-" for c in HYPHENS}
# Joined letters.
TABLE |= str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ǆ": "DŽ", "ǆ": "dž", "Ǉ": "LJ", "ǉ": "lj", "Ǌ": "NJ", "ǌ": "nj", "Ĳ": "IJ", "ĳ": "ij"})
#: Half-width katakana and their marks take their ordinary forms.
TABLE |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF65, 0xFFA0)}
#: Letters and figures in another type face (bold, script, double-struck and so on) and roman numerals take their ordinary forms, by their own decompositions.
TABLE |= {c: unicodedata.normalize("NFKC", chr(c)) for lo, hi in ((0x2100, 0x2150), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00)) for c in range(lo, hi) if unicodedata.decomposition(chr(c)).startswith("<font>")}
TABLE |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180) if unicodedata.decomposition(chr(c)).startswith("<compat>")}
# Second letters of one script for one shape - script g, micro sign, Kelvin, Ohm and Angstrom signs (by NFD), palochka.
TABLE |= str.maketrans({"\u0261": "g", "\u00b5": "\u03bc", "\u04c0": "\u0406"})
#: A text of only these characters is its own form.
PLAIN = re.compile(r"[\t\n\r -~ª°ºÀ-ÖØ-öø-ÿ]*")
TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13ff\uab70-\uabbf\ua4d0-\ua4ff]")
#: Writing systems that use several scripts together: a letter of one belongs to the system as well.
SYSTEMS = {"CJK": ("JAPANESE", "KOREAN", "CHINESE"), "HIRAGANA": ("JAPANESE",), "KATAKANA": ("JAPANESE",), "HANGUL": ("KOREAN",), "BOPOMOFO": ("CHINESE",)}


@lru_cache(20_000)
def own_scripts(c: str) -> frozenset:
    """Resolved script set of one letter: its script and the writing systems that use it; empty for marks and signs, which go with any."""
    if unicodedata.combining(c) or not c.isalpha():
        return frozenset()
    script = unicodedata.name(c, "?").replace("HALFWIDTH ", "").replace("KATAKANA-HIRAGANA", "KATAKANA").split(" ")[0]
    return frozenset([script, *SYSTEMS.get(script, ())])


@lru_cache(20_000)
def scripts_of(c: str) -> frozenset:
    """Scripts in which the letter's shape exists; empty for marks, which go with any letter."""
    return frozenset(SPELL[c]) if c in SPELL else own_scripts(c)


def script_use(token: str) -> str:
    """'mixed' if no script holds all letters of a token as they are, 'whole' if one does but another script has all its shapes, else 'single'."""
    t = unicodedata.normalize("NFD", token.translate(TABLE))
    own = [x for x in map(own_scripts, t) if x]
    if not own:
        return "single"
    if not frozenset.intersection(*own):
        return "mixed"
    shapes = frozenset.intersection(*[x for x in map(scripts_of, t) if x])
    return "whole" if shapes - frozenset.union(*own) and "LATIN" not in own[0] else "single"


def spell(token: str) -> str:
    """A token (decomposed) in one script.

    The script sets of its letters' shapes are intersected.  Of the scripts left
    the first in the order of SCRIPTS spells the whole token - a whole-script
    look-alike therefore becomes Latin.  Where none is left the token mixes
    scripts in earnest and each shape takes its first script.  The result depends
    on shapes only, so tokens that look the same come out equal.
    """
    sets = [s for s in map(scripts_of, token) if s]
    common = frozenset.intersection(*sets) if sets else frozenset()
    script = next((s for s in SCRIPTS if s in common), None)
    out = []
    for c in token:
        by = SPELL.get(c)
        out.append(c if by is None else by[script] if script else next(by[s] for s in SCRIPTS if s in by))
    return "".join(out)


def visual_form(text: str | None) -> str | None:
    """The form shared by all texts that look like ``text``.

    Width, joined letters, kinds of blank and hyphen, invisible characters,
    composed or combining accents and look-alike letters are brought to one
    spelling.  Accents, case, figures, raised letters and line breaks stay.
    Null gives null, an empty text an empty text; the whole text is processed.
    """
    if text is None or PLAIN.fullmatch(text):
        return text
    t = unicodedata.normalize("NFD", text.translate(TABLE))
    if FOREIGN.search(t):
        seen: dict[str, str] = {}
        t = TOKEN.sub(lambda m: seen.get(m[0]) or seen.setdefault(m[0], spell(m[0])), t)
    return unicodedata.normalize("NFC", t)


@F.pandas_udf(T.StringType())
def visual_form_udf(s: pd.Series) -> pd.Series:
    return pd.Series([visual_form(x) if isinstance(x, str) else None for x in s], dtype=object)


def with_visual_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with the visual form of a text column; null texts give null."""
    return df.withColumn(out, visual_form_udf(F.col(text)))


def script_findings(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mixed, whole): tokens of each text that mix scripts, and tokens of one script that another script could spell alike.

    Null texts have null counts; texts without letters have 0.
    """

    @F.pandas_udf("mixed int, whole int")
    def count(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            use = [] if not isinstance(x, str) or PLAIN.fullmatch(x) else [script_use(m) for m in TOKEN.findall(x) if not m.isascii()]
            rows.append((use.count("mixed"), use.count("whole")) if isinstance(x, str) else (None, None))
        return pd.DataFrame(rows, columns=["mixed", "whole"]).astype("Int32")

    return df.select(F.col(id_col), count(F.col(text)).alias("_c")).select(id_col, "_c.mixed", "_c.whole")


def same_looking_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, group_id): the smallest id of all texts that look the same, exact copies included; texts without a visible character have none.

    The linear form of :func:`same_looking_pairs`: one row a text, however many look alike.
    """
    d = df.select(F.col(id_col).alias("_id"), visual_form_udf(F.col(text)).alias("_f")).filter("_id is not null")
    d = cut(d.select("_id", F.when(F.length(F.regexp_replace("_f", r"(?U)\s", "")) > 0, F.sha2("_f", 256)).alias("_f")))
    g = d.filter("_f is not null").groupBy("_f").agg(F.min("_id").alias("group_id"))
    return d.join(g, "_f", "left").select(F.col("_id").alias(id_col), "group_id")


def same_looking_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs id_a < id_b of texts that look the same but differ in code points.

    Texts are folded to (form, text) classes by hash first: exact copies never
    meet each other, however many there are, and only classes of one form are
    paired before their members are brought in.  Blank, empty and null texts and
    exact copies give no pair; rows with a null id are ignored; extra columns are
    ignored, whatever their names.
    """
    d = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).filter("_id is not null and _t is not null")
    d = d.withColumn("_f", visual_form_udf("_t"))
    key = lambda c: F.sha2(c, 256)
    # written once: every later step reads hashes instead of folding the texts again
    members = cut(d.select("_id", F.when(F.length(F.regexp_replace("_f", r"(?U)\s", "")) > 0, key("_f")).alias("_f"), key("_t").alias("_t"))).filter("_f is not null")
    classes = members.select("_f", "_t").distinct()
    each = classes.join(classes.groupBy("_f").count().filter("count > 1"), "_f", "left_semi")
    kept = members.join(each, ["_f", "_t"], "left_semi")
    left, right = kept.select("_f", F.col("_t").alias("ta"), F.col("_id").alias("ia")), kept.select("_f", F.col("_t").alias("tb"), F.col("_id").alias("ib"))
    pair = each.alias("p").join(each.alias("q"), (F.col("p._f") == F.col("q._f")) & (F.col("p._t") < F.col("q._t"))).select(F.col("p._f").alias("_f"), F.col("p._t").alias("ta"), F.col("q._t").alias("tb"))
    out = pair.join(left, ["_f", "ta"]).join(right, ["_f", "tb"])
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).filter("id_a <> id_b").distinct()
