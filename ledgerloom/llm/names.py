"""Variant spellings of supplier names: symmetric-delete token index and optimal alignment."""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .components import connected_groups

# Lines of business and the words and abbreviations that name them.
BUSINESS = {
    "AGROPECUARIA": "AGROPECUARIA AGROP AGROPEC",
    "ARMAZENS GERAIS": "ARMAZENS ARMAZEM ARMZ ARM GERAIS GER",
    "AUTO POSTO": "POSTO AUTO",
    "CONTABILIDADE": "CONTABILIDADE CONTAB",
    "DISTRIBUIDORA": "DISTRIBUIDORA DISTRIB DIST",
    "EMBALAGENS": "EMBALAGENS EMBAL EMB",
    "ENERGIA": "ENERGIA ENER",
    "FERRAGENS": "FERRAGENS FERRAGENS FERR",
    "FERTILIZANTES": "FERTILIZANTES FERTIL FERT",
    "IMPLEMENTOS AGRICOLAS": "IMPLEMENTOS IMPL AGRICOLAS AGR",
    "INDUSTRIA E COMERCIO": "INDUSTRIA IND",
    "INSUMOS": "INSUMOS INS",
    "IRRIGACAO": "IRRIGACAO IRRIG",
    "LATICINIOS": "LATICINIOS LATIC LAT",
    "LUBRIFICANTES": "LUBRIFICANTES LUBRIF LUB",
    "MAQUINAS": "MAQUINAS MAQ",
    "MATERIAIS DE CONSTRUCAO": "MATERIAIS MAT CONSTRUCAO CONST",
    "NUTRICAO ANIMAL": "NUTRICAO NUTR ANIMAL ANIM",
    "PECAS": "PECAS PEC",
    "PNEUS": "PNEUS PN",
    "REFRIGERACAO": "REFRIGERACAO REFRIG",
    "SEGUROS": "SEGUROS SEG",
    "SEMENTES": "SEMENTES SEM",
    "SERVICOS MECANICOS": "SERVICOS SERV MECANICOS MEC",
    "TELECOMUNICACOES": "TELECOMUNICACOES TELECOM TELEC TEL",
    "TRANSPORTES": "TRANSPORTES TRANSP TRANSPORTADORA",
    "TRATORES": "TRATORES TRAT",
    "VETERINARIA": "VETERINARIA VET",
}
WORD_BUSINESS = {w: b for b, ws in BUSINESS.items() for w in ws.split()} | {"COMERCIO": "", "COM": "", "COML": "", "COMERCIAL": ""}
_LONG = [w for w in WORD_BUSINESS if len(w) >= 6]
# Legal forms, branch words and particles.
LEGAL = set("LTDA ME EPP EIRELI SA CIA MEI LTD LDA LIMITADA".split())
PARTICLE = set("DE DA DO DAS DOS E".split())
BRANCH = re.compile(r"\bFILIAL\s*\d*|\bFIL\b\.?\s*(?:NORTE|SUL|LESTE|OESTE|\d+)?|\bMATRIZ\b|\bUN(?:IDADE)?\b\.?\s*\d+|-\s*CD\b|\((?:SITIO|FAZENDA|MATRIZ|CD)\)|\bLOJA\s*\d+")
# Fillers typed where no supplier is known.
FILLER = {"", "DIVERSOS", "NAO IDENTIFICADO", "N IDENTIFICADO", "DESCONHECIDO", "FORNECEDOR", "FORNECEDORES", "NAO INFORMADO", "UNKNOWN", "NA", "N A", "TESTE", "OUTROS", "NULL", "NONE", "SEM NOME", "A IDENTIFICAR", "CONSUMIDOR", "VARIOS", "NAO CONSTA", "SEM FORNECEDOR", "BENEFICIARIO", "IDENTIFICAR", "PENDENTE", "VERIFICAR", "SUPPLIER", "XXX", "FAVORECIDO", "EMITENTE"}
# Given names and the short forms in use for them.
SHORT = {
    "ALEXANDRE": "XANDE ALE ALEX XANDAO LEXANDRE", "ANTONIO": "TONINHO TONHO TONI TOINHO", "APARECIDA": "CIDA CIDINHA APARECIDINHA", "BEATRIZ": "BIA BEA", "CATARINA": "CATA CATI CATITA CATINHA KATIA CACA", "CLAUDIO": "CLAUDINHO CAU CACO",
    "DANIEL": "DANI DANIELZINHO DAN", "EDUARDO": "DUDU EDU DUDA", "FERNANDO": "NANDO FE FERNANDINHO", "FRANCISCO": "CHICO CHIQUINHO KIKO", "GABRIELA": "GABI BIBI BIELA GABRIELINHA", "GERALDO": "GEGE GERALDINHO", "HELENA": "LENA LENINHA HELENINHA",
    "ISABEL": "BEL ISA BELINHA", "JOAQUIM": "QUIM QUINZINHO QUINCAS JOCA", "JOSE": "ZE ZECA ZEZINHO JUCA", "LEONARDO": "LEO NARDO LEOZINHO", "LUIZ": "LUIZINHO LULU LUISINHO LUIS", "MARGARIDA": "GUIDA MAGUI MARGA", "MARIA": "MARIAZINHA MARIINHA MARI", "NORBERTO": "BERTO NONO NORBE NOBINHO NORBERTINHO",
    "OTAVIO": "TAVINHO OTAVINHO TAVIO", "PATRICIA": "PATI TICIA PATY PATRI", "RAIMUNDO": "MUNDO MUNDINHO RAI", "ROBERTO": "BETO BETINHO ROBERTINHO", "SEBASTIAO": "TIAO BASTIAO SEBA TIAOZINHO", "TEREZINHA": "TEREZA TETE TEREZ TECA", "ULISSES": "ULI", "VICENTE": "VICENTINHO VIVI CENTE VICE", "WANDA": "WANDINHA VANDA",
}
FIRST = {w: g for g, ws in SHORT.items() for w in [g, *ws.split()]}


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbouring letters swapped as one edit; ``most + 1`` if larger.

    Only cells within ``most`` of the diagonal are filled, so the work follows the
    length of the words, however long they are.
    """
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return far
    if a == b:
        return 0
    # what is equal at both ends takes no edit
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    while n > k and m > k and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    if not n or not m:
        return min(n + m, far)
    width = 2 * most + 1
    prev2, prev = None, [j - most if j >= most else far for j in range(width)]
    for i in range(1, n + 1):
        row = [far] * width
        for d in range(width):
            j = i + d - most
            if j < 0 or j > m:
                continue
            if j == 0:
                row[d] = i if i < far else far
                continue
            v = prev[d] + (a[i - 1] != b[j - 1])
            if d + 1 < width and prev[d + 1] + 1 < v:
                v = prev[d + 1] + 1
            if d and row[d - 1] + 1 < v:
                v = row[d - 1] + 1
            if prev2 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and prev2[d] + 1 < v:
                v = prev2[d] + 1
            row[d] = v if v < far else far
        if min(row) > most:
            return far
        prev2, prev = prev, row
    return min(prev[m - n + most], far)


def edits(n: int) -> int:
    """Edits allowed in a word of n letters; words too short for an edit to mean the same word must be equal."""
    return 0 if n < 4 else 1 if n < 6 else 2


def letters_of(w: str) -> int:
    """The letters in use as bits."""
    out = 0
    for c in w:
        out |= 1 << (ord(c) & 31)
    return out


#: Words that may be misspelt: lines of business of six letters and more, then given names; with length, letters, edits and meaning.
_FUZZY = [(x, len(x), letters_of(x), 1 if len(x) < 9 else 2, ("business", WORD_BUSINESS[x])) for x in _LONG] + [(x, len(x), letters_of(x), 1, ("given", x)) for x in SHORT if len(x) >= 6]


@lru_cache(400_000)
def word_kind(w: str) -> tuple[str, str]:
    """('business', code), ('given', name), ('drop', '') or ('core', word) for one word."""
    if w in LEGAL or w in PARTICLE:
        return "drop", ""
    if w in WORD_BUSINESS:
        return "business", WORD_BUSINESS[w]
    if w in FIRST:
        return "given", FIRST[w]
    n = len(w)
    if n >= 6:
        mask = letters_of(w)
        for x, m, letters, most, kind in _FUZZY:
            # an edit changes the length by one and the letters in use by two at most
            if -most <= m - n <= most and (letters ^ mask).bit_count() <= 2 * most and osa(w, x, most) <= most:
                return kind
    if len(w) >= 4:  # a line of business cut off at the end of a narrow field
        begun = {WORD_BUSINESS[x] for x in _LONG if x.startswith(w)}
        if len(begun) == 1:
            return "business", begun.pop()
    return "core", w


def parse_name(raw: str | None) -> tuple[list[str], list[str], list[str]] | None:
    """(core words, given names, lines of business) of a spelling; None for no supplier."""
    if not raw:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", raw.upper().replace("Mª", "MARIA")) if not unicodedata.combining(c))
    if re.sub(r"[^A-Z0-9]+", " ", s).strip() in FILLER:
        return None
    s = re.sub(r"\bS\s*[/.]\s*A\b\.?|\bS\.A\b\.?", " SA ", BRANCH.sub(" ", s))
    core, given, biz = [], [], []
    for w in re.findall(r"[A-Z]+", s):
        kind, v = word_kind(w)
        if kind == "business":
            if v and v not in biz:
                biz.append(v)
        elif kind == "given":
            given.append(v)
        elif kind == "core":
            core.append(v)
    if "IMPLEMENTOS AGRICOLAS" in biz and re.search(r"\bAGR\b", s) and not re.search(r"\bIMPL", s):
        biz.remove("IMPLEMENTOS AGRICOLAS")  # AGR alone may begin AGROPECUARIA as well
    if "PECAS" in biz and "INDUSTRIA E COMERCIO" in biz:
        biz.remove("INDUSTRIA E COMERCIO")
    # of two given names in a company's name or a person's, all count as words of the name
    return (core, given, biz) if core or given else None


def best_assignment(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment of rows to columns, any number of both; pairs of gain > 0.

    Shortest augmenting paths with potentials (Hungarian method), cubic in the number of words.
    """
    n, m = len(gain), len(gain[0]) if gain else 0
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in best_assignment([list(c) for c in zip(*gain)]))
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[at]:
            used[at] = True
            row, step, nxt = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -gain[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and gain[match[j] - 1][j - 1] > 0)


@lru_cache(400_000)
def word_gain(a: str, b: str) -> float:
    """1 for equal words, less by each edit, 0.3 for an initial or abbreviation, 0 if they cannot be the same word."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.3
    if len(a) == 1 or len(b) == 1:
        return 0.3 if a[0] == b[0] else 0.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) > 2:
        return 0.4
    k = edits(max(len(a), len(b)))
    d = osa(a, b, k)
    return 1 - 0.15 * d if d <= k else 0.0


def align(a: tuple, b: tuple) -> str | None:
    """'full' if two parsed names are the same beyond doubt, 'part' if they can be, None if they differ."""
    return aligned(a, b)[0]


def aligned(a: tuple, b: tuple) -> tuple[str | None, int]:
    """What :func:`align` says, and the edits between the words of the two names that were taken for each other."""
    (ca, ga, ba), (cb, gb, bb) = a, b
    if ba and bb and not set(ba) & set(bb):
        return None, 0
    one, two, changed = list(ca), list(cb), 0
    # words run together on one side
    for x, y in ((one, two), (two, one)):
        for w in list(x):
            if len(w) >= 8:
                for p, q in itertools.permutations(range(len(y)), 2):
                    j = y[p] + y[q]
                    if len(y[p]) > 1 and len(y[q]) > 1 and osa(w, j, 2) <= 2 and not any(osa(w, z, 2) <= 2 for z in y):
                        k = x.index(w)
                        x[k : k + 1] = [y[p], y[q]]
                        changed += osa(w, j, 2)
                        break
    given = {"same": 0, "initial": 0}
    fa, fb = list(ga), list(gb)
    for g in list(fa):
        if g in fb:
            fa.remove(g)
            fb.remove(g)
            given["same"] += 1
    one, two = one + fa, two + fb
    known = set(SHORT)
    gain = [[0.0 if x in known and y in known and x != y else word_gain(x, y) for y in two] for x in one]
    picks = best_assignment(gain)
    left = [w for i, w in enumerate(one) if i not in {p for p, _ in picks} and len(w) > 1]
    right = [w for j, w in enumerate(two) if j not in {q for _, q in picks} and len(w) > 1]
    if left and right:
        return None, 0
    # initials that fit no word of the other side speak against it
    odd = [w for i, w in enumerate(one) if len(w) == 1 and i not in {p for p, _ in picks}], [w for j, w in enumerate(two) if len(w) == 1 and j not in {q for _, q in picks}]
    if odd[0] and right or odd[1] and left:
        return None, 0
    changed += sum(round((1 - gain[i][j]) / 0.15) for i, j in picks if gain[i][j] >= 0.65)
    strong = sum(gain[i][j] >= 0.65 and not (one[i] in known and two[j] in known) for i, j in picks)
    weak = len(picks) - strong
    company = bool(ba or bb)
    same_biz = bool(ba and bb)
    if strong >= 2 and (same_biz or given["same"] or not company and not left and not right):
        return "full", changed
    if strong >= 2 or strong == 1 and (same_biz or given["same"] or weak):
        return "part", changed
    return None, 0


#: Letters of a word that the delete index looks at: two words within k edits share a form of their beginnings with up to k letters deleted.
BEGIN = 10


def deletes(word: str, k: int) -> set[str]:
    """The word's beginning and everything left of it after up to k deletions.

    Exact for whole words: where the beginnings align, each edit takes at most one
    letter from either, and letters that one side has in excess are among its own
    deletions.  Longer words cost no more entries.
    """
    out = {word[:BEGIN]}
    edge = out
    for _ in range(k):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out = out | edge
    return out


@F.pandas_udf(T.StructType([T.StructField("core", T.ArrayType(T.StringType())), T.StructField("given", T.ArrayType(T.StringType())), T.StructField("biz", T.ArrayType(T.StringType()))]))
def parsed(s: pd.Series) -> pd.DataFrame:
    rows = [parse_name(x) for x in s]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["core", "given", "biz"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def delete_neighbours(word: pd.Series) -> pd.Series:
    return pd.Series([sorted(deletes(w, edits(len(w)))) for w in word])


@F.pandas_udf(T.BooleanType())
def close_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, k) <= k for x, y in zip(a, b) for k in (min(edits(len(x)), edits(len(y))),)], dtype=bool)


def _align_udf():
    @F.pandas_udf(T.StructType([T.StructField("how", T.StringType()), T.StructField("changed", T.IntegerType())]))
    def run(ca: pd.Series, ga: pd.Series, ba: pd.Series, cb: pd.Series, gb: pd.Series, bb: pd.Series) -> pd.DataFrame:
        rows = [aligned((list(p), list(q), list(r)), (list(x), list(y), list(z))) for p, q, r, x, y, z in zip(ca, ga, ba, cb, gb, bb)]
        return pd.DataFrame({"how": pd.Series([h for h, _ in rows], dtype=object), "changed": pd.Series([n for _, n in rows], dtype="int32")})

    return run


def near_words(words: DataFrame, runs: DataFrame) -> DataFrame:
    """(w, v): words within one or two edits of each other, both ways and with themselves, and pairs of words run together with the word they give.

    ``words`` has the distinct words w, ``runs`` the distinct pairs of words written
    as one, w.  Both go into the symmetric-delete index; runs meet only words long
    enough to be one.  The lengths of two words close to each other differ by two at
    most, which is checked before the edit distance.
    """
    entry = lambda d: d.select("w", F.explode(delete_neighbours("w")).alias("k")).select("w", F.xxhash64("k").alias("k"))
    index = cut(entry(words.filter("length(w) >= 4").select("w")).withColumn("run", F.lit(False)).unionByName(entry(runs.select("w")).withColumn("run", F.lit(True))))
    own, long, run = index.filter("not run"), index.filter("not run and length(w) >= 8"), index.filter("run")
    fits = F.abs(F.length("i.w") - F.length("j.w")) <= 2
    meet = lambda x, y, cond: x.alias("i").join(y.alias("j"), "k").filter(cond & fits).select(F.col("i.w").alias("w"), F.col("j.w").alias("v"), F.col("i.run").alias("run")).distinct()
    met = meet(own, own, F.col("i.w") < F.col("j.w")).unionByName(meet(run, long, F.lit(True)))
    # evaluated once: the mirror reads what is written here
    near = cut(met.filter(close_words("w", "v")))
    back = near.filter("not run").select(F.col("v").alias("w"), F.col("w").alias("v"))
    return near.select("w", "v").unionByName(back).unionByName(words.select("w", F.col("w").alias("v"))).distinct()


def candidates(forms: DataFrame) -> DataFrame:
    """(fid, gid), fid < gid: forms that can be one supplier: a close word and something else in common.

    To be linked, two forms need a close word and also another close word, an
    initial or an abbreviation, a line of business or a given name.  Therefore a form
    is looked up under (close word, first letter of another word), (close word, line
    of business) and (close word, given name), never under a word alone - a word that
    many forms share is split by what stands beside it.  Under a word alone it is
    looked up only where an edit changed the word's first letter, or where two of
    its words run together give the word; both are rare for any one word.
    """
    letters = lambda w: F.transform(F.filter(F.concat("core", "given"), lambda x: x != w), lambda x: F.concat(F.lit("l:"), F.substring(x, 1, 1)))
    beside = F.array_distinct(F.concat(letters(F.col("w")), F.transform("biz", lambda x: F.concat(F.lit("b:"), x)), F.transform("given", lambda x: F.concat(F.lit("g:"), x)), F.when(F.size(F.filter("core", lambda x: x == F.col("w"))) > 1, F.array(F.concat(F.lit("l:"), F.substring("w", 1, 1)))).otherwise(F.array().cast("array<string>"))))
    words = cut(forms.select("fid", "core", "given", "biz", F.explode(F.array_distinct(F.filter("core", lambda x: F.length(x) > 1))).alias("w")).select("fid", "w", beside.alias("beside")))
    long = F.array_distinct(F.filter("core", lambda x: F.length(x) >= 4))
    runs = cut(forms.select("fid", long.alias("c")).select("fid", F.explode(F.flatten(F.transform("c", lambda p: F.transform(F.filter("c", lambda q: q != p), lambda q: F.concat(p, q))))).alias("w")).distinct())
    near = cut(near_words(words.select("w").distinct(), runs.select("w").distinct()))
    every = F.lit("*")
    here = words.select(F.col("fid").alias("gid"), F.col("w").alias("v"), F.explode(F.concat("beside", F.array(every))).alias("by"))
    moved = F.substring("w", 1, 1) != F.substring("v", 1, 1)
    there = words.join(near, "w").select("fid", "v", F.explode(F.when(moved, F.concat("beside", F.array(every))).otherwise(F.col("beside"))).alias("by"))
    there = there.unionByName(runs.join(near, "w").select("fid", "v", every.alias("by")))
    met = there.join(here, ["v", "by"]).filter("fid <> gid")
    return met.select(F.least("fid", "gid").alias("fid"), F.greatest("fid", "gid").alias("gid")).distinct()


def name_groups(names: DataFrame, col: str = "name") -> DataFrame:
    """(name, group): spellings of one supplier share a group; spellings of no supplier and null are left out.

    1. Spellings are parsed and folded to distinct forms (words without accents,
       legal forms, branches and particles, given names without short forms).
    2. Distinct words go into a symmetric-delete index: two words within one or two
       edits, as many as the shorter one allows, share a form with as many letters deleted.  Words run together are
       found as they are indexed, too; words of two and three letters must be equal.
    3. Forms that share a close word and one thing more (see :func:`candidates`) are
       aligned by optimal assignment of their words, initials and abbreviations
       permitted, however many words they have.
    4. Sure alignments are joined into groups by minimum labels.  A group without a
       complete form (words dropped, initials only) joins the group with a complete
       form that it fits with the fewest edits; if several fit it equally well it stays
       apart.  Among very many suppliers most short names come close to several, but few
       are equal to several.
       A name of initials alone is linked to nothing.

    Nothing is capped.  A word shared by n forms costs as many comparisons as forms
    share it and a letter, line of business or given name beside it.
    """
    d = names.select(F.col(col).alias("name")).filter("name is not null").distinct()
    d = d.withColumn("p", parsed("name")).filter("p.core is not null").select("name", "p.*")
    d = cut(d.withColumn("form", F.concat_ws("|", F.array_join(F.array_sort("core"), " "), F.array_join(F.array_sort("given"), " "), F.array_join(F.array_sort("biz"), " "))))
    # numbered as they are written: no two forms share a number
    forms = cut(d.groupBy("form").agg(F.min(F.struct("name", "core", "given", "biz")).alias("f")).select("form", "f.core", "f.given", "f.biz").withColumn("fid", F.monotonically_increasing_id()))
    cand = candidates(forms)
    f = forms.select("fid", "core", "given", "biz")
    g = f.select([F.col(c).alias({"fid": "gid", "core": "core2", "given": "given2", "biz": "biz2"}[c]) for c in f.columns])
    pairs = cut(cand.join(f, "fid").join(g, "gid").withColumn("a", _align_udf()("core", "given", "biz", "core2", "given2", "biz2")).filter("a.how is not null").select("fid", "gid", "a.how", "a.changed"))
    sure = connected_groups(pairs.filter("how = 'full'"), "fid", "gid", "fid", "grp")
    lab = cut(forms.select("fid").join(sure, "fid", "left").select("fid", F.coalesce("grp", "fid").alias("grp")))
    # complete forms: two whole words and a line of business or a given name; they anchor their groups
    whole = F.size(F.filter("core", lambda w: F.length(w) > 1)) >= 2
    anchors = lab.join(forms.filter(whole & ((F.size("biz") > 0) | (F.size("given") > 0))).select("fid"), "fid", "left_semi").select("grp").distinct()
    part = pairs.filter("how = 'part'").select("fid", "gid", "changed")
    both = part.unionByName(part.select(F.col("gid").alias("fid"), F.col("fid").alias("gid"), "changed"))
    gl = both.join(lab, "fid").join(lab.select(F.col("fid").alias("gid"), F.col("grp").alias("other")), "gid").filter("grp <> other").groupBy("grp", "other").agg(F.min("changed").alias("changed"))
    gl = gl.join(anchors, "grp", "left_anti").join(anchors.withColumnRenamed("grp", "other"), "other", "left_semi")
    fits = gl.groupBy("grp", "changed").agg(F.count("*").alias("n"), F.min("other").alias("top"))
    joined = fits.groupBy("grp").agg(F.min(F.struct("changed", "n", "top")).alias("best")).filter("best.n = 1").select("grp", "best.top")
    out = d.select("name", "form").join(forms.select("form", "fid"), "form").join(lab, "fid").join(joined, "grp", "left")
    return out.select("name", F.coalesce("top", "grp").alias("group"))


def variant_pairs(names: DataFrame, col: str = "name") -> DataFrame:
    """name_a < name_b: two different spellings, as stored, of one supplier; see :func:`name_groups`.

    Null, empty and filler names give no pair; repeated names count once; an empty
    table gives no rows.  Long names and long words are compared whole.  Other columns
    are ignored.
    """
    g = cut(name_groups(names, col))
    # compared as bytes, which orders UTF-8 by code point
    return g.select(F.col("name").alias("name_a"), "group").join(g.select(F.col("name").alias("name_b"), "group"), "group").filter("name_a < name_b").select("name_a", "name_b")


def supplier_names(transacoes: DataFrame, golden: DataFrame) -> DataFrame:
    """Distinct spellings of both name fields."""
    return transacoes.select(F.col("supplier_clean").alias("name")).unionByName(golden.select(F.col("ground_truth.fornecedor").alias("name"))).filter("name is not null").distinct()
