"""Checksummed identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def figures(d: Column) -> Column:
    """Array of the figures of a text of figures."""
    return F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x: x.cast("int"))


def modulo_11(d: Column, weights: list[int]) -> Column:
    """Check figure: 11 - weighted sum mod 11, and 0 where that exceeds 9."""
    w = F.array(*[F.lit(x) for x in weights])
    s = F.aggregate(F.zip_with(figures(d), w, lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda a, x: a + x)
    r = s % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def modulo_10(d: Column) -> Column:
    """Check figure with weights 2, 1 from the right, figures of products added."""
    twice = F.transform(F.reverse(figures(d)), lambda x, i: x * F.when(i % 2 == 0, 2).otherwise(1))
    s = F.aggregate(twice, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10)
    return (10 - s % 10) % 10


CNPJ_1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CNPJ_2 = [6, *CNPJ_1]
CPF_1 = list(range(10, 1, -1))
CPF_2 = list(range(11, 1, -1))
KEY = [4, 3, 2] + [9, 8, 7, 6, 5, 4, 3, 2] * 5


def _checked(d: Column, n: int, first: list[int], second: list[int], repeats: bool) -> Column:
    a, b = modulo_11(F.substring(d, 1, n - 2), first), modulo_11(F.substring(d, 1, n - 1), second)
    ok = (a == F.substring(d, n - 1, 1).try_cast("int")) & (b == F.substring(d, n, 1).try_cast("int"))
    same = d.rlike(r"^(\d)\1*$")
    return F.when(F.length(d) == n, ok & (F.lit(True) if repeats else ~same)).otherwise(False)


def is_cnpj(c: Column, repeats: bool = False) -> Column:
    """True for a company number with right check figures; ``repeats`` lets one figure repeated pass."""
    return _checked(digits_only(c), 14, CNPJ_1, CNPJ_2, repeats)


def is_cpf(c: Column, repeats: bool = False) -> Column:
    return _checked(digits_only(c), 11, CPF_1, CPF_2, repeats)


def is_access_key(c: Column) -> Column:
    d = digits_only(c)
    return F.when(F.length(d) == 44, modulo_11(F.substring(d, 1, 43), KEY) == F.substring(d, 44, 1).try_cast("int")).otherwise(False)


def key_number(c: Column) -> Column:
    """Invoice number within a 44-figure key; null for other lengths."""
    d = digits_only(c)
    return F.when(F.length(d) == 44, F.substring(d, 26, 9).cast("bigint"))


def key_fields(c: Column) -> Column:
    """Struct of state, month, company number, model, series, number of a 44-figure key."""
    d = digits_only(c)
    s = F.struct(F.substring(d, 1, 2).alias("state"), F.substring(d, 3, 4).alias("month"), F.substring(d, 7, 14).alias("cnpj"), F.substring(d, 21, 2).alias("model"), F.substring(d, 23, 3).alias("series"), F.substring(d, 26, 9).cast("bigint").alias("number"))
    return F.when(F.length(d) == 44, s)


def is_slip_line(c: Column) -> Column:
    """True if the three fields of a 47-figure slip line have right check figures."""
    d = digits_only(c)
    ok = F.lit(True)
    for start, n in ((1, 9), (11, 10), (22, 10)):
        ok = ok & (modulo_10(F.substring(d, start, n)) == F.substring(d, start + n, 1).try_cast("int"))
    return F.when(F.length(d) == 47, ok).otherwise(False)


def line_length_ok(c: Column) -> Column:
    return F.length(digits_only(c)).isin(44, 47, 48)


def slip_value(c: Column) -> Column:
    """Cents printed in a slip line; null where none."""
    d = digits_only(c)
    return F.when(F.length(d) >= 44, F.nullif(F.substring(d, 38, 10).try_cast("bigint"), F.lit(0)))


def slip_due(c: Column) -> Column:
    """Due date of a slip line: 1997-10-07 plus its factor; null for factor 0."""
    d = digits_only(c)
    factor = F.nullif(F.substring(d, 34, 4).try_cast("int"), F.lit(0))
    return F.when(F.length(d) >= 44, F.date_add(F.lit("1997-10-07").cast("date"), factor))


# Figures that readers take for each other.
CONFUSED = {"0": ["6", "8"], "1": ["7"], "3": ["8"], "5": ["6"], "6": ["0", "5", "8"], "7": ["1"], "8": ["3", "0", "6"]}


def repaired_key(c: Column) -> Column:
    """First key with a right check figure: the key itself, then likely confusions by position, then any figure in the first twenty.

    The check is linear, so replacing figure ``a`` at weight ``w`` by ``b`` moves
    the weighted sum by ``w * (b - a)``; each candidate costs one comparison and no
    checksum is summed twice.  Null where no candidate fits or the length is not 44.
    """
    d = digits_only(c)
    f = figures(d)
    w = F.array(*[F.lit(x) for x in KEY])
    base = F.aggregate(F.zip_with(F.slice(f, 1, 43), w, lambda a, b: a * b), F.lit(0), lambda a, x: a + x)
    last = F.element_at(f, 44)
    fits = lambda s: F.when(s % 11 < 2, 0).otherwise(11 - s % 11) == last
    likely = F.create_map(*[x for k, v in CONFUSED.items() for x in (F.lit(int(k)), F.array(*[F.lit(int(y)) for y in v]))])
    every = F.array(*[F.lit(x) for x in range(10)])
    option = lambda i, y: F.struct(i.alias("i"), y.alias("y"))
    one = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(43)), lambda i: F.transform(F.coalesce(F.try_element_at(likely, F.get(f, i - 1)), F.array().cast("array<int>")), lambda y: option(i, y))))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.transform(every, lambda y: option(i, y))))
    good = F.filter(F.concat(one, two), lambda o: (F.get(f, o["i"] - 1) != o["y"]) & fits(base + F.get(w, o["i"] - 1) * (o["y"] - F.get(f, o["i"] - 1))))
    first = F.get(good, F.lit(0))
    fixed = F.concat(F.substring(d, F.lit(1), first["i"] - 1), first["y"].cast("string"), F.substring(d, first["i"] + 1, F.lit(44)))
    return F.when(F.length(d) == 44, F.when(fits(base), d).otherwise(fixed))


# Letters read for figures in a company number.
CNPJ_READ_AS, CNPJ_MEANT = "BOQILSGZ?", "800115627"


def fixed_cnpj(c: Column) -> Column:
    """'99.999.999/9999-99' of a misread company number; null unless 14 figures come out."""
    d = digits_only(F.translate(F.upper(c), CNPJ_READ_AS, CNPJ_MEANT))
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))
