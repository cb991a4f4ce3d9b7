"""Money in integer cents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount_to_cents(c: Column, exact: bool = False) -> Column:
    """Cents of a Brazilian amount such as 'R$ 1.234,56'; 0 where it is no number, null for null.

    By default the product is cut off as a double, so '19,99' gives 1998;
    ``exact`` goes through a decimal and gives 1999.
    """
    s = F.regexp_replace(F.regexp_replace(c, r"[R$ .]", ""), ",", ".")
    v = s.try_cast("decimal(20,4)") * 100 if exact else s.try_cast("double") * 100
    return F.when(c.isNotNull(), F.coalesce(v.cast("bigint"), F.lit(0)))


def cents_to_display(c: Column) -> Column:
    """'1.234,56' for 123456."""
    return F.translate(F.format_number(c / 100, 2), ",.", ".,")


def parse_money(c: Column) -> Column:
    """Cents of an amount in Brazilian ('1.234,56'), American ('1,234.56') or plain form; 0 if unreadable."""
    s = F.regexp_replace(c, r"[^\d.,]", "")
    comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    brazil = (comma > 0) & ((dot == 0) | (comma < dot))
    plain = F.when(brazil, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(s, ",", ""))
    return F.when(c.isNotNull(), F.coalesce((plain.try_cast("decimal(20,4)") * 100).cast("bigint"), F.lit(0)))


def parse_separated(c: Column) -> Column:
    """Cents of an amount with any separators: with two or more, what follows the last is the decimals."""
    s = F.regexp_replace(c, r"[^0-9,.]", "")
    n = F.length(F.regexp_replace(s, r"[0-9]", ""))
    digits = F.regexp_replace(s, r"[,.]", "")
    whole = F.when(n >= 2, digits.try_cast("bigint")).otherwise((F.regexp_replace(s, ",", ".").try_cast("decimal(20,4)") * 100).cast("bigint"))
    return F.when(c.isNotNull(), F.coalesce(whole, F.lit(0)))


# Letters that readers take for figures, and the figures meant.
READ_AS, MEANT = "OoDQIliBSsZG", "000111185526"


def fix_currency_text(c: Column) -> Column:
    """Text with letters read for figures put right, where any of them occurs; the currency sign is dropped."""
    s = F.trim(F.regexp_replace(c, r"(?i)R\$", ""))
    return F.when(s.rlike(r"(?i)[OIDSZGL]"), F.translate(s, READ_AS, MEANT)).otherwise(s)


# Labels before an amount, with the confidence each gives, in order of rank.
AMOUNT_LABELS = [
    (r"VALOR\s*TOTAL\s*DA\s*NOTA[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.99),
    (r"\(=\)\s*VALOR\s*(?:DO)?\s*DOCUMENTO\s*R?\$?\s*([\d.]+,\d{2})", 0.98),
    (r"PR[ÊE]MIO\s*TOTAL[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.97),
    (r"PR[ÊE]MIO\s*L[ÍI]QUIDO[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.95),
    (r"(?:TOTAL|VALOR)\s*A\s*PAGAR[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.94),
    (r"VALOR\s*(?:TOTAL|DOCUMENTO|L[ÍI]QUIDO)[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.90),
    (r"VALOR\s*COBRADO[\s:]*R?\$?\s*([\d.]+,\d{2})", 0.85),
    (r"\bTOTAL[\s:]+R?\$?\s*([\d.]+,\d{2})", 0.80),
]
MONEY = r"R\$\s*([\d.]+,\d{2})"


def exact_cents(s: Column) -> Column:
    return F.regexp_replace(s, r"[.,]", "").try_cast("bigint")


def ranked_amount(text: Column) -> tuple[Column, Column]:
    """(cents, confidence): the first label with a positive amount, else the largest amount at 0.5."""
    up = F.upper(text)
    hits = [F.nullif(exact_cents(F.regexp_extract(up, p, 1)), F.lit(0)) for p, _ in AMOUNT_LABELS]
    largest = F.array_max(F.transform(F.regexp_extract_all(up, F.lit(MONEY), F.lit(1)), exact_cents))
    conf = F.when(hits[0].isNotNull(), AMOUNT_LABELS[0][1])
    for h, (_, k) in list(zip(hits, AMOUNT_LABELS))[1:]:
        conf = conf.when(h.isNotNull(), k)
    return F.coalesce(*hits, F.nullif(largest, F.lit(0))), conf.when(largest > 0, 0.5).otherwise(0.0)
