"""What the name of a filed paper says: DAY_ENTITY_SUPPLIER_AMOUNT_KIND_NUMBER.pdf, as column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of paper that stand before the number.
KINDS = ["BOLETO", "NFE", "NFSE", "FATURA", "CONTRATO", "APOLICE", "CTE", "DAR", "CC"]
_DAY, _EXT, _PLAIN = r"^(\d{2})\.(\d{2})\.(\d{4})_", r"\.[^.]*$", r"^[0-9.]+,?[0-9]*$"
#: The last run of parts that are figures only, each part trimmed.
_RUN = r"(?:^|_)([0-9]+(?:_[0-9]+)*)(?:_[^_]*[^_0-9][^_]*|_)*$"


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _parts(name: Column) -> Column:
    return F.split(name, "_")


def file_date(path: Column) -> Column:
    """ISO day that begins the name; null if there is none."""
    n = base(path)
    return F.when(n.rlike(_DAY), F.concat_ws("-", F.regexp_extract(n, _DAY, 3), F.regexp_extract(n, _DAY, 2), F.regexp_extract(n, _DAY, 1)))


def file_supplier(path: Column) -> Column:
    """Third part of the name, trimmed; null if it has less than three letters."""
    s = F.trim(F.get(_parts(F.regexp_replace(base(path), _EXT, "")), F.lit(2)))
    return F.when(F.length(s) >= 3, s)


def _cents(text: Column) -> Column:
    n = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.floor(F.when(n.rlike(r"^(\d+\.?\d*|\.\d+)$"), n).try_cast("double") * 100).cast("bigint")


def file_amount(path: Column) -> Column:
    """Cents of the first part after the day that has a decimal comma, else of the first that is a plain number; 0 if there is none."""
    rest = F.slice(_parts(base(path)), 2, 1000)
    comma = F.filter(F.transform(rest, lambda p: _cents(F.when(F.contains(p, F.lit(",")), F.regexp_replace(p, r"[^0-9.,]", "")))), lambda v: v.isNotNull())
    plain = F.filter(F.transform(rest, lambda p: _cents(F.when(p.rlike(_PLAIN), p))), lambda v: v.isNotNull())
    return F.coalesce(F.get(comma, F.lit(0)), F.get(plain, F.lit(0)), F.lit(0).cast("bigint"))


def file_number(path: Column) -> Column:
    """What follows the last kind of paper in the name; without a kind the last run of figures; null if there is neither."""
    p = _parts(F.regexp_replace(base(path), _EXT, ""))
    kinds = F.transform(p, lambda x, i: F.when(F.upper(x).rlike("^(" + "|".join(KINDS) + ")"), i))
    at = F.array_max(kinds)
    tail = F.trim(F.array_join(F.slice(p, at + 2, 1000), "_"))
    run = F.regexp_extract(F.array_join(F.transform(p, lambda x: F.trim(x)), "_"), _RUN, 1)
    return F.when(F.length(tail) > 0, tail).otherwise(F.when(run != "", run))


def sql(path: str) -> dict[str, str]:
    """The same as SQL of a path column: date, supplier, amount, number."""
    n = f"regexp_extract({path}, '([^/\\\\]*)$', 1)"
    stem = f"regexp_replace({n}, '\\.[^.]*$', '')"
    p = f"string_split({stem}, '_')"
    rest = f"string_split({n}, '_')[2:]"
    cents = "floor(try_cast(CASE WHEN regexp_matches(replace(replace(%s, '.', ''), ',', '.'), '^(\\d+\\.?\\d*|\\.\\d+)$') THEN replace(replace(%s, '.', ''), ',', '.') END AS DOUBLE) * 100)::BIGINT"
    keep = "regexp_replace(p, '[^0-9.,]', '', 'g')"
    comma = f"list_filter(list_transform(list_filter({rest}, lambda p: contains(p, ',')), lambda p: {cents % (keep, keep)}), lambda v: v IS NOT NULL)[1]"
    plain = f"list_filter(list_transform(list_filter({rest}, lambda p: regexp_matches(p, '{_PLAIN}')), lambda p: {cents % ('p', 'p')}), lambda v: v IS NOT NULL)[1]"
    at = f"list_max(list_transform({p}, lambda p, i: CASE WHEN regexp_matches(upper(p), '^({'|'.join(KINDS)})') THEN i END))"
    tail = f"trim(array_to_string(({p})[{at} + 1:], '_'))"
    run = f"nullif(regexp_extract(array_to_string(list_transform({p}, lambda p: trim(p)), '_'), '{_RUN}', 1), '')"
    return {
        "date": f"CASE WHEN regexp_matches({n}, '{_DAY}') THEN concat_ws('-', regexp_extract({n}, '{_DAY}', 3), regexp_extract({n}, '{_DAY}', 2), regexp_extract({n}, '{_DAY}', 1)) END",
        "supplier": f"CASE WHEN length(trim({p}[3])) >= 3 THEN trim({p}[3]) END",
        "amount": f"coalesce({comma}, {plain}, 0)",
        "number": f"CASE WHEN {at} IS NOT NULL AND length({tail}) > 0 THEN {tail} ELSE {run} END",
    }
