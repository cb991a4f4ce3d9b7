"""Dates typed by people, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_date(c: Column) -> Column:
    """ISO text of dd/mm/yyyy, dd.mm.yyyy, dd-mm-yyyy, two-digit years and ISO texts, without checking that the day exists."""
    s = F.substring(F.trim(c), 1, 10)
    full = F.regexp_replace(s, r"^(\d{2})[./-](\d{2})[./-](\d{4})$", "$3-$2-$1")
    year = F.regexp_extract(s, r"^\d{2}[./-]\d{2}[./-](\d{2})$", 1).try_cast("int")
    short = F.concat(F.when(year >= 50, "19").otherwise("20"), F.regexp_replace(s, r"^(\d{2})[./-](\d{2})[./-](\d{2})$", "$3-$2-$1"))
    out = F.when(year.isNotNull(), short).otherwise(full)
    return F.when(out.rlike(r"^\d{4}-\d{2}-\d{2}$"), out)


def parse_date(c: Column) -> Column:
    """Date of a typed text; null if it is none or the day does not exist."""
    return F.try_to_date(normalise_date(c), "yyyy-MM-dd")


def to_brazilian(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def ordered_dates(emission: Column, due: Column) -> tuple[Column, Column]:
    """(emission, due), swapped where the due date comes first."""
    swap = due < emission
    return F.when(swap, due).otherwise(emission), F.when(swap, emission).otherwise(due)


def date_issues(emission: Column, due: Column, payment: Column, today: Column) -> Column:
    """Array of what is wrong with a row's dates; empty if nothing is."""
    return F.array_compact(F.array(
        F.when(emission > today, "emission_in_future"),
        F.when(due < emission, "due_before_emission"),
        F.when(payment < emission, "payment_before_emission"),
        F.when((F.year(emission) < 2020) | (F.year(emission) > F.year(today) + 1), "year_out_of_range"),
    ))
