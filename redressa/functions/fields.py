"""Parsing and classing of single complaint fields, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from redressa.functions.text import BLANKS, strip_blanks

# Texts that a CSV reader turns into null.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# A time of day after a date: hour, minute, second, fraction, half of the day, zone.
_TIME = (
    r"(?:[T ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
    r"(?: *([AaPp])\.?[Mm]\.?)?(?: *(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?$"
)
_WEEKDAY = r"^(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,? +)?"
# Fifty years on from 2026; a fixed value, so that results do not change with the clock.
_LAST_CENTURY = "76"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# (pattern of the date, groups that hold year, month and day).
_DATE_FAMILIES = (
    (r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", (3, 1, 2)),
    (r"^(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (_WEEKDAY + r"([A-Za-z]{3})[a-z]*\.?[ -]+(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})", (3, 1, 2)),
    (_WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th)?[ -]+([A-Za-z]{3})[a-z]*\.?,?[ -]+(\d{4})", (3, 2, 1)),
)

DEFAULT_CUTOFF = "2022-11-30"

# Fixed values: (label, substrings), in rule order; a later rule wins.
PRODUCT_RULES = (
    ("Credit reporting", ("credit reporting", "consumer reports")),
    ("Debt collection", ("debt collection",)),
    ("Credit card/prepaid", ("credit card", "prepaid")),
    ("Bank account", ("checking", "savings", "bank account")),
    ("Mortgage", ("mortgage",)),
    ("Student loan", ("student loan",)),
    ("Vehicle loan/lease", ("vehicle loan", "lease")),
    ("Consumer loan", ("payday", "personal loan", "consumer loan")),
    ("Money transfer", ("money transfer", "virtual currency")),
)

RESPONSE_COLUMNS = (
    "response_outcome",
    "monetary_relief",
    "non_monetary_relief",
    "any_relief",
    "closed_with_explanation",
    "closed_response",
)


def null_if_na(value: Column, na_tokens: Iterable[str] = NA_TOKENS) -> Column:
    return F.when(~value.isin(*na_tokens), value)


def parse_date(value: Column) -> Column:
    """Dates with an optional time, in the written forms of ``_DATE_FAMILIES``.

    The family is chosen by pattern, its parts are put into one standard text, and that
    is cast once; no format is tried and failed. Month comes before day unless it cannot.
    Two-digit years from ``_LAST_CENTURY`` on are 19xx. Null when no family fits. Needs a UTC session.
    """
    text = F.trim(value)
    whole = F.lit(None).cast("string")
    for pattern, (year, month, day) in reversed(_DATE_FAMILIES):
        full = pattern + _TIME
        whole = F.when(text.rlike(full), _standard(text, full, year, month, day)).otherwise(whole)
    return whole.try_cast("timestamp")


def _standard(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """``yyyy-MM-dd HH:mm:ss.fraction zone`` of a text that fits ``pattern``."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def number(group: int) -> Column:
        return F.coalesce(part(group).try_cast("int"), F.lit(0))

    y, m, d = part(year), part(month), part(day)
    named = F.position(F.lower(m), F.lit(_MONTHS))
    month_no = F.when(m.rlike(r"^\d"), m.try_cast("int")).otherwise((named + 2) / 3).cast("int")
    day_no = F.coalesce(d.try_cast("int"), F.lit(1))
    swap = (month_no > 12) & (day_no <= 12) & (F.lit(year) == 3)
    month_no, day_no = F.when(swap, day_no).otherwise(month_no), F.when(swap, month_no).otherwise(day_no)
    full_year = F.when(F.length(y) == 2, y.try_cast("int") + F.when(y >= _LAST_CENTURY, 1900).otherwise(2000))
    half, zone = F.lower(part(8)), part(9)
    hour = F.when(half == "", number(4)).otherwise(number(4) % 12 + F.when(half == "p", 12).otherwise(0))
    zone = F.when(zone == "", "Z").otherwise(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.format_string(
        "%04d-%02d-%02d %02d:%02d:%02d.%s%s",
        F.coalesce(full_year, y.try_cast("int")),
        month_no,
        day_no,
        hour,
        number(5),
        number(6),
        F.when(part(7) == "", "0").otherwise(part(7)),
        zone,
    )


def parse_yes_no(value: Column) -> Column:
    v = F.lower(strip_blanks(value))
    return (
        F.when(v.isin("yes", "y", "true", "1"), F.lit(1.0))
        .when(v.isin("no", "n", "false", "0"), F.lit(0.0))
    )


def has_text(text: Column) -> Column:
    """1 when anything but blanks is in the text."""
    return F.coalesce(text.rlike(f"[^{BLANKS}]"), F.lit(False)).cast("int")


def product_group(product: Column) -> Column:
    p = F.lower(product)
    label = F.lit("Other")
    for name, parts in PRODUCT_RULES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(p, F.lit(part))
        label = F.when(hit, F.lit(name)).otherwise(label)
    return label


def response_classes(response: Column) -> dict[str, Column]:
    r = F.lower(F.coalesce(response, F.lit("")))
    non_monetary = F.contains(r, F.lit("non-monetary relief"))
    monetary = F.contains(r, F.lit("monetary relief")) & ~non_monetary
    explained = F.contains(r, F.lit("explanation"))
    outcome = (
        F.when(monetary, F.lit("monetary_relief"))
        .when(non_monetary, F.lit("non_monetary_relief"))
        .when(explained, F.lit("explanation"))
        .otherwise(F.lit("other"))
    )
    return {
        "response_outcome": outcome,
        "monetary_relief": monetary.cast("int"),
        "non_monetary_relief": non_monetary.cast("int"),
        "any_relief": (monetary | non_monetary).cast("int"),
        "closed_with_explanation": explained.cast("int"),
        "closed_response": F.contains(r, F.lit("closed")).cast("int"),
    }


def whole_days(start: Column, end: Column) -> Column:
    """Floor of the difference in days; negative when ``end`` comes first."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint")


def calendar_fields(day: Column, cutoff: str) -> dict[str, Column]:
    return {
        "complaint_year": F.year(day),
        "complaint_month": F.date_format(day, "yyyy-MM"),
        "complaint_quarter": F.concat(
            F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")
        ),
        "post_cutoff": F.coalesce((day >= F.lit(cutoff).cast("timestamp")).cast("int"), F.lit(0)),
    }
