"""Code cleaning and the predicates that say whether a code is real."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_OPS = ("GT", "GTE", "LT", "LTE", "EQ", "BETWEEN")

# Operator names with their numeric codes, and the symbols that stand for them.
OPERATOR_CODES = {"EXISTS": 0, "NOT_EXISTS": 1, "GT": 2, "GTE": 3, "LT": 4, "LTE": 5, "EQ": 6, "BETWEEN": 7}
OPERATOR_SYMBOLS = {">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE", "=": "EQ", "==": "EQ"}
ENTITY_TYPES = ("diagnosis", "medication", "lab", "procedure")


def clean_dx(code: Column) -> Column:
    """Diagnosis code without dots or outer spaces, upper case."""
    return F.upper(F.regexp_replace(F.trim(code), r"\.", ""))


def strip_float_suffix(code: Column) -> Column:
    """Undo the ``.0`` a code picks up when a reader takes it for a float."""
    return F.trim(F.regexp_replace(code, r"\.0$", ""))


def pad_ndc(code: Column) -> Column:
    """Digits of an NDC, zero-padded to 11; longer ones and empty ones stay as they are."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(code), r"\.0+$", ""), r"[^0-9]", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) < 11), F.lpad(digits, 11, "0")).otherwise(digits)


def normalize_code(entity_type: Column, code: Column) -> Column:
    text = code.cast("string")
    return (
        F.when(entity_type == "diagnosis", clean_dx(text))
        .when(entity_type == "medication", pad_ndc(text))
        .otherwise(F.trim(text))
    )


def is_placeholder(code: Column) -> Column:
    """Never resolved by the extractor: UNMATCHED_*, blank or none."""
    c = F.coalesce(code, F.lit("none"))
    return c.startswith("UNMATCHED_") | (F.trim(c) == "") | (F.lower(c) == "none")


def is_resolved(code: Column) -> Column:
    """The wider test: also refuses nan, unknown_code and UNK_*."""
    c = F.trim(F.coalesce(code, F.lit("none")))
    return ~(
        (c == "") | F.lower(c).isin("none", "nan", "unknown_code")
        | c.startswith("UNMATCHED_") | c.startswith("UNK_")
    )


def operator_name(op: Column) -> Column:
    """Operator name from a name or a symbol; anything else is EXISTS."""
    upper = F.upper(F.coalesce(op, F.lit("EXISTS")))
    by_symbol = F.create_map(*[F.lit(x) for pair in OPERATOR_SYMBOLS.items() for x in pair])
    return F.when(upper.isin(*OPERATOR_CODES), upper).otherwise(
        F.coalesce(F.try_element_at(by_symbol, upper), F.lit("EXISTS")))


def operator_code(op: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in OPERATOR_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, op), F.lit(0))


def finite_double(value: Column) -> Column:
    """Number or null: text that does not parse, NaN and infinities become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def looks_icd9(code: Column) -> Column:
    return code.rlike(r"^[0-9]")


def stable_unknown(entity_type: str, text: Column) -> Column:
    """Reproducible stand-in for text that resolves to no code."""
    return F.concat(F.lit(f"UNK_{entity_type[:3].upper()}_"), F.substring(F.md5(text), 1, 8))
