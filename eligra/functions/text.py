"""Text predicates and extractors for eligibility lines, all as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligra.functions import lexicon as lex
from eligra.functions.codes import finite_double

NUMBER = r"(\d+\.?\d*)"


def quote(term: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term)


def any_of(terms: Iterable[str]) -> str:
    return "(?:" + "|".join(quote(t) for t in terms) + ")"


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Plain substring tests: an alternation is tried anew at every character."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def whole_word(term: str) -> str:
    return r"\b" + quote(term) + r"\b"


def first_contained(text: Column, terms: Iterable[str]) -> Column:
    """First term, in list order, that the text contains; null when none."""
    return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in terms])


def longest_whole_word(text: Column, terms: Iterable[str]) -> Column:
    """Longest term found as whole words (list order among equals); null when none.

    A plain substring test comes before each pattern.
    """
    ordered = sorted(terms, key=len, reverse=True)
    return F.coalesce(*[F.when(text.contains(t) & text.rlike(whole_word(t)), F.lit(t)) for t in ordered])


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def is_administrative(text: Column) -> Column:
    return contains_any(F.lower(text), lex.ADMINISTRATIVE_PHRASES)


def is_boilerplate(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*" + any_of(lex.BOILERPLATE_LEADERS) + r"\b")


def is_demographic(text: Column) -> Column:
    return contains_any(F.lower(text), ("age", "years old", "male", "sex", "gender")) & text.rlike(r"(?i)\b(age|years old|male|female|sex|gender)\b")


def is_stop_entity(text: Column) -> Column:
    t = F.lower(strip_spaces(text))
    return ((F.length(t) < 3) & ~t.isin(*lex.ACRONYMS)) | t.isin(*lex.STOP_ENTITIES)


def sounds_like_exclusion(text: Column) -> Column:
    return contains_any(F.lower(text), lex.EXCLUSION_CUES)


def sanitize_entity(text: Column) -> Column:
    """Without backslashes, brackets, operators, leading bullets and repeated spaces."""
    t = F.regexp_replace(text, r"[\\()\[\]/]", " ")
    t = F.regexp_replace(t, r"[<>=]+", " ")
    t = F.regexp_replace(t, r"^[\s\-*•.]+", "")
    # Most lines have single spaces only, which would be replaced one by one.
    return strip_spaces(F.when(t.rlike(r"\s\s|[^\S ]"), F.regexp_replace(t, r"\s+", " ")).otherwise(t))


def strip_bullet(text: Column) -> Column:
    """Without leading bullets and numbering."""
    return strip_spaces(F.regexp_replace(text, r"^[*\-\d.]+\s*", ""))


def _bound(op: Column, value: Column, max_value: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(op.alias("operator"), value.alias("value"), (none if max_value is None else max_value).alias("max_value"))


def _exists() -> Column:
    none = F.lit(None).cast("double")
    return _bound(F.lit("EXISTS"), none, none)


def _group(text: Column, pattern: str, group: int) -> Column:
    return finite_double(F.regexp_extract(text, pattern, group))


def _number(text: Column, index: int) -> Column:
    return finite_double(F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER)), F.lit(index + 1)))


def bounds_patterns(text: Column) -> Column:
    """Operator, value and upper value by the ordered pattern list (default parser); lower-cases."""
    low = F.lower(text)
    result = _exists()
    for pattern, op in reversed(lex.BOUND_PATTERNS):
        upper = _group(low, pattern, 2) if op == "BETWEEN" else None
        result = F.when(contains_any(low, lex.BOUND_CUES[op]) & low.rlike(pattern), _bound(F.lit(op), _group(low, pattern, 1), upper)).otherwise(result)
    return result


_SPAN_BETWEEN = r"(?i)\b(?:between\s+)?(\d+(?:\.\d+)?)\s*(?:and|to|-)\s*(\d+(?:\.\d+)?)\b"
_SPAN_SYMBOL = r"(?:\\>|\\<|>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)"
_SPAN_ABOVE = r"(?i)\b(?:at least|greater than|more than|above)\s+(\d+(?:\.\d+)?)\b"
_SPAN_BELOW = r"(?i)\b(?:at most|less than|fewer than|under|below)\s+(\d+(?:\.\d+)?)\b"


def bounds_with_span(text: Column) -> Column:
    """Operator, value, upper value and the character span (start, end) of the match.

    A plain range counts as BETWEEN; words for "more" are inclusive here.
    """
    none, no_pos = F.lit(None).cast("double"), F.lit(None).cast("int")

    def found(pattern: str, op: Column, value: Column, upper: Column) -> Column:
        hit = F.regexp_substr(text, F.lit(pattern))
        start = F.regexp_instr(text, F.lit(pattern)) - 1
        return F.struct(op.alias("operator"), value.alias("value"), upper.alias("max_value"),
                        start.alias("start"), (start + F.length(hit)).alias("end"))

    sign = F.regexp_substr(text, F.lit(_SPAN_SYMBOL))
    symbol_op = (
        F.when(sign.contains(">"), F.when(sign.contains("="), "GTE").otherwise("GT"))
        .when(sign.contains("<"), F.when(sign.contains("="), "LTE").otherwise("LT")).otherwise("EQ")
    )
    a, b = _group(text, _SPAN_BETWEEN, 1), _group(text, _SPAN_BETWEEN, 2)
    nothing = F.struct(F.lit("EXISTS").alias("operator"), none.alias("value"), none.alias("max_value"),
                       no_pos.alias("start"), no_pos.alias("end"))
    low = F.lower(text)
    return (
        F.when(~text.rlike("[0-9]"), nothing)
        .when(text.rlike(_SPAN_BETWEEN), found(_SPAN_BETWEEN, F.lit("BETWEEN"), F.least(a, b), F.greatest(a, b)))
        .when(contains_any(text, "<>=") & text.rlike(_SPAN_SYMBOL), found(_SPAN_SYMBOL, symbol_op, _group(text, _SPAN_SYMBOL, 1), none))
        .when(contains_any(low, ("at least", "greater than", "more than", "above")) & text.rlike(_SPAN_ABOVE), found(_SPAN_ABOVE, F.lit("GTE"), _group(text, _SPAN_ABOVE, 1), none))
        .when(contains_any(low, ("at most", "less than", "fewer than", "under", "below")) & text.rlike(_SPAN_BELOW), found(_SPAN_BELOW, F.lit("LTE"), _group(text, _SPAN_BELOW, 1), none))
        .otherwise(nothing)
    )


def bounds_first_number(text: Column, unicode_signs: bool = False) -> Column:
    """First number with the first sign found; only the lower end of a range is kept."""
    low, first, second = F.lower(text), _number(text, 0), _number(text, 1)
    op = (
        F.when(text.contains(">") | low.contains("greater than"), "GT")
        .when(text.contains("<") | low.contains("less than"), "LT")
        .when(text.contains("=") | low.contains("equal"), "EQ")
        .when(low.contains("between") & second.isNotNull(), "BETWEEN")
    )
    if unicode_signs:
        op = op.when(text.contains("≥") | low.contains("or above"), "GTE").when(
            text.contains("≤") | low.contains("or below"), "LTE")
    return F.when(first.isNotNull() & op.isNotNull(), _bound(op, first)).otherwise(_exists())


def bounds_operator_words(text: Column) -> Column:
    """First operator word in table order decides; its number is the first of the line."""
    word = first_contained(F.lower(text), lex.OPERATOR_WORDS)
    op = F.coalesce(lookup(lex.OPERATOR_WORDS, word), F.lit("EXISTS"))
    first, second = _number(text, 0), _number(text, 1)
    both = (op == "BETWEEN") & second.isNotNull()
    value = F.when(op.isin("GT", "GTE", "LT", "LTE", "EQ") | both, first)
    return _bound(op, value, F.when(both, second))


def bounds_sign_then_words(text: Column) -> Column:
    """A sign next to its number, else the first operator word with any number; null otherwise."""
    pattern = r"(<=|=<|≤|<|>=|=>|≥|>|=)\s*([0-9]+(?:\.[0-9]+)?)"
    any_number = _group(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    word = first_contained(F.lower(text), lex.OPERATOR_SIGNS)
    by_sign = F.coalesce(lookup(lex.OPERATOR_SIGNS, F.regexp_extract(text, pattern, 1)), F.lit("EQ"))
    return F.when(text.rlike(pattern), _bound(by_sign, _group(text, pattern, 2))).when(
        word.isNotNull() & any_number.isNotNull(), _bound(lookup(lex.OPERATOR_SIGNS, word), any_number))


def is_negated_near(text: Column, entity: Column, window: int = 25) -> Column:
    """A negation word within ``window`` characters of the entity, on either side.

    When the entity is not in the text, anywhere in the text.
    """
    words = r"(?U)\b" + any_of(lex.NEGATION_WORDS) + r"\b"
    at = F.instr(F.lower(text), F.lower(entity))
    start = F.greatest(at - 1 - window, F.lit(0))
    end = at - 1 + F.length(entity) + window
    near = F.lower(F.substring(text, start + 1, end - start))
    return F.when(at == 0, F.lower(text).rlike(words)).otherwise(near.rlike(words))


def is_negated_before(text: Column, span_start: Column, window: int = 40) -> Column:
    """A negation trigger in the same sentence, at most ``window`` characters before the span."""
    before = F.substring(text, 1, span_start)
    near = F.when(span_start > window, F.substring(before, span_start - window + 1, F.lit(window))).otherwise(before)
    sentence = F.regexp_extract(near, r"([^.?!]*)$", 1)
    return F.lower(sentence).rlike(r"(?U)\b" + any_of(lex.NEGATION_TRIGGERS) + r"\b")


def nearest_entity(text: Column, candidates: Column, start: Column, end: Column) -> Column:
    """Candidate whose centre is closest to the centre of the number; the first of equals."""
    low, centre = F.lower(text), (start + end) / 2
    placed = F.transform(candidates, lambda c, i: F.struct(
        F.abs(F.instr(low, F.lower(c)) - 1 + F.length(c) / 2 - centre).alias("d"), i.alias("i"), c.alias("c")))
    found = F.filter(placed, lambda p: F.instr(low, F.lower(p["c"])) > 0)
    return F.when(start.isNotNull(), F.array_min(found)["c"])


def guess_type(text: Column, with_taking: bool = False) -> Column:
    """Entity type by keyword, diagnosis when nothing fits."""
    low = F.lower(text)
    med = lex.TYPE_KEYWORDS["medication"] + (("taking",) if with_taking else ())
    return (F.when(contains_any(low, med), "medication").when(contains_any(low, lex.TYPE_KEYWORDS["lab"]), "lab")
            .when(contains_any(low, lex.TYPE_KEYWORDS["procedure"]), "procedure").otherwise("diagnosis"))


def lab_hint(text: Column) -> Column:
    """LABHINT_<name> for a line with a lab name and a number, null otherwise."""
    low = F.lower(text)
    name = first_contained(low, lex.LAB_HINTS)
    return F.when(low.rlike(r"\d"), F.concat(F.lit("LABHINT_"), F.regexp_replace(name, r"[^a-z0-9]", "")))


def standard_code(kind: Column, concept: Column) -> Column:
    """Code of an exactly named concept, else a namespaced stand-in; UNKNOWN for other types."""
    name = F.lower(strip_spaces(concept))
    label = F.replace(F.upper(name), F.lit(" "), F.lit("_"))
    return (
        F.when(kind == "diagnosis", F.coalesce(lookup(lex.STANDARD_DIAGNOSES, name), F.concat(F.lit("ICD_"), label)))
        .when(kind == "lab", F.coalesce(lookup(lex.STANDARD_LABS, name), F.concat(F.lit("LAB_"), label)))
        .when(kind == "prescription", F.coalesce(lookup(lex.STANDARD_PRESCRIPTIONS, name), F.concat(F.lit("NDC_"), label)))
        .otherwise("UNKNOWN")
    )


def sample_size(text: Column) -> Column:
    digits = F.regexp_extract(text, r"(?i)(\d[\d,]*)\s*(?:patients|subjects|participants|enrolled)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("int")


def phase(text: Column) -> Column:
    found = F.regexp_substr(text, F.lit(r"(?i)\b(?:Phase\s*(?:[1-4]|I{1,3}|IV)|Phase\s*0)\b"))
    return F.coalesce(found, F.lit("Not specified"))


def condition_after_with(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)(?:patients|subjects)\s+with\s+([A-Za-z0-9\s\-]+?)(?=\.|,|$)", 1)
    return F.when(found != "", strip_spaces(found)).otherwise("Unknown")


def trial_text(title: Column, conditions: Column, raw_texts: Column) -> Column:
    """Title, conditions and criteria joined by spaces, empty parts left out."""
    parts = F.concat(F.array(title), conditions, raw_texts)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def recode_by_phrase(text: Column, code: Column, table: Mapping[str, str] = lex.RECODE_BY_PHRASE) -> Column:
    return F.coalesce(lookup(table, first_contained(F.lower(text), table)), code)


def condition_terms(conditions: Column) -> Column:
    """Registered conditions split on separators, trimmed, lower case, longer than two characters."""
    parts = F.flatten(F.transform(conditions, lambda c: F.split(c, r"[|;,]")))
    return F.filter(F.transform(parts, lambda p: F.lower(strip_spaces(p))), lambda p: F.length(p) > 2)


def target_terms() -> list[str]:
    terms = {t for name, others in lex.TARGET_CONDITIONS.items() for t in (name, *others)}
    return sorted(sorted(terms), key=len, reverse=True)


def matched_condition(conditions: Column) -> Column:
    """Longest term of interest found as whole words in any condition, alphabetical among equals."""
    joined = F.array_join(condition_terms(conditions), "\n")
    return longest_whole_word(joined, target_terms())


def all_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
