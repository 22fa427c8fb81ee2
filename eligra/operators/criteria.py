"""Eligibility text to structured criteria rows.

One job serves all dialects: text is cut into lines and tagged with its section inside the row
(no shuffle), then codes are looked up with equi-joins and numeric bounds with expressions.

trials: trial_id, eligibility_criteria and optionally conditions. Result: trial_id, pos,
raw_entity, entity_type, entity_code, operator, value, max_value, is_inclusion, severity_weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.functions import lexicon as lex
from eligra.functions import text as tx
from eligra.functions.codes import stable_unknown
from eligra.operators.phrases import best_phrases, fuzzy_medications
from eligra.operators.ranking import top_k
from eligra.session import spread

CONDITION_WEIGHT = 1.5
OUTPUT = ("trial_id", "pos", "raw_entity", "entity_type", "entity_code", "operator", "value", "max_value",
          "is_inclusion", "severity_weight")


def _section_flag(low: Column, dialect: str) -> Column:
    """True at an inclusion header, False at an exclusion header, null on other lines."""
    if dialect == "D":
        inc = low.startswith("inclusion") | low.contains("inclusion criteria")
        exc = low.startswith("exclusion") | low.contains("exclusion criteria")
    elif dialect == "B":
        inc, exc = low.contains("inclusion"), low.contains("exclusion")
    else:
        inc = low.contains("inclusion") & low.contains("criteria")
        exc = low.contains("exclusion") & low.contains("criteria")
    return F.when(inc, True).when(exc, False)


def _is_kept(line: Column, dialect: str) -> Column:
    if dialect == "D":
        return ~(line.endswith(":") & (F.length(line) < 60))
    if dialect == "E":
        cleaned = tx.strip_bullet(line)
        return (F.length(cleaned) >= 10) & ~cleaned.endswith(":")
    return (F.length(line) >= 10) & ~line.endswith(":")


def criteria_lines(trials: DataFrame, dialect: str = "D") -> DataFrame:
    """(trial_id, pos, line, is_inclusion): criterion lines with the section they stand in.

    Lines before any header count as inclusion. Everything happens within the row of the text.
    """
    text = F.coalesce("eligibility_criteria", F.lit(""))
    if dialect == "D":
        lines = F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t-*•")))
        lines = F.filter(lines, lambda s: F.length(s) >= 8)
    else:
        lines = F.transform(F.split(text, "\n"), tx.strip_spaces)
        lines = F.filter(lines, lambda s: s != "")
        lines = F.when(F.length(tx.strip_spaces(text)) >= 10, lines).otherwise(F.array().cast("array<string>"))
    tagged = F.transform(lines, lambda s, i: F.struct(
        i.alias("pos"), s.alias("line"), _section_flag(F.lower(s), dialect).alias("flag")))
    df = spread(trials.select("trial_id", "eligibility_criteria")).select("trial_id", tagged.alias("_lines"))
    df = df.withColumn("_heads", F.filter("_lines", lambda e: e["flag"].isNotNull()))
    body = F.transform(
        F.filter("_lines", lambda e: e["flag"].isNull()),
        lambda e: F.struct(e["pos"].alias("pos"), e["line"].alias("line"), F.coalesce(F.try_element_at(
            F.filter("_heads", lambda h: h["pos"] < e["pos"]), F.lit(-1))["flag"], F.lit(True)).alias("is_inclusion")))
    return df.select("trial_id", F.inline(body)).where(_is_kept(F.col("line"), dialect))


def condition_codes(cohort_codes: DataFrame, limit: int | None = None) -> DataFrame:
    """(phrase, code): cohort diagnosis codes under the category of each known phrase, the ``limit`` smallest if one is given."""
    phrases = F.explode(F.map_entries(F.create_map(*[F.lit(x) for kv in lex.CONDITION_PREFIXES.items() for x in kv])))
    codes = cohort_codes.select("code").distinct()
    prefixes = sorted(set(lex.CONDITION_PREFIXES.values()))
    kept = codes.where(F.substring("code", 1, 3).isin(*prefixes)).select(F.substring("code", 1, 3).alias("prefix"), "code")
    if limit is not None:
        kept = top_k(kept, ["prefix"], [F.asc("code")], limit)
    # The phrase table is a constant; rows come from the cohort side.
    wide = kept.select("prefix", "code", phrases.alias("p")).where(F.col("p.value") == F.col("prefix"))
    return wide.select(F.col("p.key").alias("phrase"), "code")


def first_condition_code(cohort_codes: DataFrame) -> Column:
    """One map value: category -> smallest cohort code, at most one entry per known category."""
    prefixes = sorted(set(lex.CONDITION_PREFIXES.values()))
    firsts = cohort_codes.where(F.substring("code", 1, 3).isin(*prefixes)).groupBy(
        F.substring("code", 1, 3).alias("prefix")).agg(F.min("code").alias("code"))
    return firsts.agg(F.map_from_entries(F.collect_list(F.struct("prefix", "code")))).scalar()


def _finish(df: DataFrame, entity_type: Column, entity_code: Column, bounds: Column, raw: Column,
            is_inclusion: Column | None = None) -> DataFrame:
    return df.withColumn("_b", bounds).select(
        "trial_id", "pos", raw.alias("raw_entity"), entity_type.alias("entity_type"), entity_code.alias("entity_code"),
        F.col("_b.operator").alias("operator"), F.col("_b.value").alias("value"), F.col("_b.max_value").alias("max_value"),
        (F.col("is_inclusion") if is_inclusion is None else is_inclusion).alias("is_inclusion"),
        F.lit(1.0).alias("severity_weight"))


def parse_terms(trials: DataFrame, cohort_codes: DataFrame, exclusion_as_absence: bool = True) -> DataFrame:
    """Dialect D (default): lab terms with bounds, medication terms, condition phrases, stand-ins.

    ``exclusion_as_absence`` stores an excluded diagnosis as NOT_EXISTS, as the rule text had it;
    with False it stays EXISTS on the exclusion side.
    """
    lines = criteria_lines(trials, "D").withColumn("low", F.lower("line")).withColumn(
        "_codes", first_condition_code(cohort_codes))
    lab = tx.first_contained(F.col("low"), lex.LAB_TERMS)
    med = tx.first_contained(F.col("low"), lex.MEDICATION_TERMS)
    dx = F.coalesce(*[F.when(F.col("low").contains(p), F.try_element_at("_codes", F.lit(c)))
                      for p, c in lex.CONDITION_PREFIXES.items()])
    df = lines.withColumn("_lab", lab).withColumn("_med", med).withColumn("_dx", dx)
    is_lab, is_med, is_dx = F.col("_lab").isNotNull(), F.col("_med").isNotNull(), F.col("_dx").isNotNull()
    kind = F.when(is_lab, "lab").when(is_med, "medication").otherwise("diagnosis")
    code = (
        F.when(is_lab, tx.lookup(lex.LAB_TERMS, F.col("_lab")))
        .when(is_med, stable_unknown("medication", F.col("_med")))
        .when(is_dx, F.col("_dx")).otherwise(stable_unknown("diagnosis", F.col("line")))
    )
    none = F.lit(None).cast("double")
    absent = ~is_lab & ~is_med & is_dx & ~F.col("is_inclusion") & F.lit(exclusion_as_absence)
    plain = F.struct(F.when(absent, "NOT_EXISTS").otherwise("EXISTS").alias("operator"), none.alias("value"), none.alias("max_value"))
    bounds = F.when(is_lab, tx.bounds_patterns(F.col("line"))).otherwise(plain)
    rows = _finish(df, kind, code, bounds, F.col("line"))
    if "conditions" not in trials.columns:
        return rows
    return rows.unionByName(registered_conditions(trials, cohort_codes))


def registered_conditions(trials: DataFrame, cohort_codes: DataFrame, weight: float = CONDITION_WEIGHT) -> DataFrame:
    """Registered conditions as extra inclusion criteria, one per cohort code of the phrase."""
    named = trials.select("trial_id", F.explode("conditions").alias("raw_entity")).withColumn(
        "phrase", F.lower(F.trim("raw_entity")))
    none = F.lit(None).cast("double")
    return named.join(condition_codes(cohort_codes), "phrase").select(
        "trial_id", F.lit(None).cast("int").alias("pos"), "raw_entity", F.lit("diagnosis").alias("entity_type"),
        F.col("code").alias("entity_code"), F.lit("EXISTS").alias("operator"), none.alias("value"),
        none.alias("max_value"), F.lit(True).alias("is_inclusion"), F.lit(weight).alias("severity_weight"))


def match_entities(lines: DataFrame, concepts: DataFrame, text: str = "line", fuzzy: bool = True) -> DataFrame:
    """Add matched_phrase, matched_type and matched_code to lines (trial_id, pos, <text>).

    Administrative lines first, then the manual table, then the longest dictionary phrase, then
    a fuzzy medication name. Each later step only sees the lines the earlier ones left open.
    """
    low = F.lower(text)
    admin = tx.is_administrative(F.col(text))
    df = lines.withColumn("_admin", admin).withColumn(
        "_manual", F.when(~admin, tx.longest_whole_word(low, lex.MANUAL_CODES)))
    open_lines = df.where(~F.col("_admin") & F.col("_manual").isNull()).select("trial_id", "pos", F.col(text).alias("line"))
    phrases = best_phrases(open_lines, concepts)
    if fuzzy:
        rest = open_lines.join(phrases.select("trial_id", "pos"), ["trial_id", "pos"], "left_anti")
        phrases = phrases.unionByName(fuzzy_medications(rest, concepts))
    df = df.join(phrases, ["trial_id", "pos"], "left")
    manual = F.col("_manual").isNotNull()
    return df.select(
        *lines.columns,
        F.when(manual, F.col("_manual")).otherwise(F.col("phrase")).alias("matched_phrase"),
        F.when(F.col("_admin"), "administrative").when(manual, "diagnosis").otherwise(F.col("entity_type")).alias("matched_type"),
        F.when(F.col("_admin"), "NON_CLINICAL").when(manual, tx.lookup(lex.MANUAL_CODES, F.col("_manual")))
        .otherwise(F.col("entity_code")).alias("matched_code"),
    )


def parse_dictionary(trials: DataFrame, concepts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Dialect A: dictionary codes, keyword types and UNMATCHED_ stand-ins for the rest."""
    df = match_entities(criteria_lines(trials, "A"), concepts, fuzzy=fuzzy)
    line = F.col("line")
    digits = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint") % 100000
    code = F.coalesce("matched_code", F.concat(F.lit("UNMATCHED_"), F.lpad(digits.cast("string"), 5, "0")))
    return _finish(df, F.coalesce("matched_type", tx.guess_type(line)), code, tx.bounds_first_number(line), line)


def parse_operator_words(trials: DataFrame, concepts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Dialect B: any mention of a section word is a header; operator words in table order."""
    df = match_entities(criteria_lines(trials, "B"), concepts, fuzzy=fuzzy)
    line = F.col("line")
    return _finish(df, F.col("matched_type"), F.coalesce("matched_code", F.lit("UNKNOWN_CODE")), tx.bounds_operator_words(line), line)


def parse_triplets(trials: DataFrame, concepts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Dialect C: sanitised entities, stop and demographic lines skipped, local negation flips the side."""
    raw = F.regexp_replace(F.col("line"), r"^[\-*• ]+|[\-*• ]+$", "")
    lines = criteria_lines(trials, "A").withColumn("_raw", tx.strip_spaces(raw)).withColumn(
        "_entity", tx.sanitize_entity(F.col("_raw")))
    lines = lines.where((F.col("_raw") != "") & ~tx.is_stop_entity(F.col("_entity")) & ~tx.is_demographic(F.col("_entity")))
    df = match_entities(lines, concepts, text="_entity", fuzzy=fuzzy)
    name = F.lower("_entity")
    admin = F.col("matched_type") == "administrative"
    acronym_type = tx.lookup({k: v[0] for k, v in lex.ACRONYMS.items()}, name)
    acronym_code = tx.lookup({k: v[1] for k, v in lex.ACRONYMS.items()}, name)
    none = F.lit(None).cast("double")
    span = tx.bounds_with_span(F.col("_raw"))
    bounds = F.when(F.coalesce(admin, F.lit(False)), F.struct(
        F.lit("EXISTS").alias("operator"), none.alias("value"), none.alias("max_value"))).otherwise(
        F.struct(span["operator"].alias("operator"), span["value"].alias("value"), span["max_value"].alias("max_value")))
    flipped = tx.is_negated_near(F.col("_raw"), F.col("_entity")) & ~F.coalesce(admin, F.lit(False))
    side = F.when(flipped, ~F.col("is_inclusion")).otherwise(F.col("is_inclusion"))
    return _finish(df, F.when(admin, F.col("matched_type")).otherwise(F.coalesce(acronym_type, F.col("matched_type"))),
                   F.when(admin, F.col("matched_code")).otherwise(F.coalesce(acronym_code, F.col("matched_code"))),
                   bounds, F.col("_entity"), side)


def parse_keywords(trials: DataFrame) -> DataFrame:
    """Dialect E: keyword types and hashed stand-in codes, bullets stripped."""
    df = criteria_lines(trials, "E").withColumn("_clean", tx.strip_bullet(F.col("line")))
    code = F.concat(F.lit("EXTRACTED_"), F.substring(F.md5("_clean"), 1, 8))
    return _finish(df, tx.guess_type(F.col("line"), with_taking=True), code,
                   tx.bounds_first_number(F.col("line"), unicode_signs=True), F.col("_clean"))


def parse_criteria(trials: DataFrame, dialect: str = "D", concepts: DataFrame | None = None,
                   cohort_codes: DataFrame | None = None, **options) -> DataFrame:
    """Structured criteria in one of the dialects A, B, C (need ``concepts``), D (``cohort_codes``) or E."""
    if dialect == "D":
        return parse_terms(trials, cohort_codes, **options)
    if dialect == "E":
        return parse_keywords(trials)
    parser = {"A": parse_dictionary, "B": parse_operator_words, "C": parse_triplets}[dialect]
    return parser(trials, concepts, **options)


def recover_concepts(lines: DataFrame, concepts: DataFrame) -> DataFrame:
    """Second chance for unmatched lines: synonym, fuzzy medication, then a lab hint."""
    low = F.lower(tx.strip_spaces(F.col("line")))
    usable = (F.length(tx.strip_spaces(F.col("line"))) >= 4) & ~tx.is_boilerplate(low)
    df = lines.withColumn("_usable", usable).withColumn(
        "_syn", F.when(F.col("_usable"), tx.longest_whole_word(low, lex.CLINICAL_SYNONYMS)))
    fuzzy = fuzzy_medications(df.where(F.col("_usable") & F.col("_syn").isNull()).select("trial_id", "pos", "line"), concepts)
    df = df.join(fuzzy, ["trial_id", "pos"], "left").withColumn("_hint", F.when(F.col("_usable"), tx.lab_hint(low)))
    syn = F.col("_syn").isNotNull()
    return df.select(
        *lines.columns,
        F.coalesce("_syn", "phrase").alias("matched_phrase"),
        F.when(syn, "diagnosis").when(F.col("phrase").isNotNull(), F.col("entity_type"))
        .when(F.col("_hint").isNotNull(), "lab").alias("matched_type"),
        F.when(syn, tx.lookup(lex.CLINICAL_SYNONYMS, F.col("_syn"))).otherwise(F.coalesce("entity_code", "_hint")).alias("matched_code"),
    )


def filter_by_condition(trials: DataFrame) -> DataFrame:
    """Trials registered for a condition of interest, with the matched term."""
    return trials.withColumn("matched_term", tx.matched_condition(F.col("conditions"))).where(F.col("matched_term").isNotNull())
