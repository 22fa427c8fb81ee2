"""Eligibility-text, dictionary and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligra.functions import lexicon as lex
from eligra.functions import text as tx
from eligra.functions.codes import stable_unknown
from eligra.operators import cohort as co
from eligra.operators import criteria as cr
from eligra.operators import phrases as ph
from eligra.operators import quality as qu
from eligra.operators.splits import prefix_split
from eligra.plans import views
from eligra.plans.base import Inputs, Query, rounded, sql


def _swap(text: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        text = f"replace({text}, ' {old} ', ' {new.replace(chr(39), chr(39) * 2)} ')"
    return text


# The documents hold invented words; swapping frequent ones for clinical wording gives the parsers work.
INCLUSION_WORDS = {"was": "congestive heart failure", "for": "type 2 diabetes", "on": "Metformin", "with": "glucose > 7.5", "be": "no history of stroke",
                   "by": "informed consent", "as": "hypertension", "are": "aged 18 years old", "at": "prior MI"}
EXCLUSION_WORDS = {"was": "pneumonia", "for": "chronic kidney disease", "on": "insulin therapy", "with": "platelet between 50 and 100", "be": "without sepsis",
                   "by": "willing to comply", "as": "CKD or COPD", "are": "surgery at least 3 months", "at": "less than 12 units"}

views.VIEWS.update({
    "clinical_text": f"""
        select doc_id as trial_id, 'Inclusion Criteria:' || chr(10) || {_swap('text', INCLUSION_WORDS)} || chr(10) || 'Exclusion Criteria:' || chr(10) || {_swap('text', EXCLUSION_WORDS)} as eligibility_criteria
        from documents""",
    "concept_titles": """
        select item_id as seq, cast(item_id as string) as icd9_code, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) as long_title, split_part(text, ' ', 3) as short_title
        from benchmark""",
    "concept_drugs": "select doc_id as seq, split_part(text, ' ', 3) as drug, cast(doc_id as string) || '.0' as ndc from documents",
    "concept_labs": """
        select d.doc_id as seq, d.doc_id as itemid, split_part(text, ' ', 5) || ' ' || split_part(text, ' ', 6) as label, split_part(text, ' ', 1) as fluid
        from documents d join labels l on d.doc_id = l.doc_id""",
    "registered": """
        select o_orderkey as trial_id, o_orderpriority as phase, case o_orderkey % 9 when 0 then 'Heart failure; unspecified' when 1 then 'Type 2 Diabetes' when 2 then 'leukemia' when 3 then 'T2DM, HTN'
          when 4 then 'Staff safety' when 5 then 'Acute MI' when 6 then 'CKD|Renal insufficiency' when 7 then 'Pneumonitis' else o_orderstatus end as condition
        from orders""",
})


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{str(x).replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in pairs)


def _terms(names) -> str:
    return _values((i, n) for i, n in enumerate(names))


def _or_contains(col: str, names) -> str:
    return "(" + " or ".join(f"contains({col}, '{n.replace(chr(39), chr(39) * 2)}')" for n in names) + ")"


def _lines_cte(dialect: str, source: str) -> str:
    """Criterion lines with sections, stated with window functions."""
    if dialect == "D":
        strip, keep, body = "trim(raw, ' ' || chr(9) || '-*•')", "length(line) >= 8", "not (ends_with(line, ':') and length(line) < 60)"
        inc = "starts_with(low, 'inclusion') or contains(low, 'inclusion criteria')"
        exc = "starts_with(low, 'exclusion') or contains(low, 'exclusion criteria')"
    else:
        strip, keep, body = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')", "line <> ''", "length(line) >= 10 and not ends_with(line, ':')"
        both = dialect != "B"
        inc = "contains(low, 'inclusion')" + (" and contains(low, 'criteria')" if both else "")
        exc = "contains(low, 'exclusion')" + (" and contains(low, 'criteria')" if both else "")
    return f"""
    select trial_id, pos, line, coalesce(section, true) as is_inclusion from (
      select *, last_value(flag ignore nulls) over (partition by trial_id order by pos rows between unbounded preceding and current row) as section from (
        select *, case when {inc} then true when {exc} then false end as flag from (
          select trial_id, line, lower(line) as low, row_number() over (partition by trial_id order by ord) - 1 as pos from (
            select trial_id, ord, {strip} as line from (
              select trial_id, unnest(string_split(eligibility_criteria, chr(10))) as raw, generate_subscripts(string_split(eligibility_criteria, chr(10)), 1) as ord from {source}) a) b
          where {keep}) c) d) e
    where flag is null and {body}"""


NUM = "'([0-9]+[.]?[0-9]*)'"
CTES = {
    "lines_d": _lines_cte("D", "clinical_text"),
    "lines_a": _lines_cte("A", "clinical_text"),
    "lines_b": _lines_cte("B", "clinical_text"),
    "lines_plain": _lines_cte("D", "criteria_text"),
    "first_codes": f"""
        select ord, phrase, (select min(code) from pcodes where entity_type = 'diagnosis' and substr(code, 1, 3) = prefix) as code
        from (values {_values((i, p, c) for i, (p, c) in enumerate(lex.CONDITION_PREFIXES.items()))}) v(ord, phrase, prefix)""",
    "bounds_d": """
        select trial_id, pos, line, is_inclusion, case when low ~ k0 then 'BETWEEN' when low ~ k1 then 'GTE' when low ~ k2 then 'LTE' when low ~ k3 then 'GT' when low ~ k4 then 'LT' when low ~ k5 then 'EQ' else 'EXISTS' end as operator,
          case when low ~ k0 then try_cast(regexp_extract(low, p0, 1) as double) when low ~ k1 then try_cast(regexp_extract(low, p1, 1) as double) when low ~ k2 then try_cast(regexp_extract(low, p2, 1) as double)
            when low ~ k3 then try_cast(regexp_extract(low, p3, 1) as double) when low ~ k4 then try_cast(regexp_extract(low, p4, 1) as double) when low ~ k5 then try_cast(regexp_extract(low, p5, 1) as double) end as value,
          case when low ~ k0 then try_cast(regexp_extract(low, p0, 2) as double) end as max_value
        from (select *, lower(line) as low, """ + ", ".join(
            f"'{p}' as p{i}, '(?s).*(?:{p}).*' as k{i}" for i, (p, _) in enumerate(lex.BOUND_PATTERNS)) + " from lines_d) t",
    "manual": f"select * from (values {_values((k, v, len(k), i) for i, (k, v) in enumerate(lex.MANUAL_CODES.items()))}) v(phrase, code, len, ord)",
    "concepts": """
        select phrase, entity_type, entity_code from (
          select *, row_number() over (partition by phrase order by src desc, seq desc, o desc) as r from (
            select lower(trim(long_title)) as phrase, 'diagnosis' as entity_type, upper(replace(trim(icd9_code), '.', '')) as entity_code, 0 as src, seq, 0 as o from concept_titles
            union all select lower(trim(short_title)), 'diagnosis', upper(replace(trim(icd9_code), '.', '')), 0, seq, 1 from concept_titles
            union all select lower(trim(drug)), 'medication', trim(ndc), 1, seq, 0 from concept_drugs where trim(ndc) not in ('0', '0.0', 'nan', '')
            union all select lower(trim(label)), 'lab', cast(itemid as varchar), 2, seq, 0 from concept_labs where lower(trim(label)) <> lower(trim(fluid))) u
          where phrase not in ('', 'nan', """ + ", ".join(f"'{g}'" for g in lex.GENERIC_TERMS) + ")) t where r = 1",
    "phrase_hits": r"""
        select l.trial_id, l.pos, c.phrase, c.entity_type, c.entity_code,
          length(regexp_extract(' ' || lower(l.line) || ' ', '^((?s:.*?)[^\p{L}\p{N}])' || regexp_escape(c.phrase) || '[^\p{L}\p{N}]', 1)) + length(c.phrase) as ends
        from (select distinct * from lines_a) l join concepts c on length(c.phrase) >= 5 and contains(lower(l.line), c.phrase)
        where regexp_matches(' ' || lower(l.line) || ' ', '[^\p{L}\p{N}]' || regexp_escape(c.phrase) || '[^\p{L}\p{N}]')""",
    "best_phrases": """
        select * from (select *, row_number() over (partition by trial_id, pos order by length(phrase) desc, ends) as r from phrase_hits) t where r = 1""",
    "matched_a": """
        select l.*, a.admin, m.phrase as manual_phrase, m.code as manual_code, b.phrase, b.entity_type, b.entity_code
        from lines_a l
        join (select trial_id, pos, """ + _or_contains("lower(line)", lex.ADMINISTRATIVE_PHRASES) + r""" as admin from lines_a) a on a.trial_id = l.trial_id and a.pos = l.pos
        left join (select * from (select x.trial_id, x.pos, m.phrase, m.code, row_number() over (partition by x.trial_id, x.pos order by m.len desc, m.ord) as r
            from lines_a x join manual m on contains(lower(x.line), m.phrase) and regexp_matches(lower(x.line), '\b' || regexp_escape(m.phrase) || '\b')) q where r = 1) m on m.trial_id = l.trial_id and m.pos = l.pos
        left join best_phrases b on b.trial_id = l.trial_id and b.pos = l.pos""",
}


def _q(body: str) -> str:
    return sql(body, CTES)


def _lines(s, d, source="clinical_text", dialect="D"):
    return cr.criteria_lines(Inputs(s, d).view(source), dialect)


def _concepts(s, d):
    i = Inputs(s, d)
    return ph.build_concepts(i.view("concept_titles"), i.view("concept_drugs"), i.view("concept_labs"))


def _dx_codes(s, d):
    return Inputs(s, d).codes().where("entity_type = 'diagnosis'").select("code")


def _parse_d(s, d):
    return cr.parse_criteria(Inputs(s, d).view("clinical_text"), "D", cohort_codes=_dx_codes(s, d))


def _parse_a(s, d):
    return cr.parse_criteria(Inputs(s, d).view("clinical_text"), "A", concepts=_concepts(s, d), fuzzy=False)


def _parse_fuzzy(dialect):
    def run(s, d):
        rows = cr.parse_criteria(Inputs(s, d).view("clinical_text"), dialect, concepts=_concepts(s, d))
        return rows.groupBy("entity_type", "operator", "is_inclusion").agg(F.count("*").alias("n"))
    return run


def _bounds(fn):
    def run(s, d):
        return _lines(s, d).withColumn("b", fn(F.col("line"))).select(
            "trial_id", "pos", F.col("b.operator").alias("operator"), F.col("b.value").alias("value"), F.col("b.max_value").alias("max_value"))
    return run


def _span(s, d):
    df = _lines(s, d).withColumn("b", tx.bounds_with_span(F.col("line")))
    candidates = F.array(*[F.lit(t) for t in ("glucose", "platelet", "diabetes", "stroke")])
    near = tx.nearest_entity(F.col("line"), candidates, F.col("b.start"), F.col("b.end"))
    return df.select("trial_id", "pos", "b.operator", "b.value", "b.max_value", near.alias("near"))


SPAN_SQL = r"""
    with p as (select *, lower(line) as low, regexp_extract(line, '(?i)\b((?:between\s+)?[0-9]+(?:\.[0-9]+)?\s*(?:and|to|-)\s*[0-9]+(?:\.[0-9]+)?)\b', 1) as m0,
        regexp_extract(line, '((?:\\>|\\<|>=|<=|>|<|=)\s*[0-9]+(?:\.[0-9]+)?)', 1) as m1,
        regexp_extract(line, '(?i)\b((?:at least|greater than|more than|above)\s+[0-9]+(?:\.[0-9]+)?)\b', 1) as m2,
        regexp_extract(line, '(?i)\b((?:at most|less than|fewer than|under|below)\s+[0-9]+(?:\.[0-9]+)?)\b', 1) as m3 from lines_d),
    h as (select *, case when m0 <> '' then m0 when m1 <> '' then m1 when m2 <> '' then m2 else m3 end as hit from p),
    n as (select *, list_transform(regexp_extract_all(hit, '[0-9]+(?:\.[0-9]+)?'), lambda x: cast(x as double)) as v, strpos(line, hit) - 1 + length(hit) / 2e0 as centre from h),
    c as (select n.trial_id, n.pos, t.name, row_number() over (partition by n.trial_id, n.pos order by abs(strpos(low, t.name) - 1 + length(t.name) / 2e0 - centre), t.o) as r
      from n, (values (0, 'glucose'), (1, 'platelet'), (2, 'diabetes'), (3, 'stroke')) t(o, name) where hit <> '' and contains(low, t.name))
    select n.trial_id, n.pos, case when m0 <> '' then 'BETWEEN' when m1 <> '' then case when contains(m1, '>') then case when contains(m1, '=') then 'GTE' else 'GT' end
        when contains(m1, '<') then case when contains(m1, '=') then 'LTE' else 'LT' end else 'EQ' end when m2 <> '' then 'GTE' when m3 <> '' then 'LTE' else 'EXISTS' end as operator,
      case when hit = '' then null when m0 <> '' then least(v[1], v[2]) else v[1] end as value, case when m0 <> '' then greatest(v[1], v[2]) end as max_value, c.name as near
    from n left join c on c.trial_id = n.trial_id and c.pos = n.pos and c.r = 1"""


def _negation(s, d):
    df = _lines(s, d)
    at = F.instr(F.lower("line"), "stroke")
    return df.select("trial_id", "pos", tx.is_negated_near(F.col("line"), F.lit("stroke")).alias("near"),
                     F.when(at > 0, tx.is_negated_before(F.col("line"), at - 1)).alias("before"), tx.sounds_like_exclusion(F.col("line")).alias("cue"))


# Plain letters stand in for accented ones, next to which DuckDB sees a word edge.
NEGATION_SQL = r"""
    with t as (select *, strpos(lower(line), 'stroke') as p0 from lines_d),
    w as (select *, lower(substr(line, cast(greatest(p0 - 25, 1) as bigint), cast(p0 - 1 + 6 + 25 - greatest(p0 - 26, 0) as bigint))) as near_w,
      lower(regexp_extract(substr(line, cast(greatest(p0 - 40, 1) as bigint), cast(least(p0 - 1, 40) as bigint)), '([^.?!]*)$', 1)) as before_w from t)
    select trial_id, pos, case when p0 = 0 then regexp_matches(regexp_replace(lower(line), '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'x', 'g'), '\b(no|not|without|except|exception|excluding)\b') else regexp_matches(regexp_replace(near_w, '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'x', 'g'), '\b(no|not|without|except|exception|excluding)\b') end as near,
      case when p0 > 0 then regexp_matches(regexp_replace(before_w, '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'x', 'g'), '\b(no|not|without|except|excluding|denies|never|none|absence|free of|lack of|without evidence of)\b') end as before,
      """ + _or_contains("lower(line)", lex.EXCLUSION_CUES) + " as cue from w"


def _line_flags(s, d):
    line = F.col("line")
    return _lines(s, d).select(
        "trial_id", "pos", tx.is_administrative(line).alias("admin"), tx.is_demographic(line).alias("demographic"), tx.is_boilerplate(line).alias("boilerplate"),
        tx.is_stop_entity(line).alias("stop"), tx.guess_type(line).alias("kind"), tx.lab_hint(line).alias("hint"), tx.sanitize_entity(line).alias("clean"),
        tx.strip_bullet(line).alias("bullet"), stable_unknown("diagnosis", line).alias("unknown"))


def _case_contains(col: str, groups: dict[str, tuple[str, ...]], default: str) -> str:
    return "case " + " ".join(f"when {_or_contains(col, words)} then '{k}'" for k, words in groups.items()) + f" else '{default}' end"


FLAGS_SQL = r"""
    select trial_id, pos, """ + _or_contains("low", lex.ADMINISTRATIVE_PHRASES) + r""" as admin, regexp_matches(line, '(?i)\b(age|years old|male|female|sex|gender)\b') as demographic,
      regexp_matches(line, '(?i)^\s*(""" + "|".join(lex.BOILERPLATE_LEADERS) + r""")\b') as boilerplate,
      low in (""" + ", ".join(f"'{w}'" for w in lex.STOP_ENTITIES) + ") as stop, " + _case_contains("low", lex.TYPE_KEYWORDS, "diagnosis") + r""" as kind,
      case when regexp_matches(low, '[0-9]') then 'LABHINT_' || regexp_replace(case """ + " ".join(f"when contains(low, '{h}') then '{h}'" for h in lex.LAB_HINTS) + r""" end, '[^a-z0-9]', '', 'g') end as hint,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[\\()\[\]/]', ' ', 'g'), '[<>=]+', ' ', 'g'), '^[\s\-*•.]+', ''), '\s+', ' ', 'g')) as clean,
      regexp_replace(regexp_replace(line, '^[*\-0-9.]+\s*', ''), '^\s+|\s+$', '', 'g') as bullet, 'UNK_DIA_' || substr(md5(line), 1, 8) as unknown
    from (select *, lower(line) as low from lines_d) t"""


def _synonyms(s, d):
    df = _lines(s, d)
    key = tx.longest_whole_word(F.lower("line"), lex.CLINICAL_SYNONYMS)
    return df.select("trial_id", "pos", key.alias("synonym"), tx.lookup(lex.CLINICAL_SYNONYMS, key).alias("code"),
                     tx.recode_by_phrase(F.col("line"), F.lit("KEEP")).alias("recoded"))


# A letter beyond ASCII is part of a word, which \\b does not know in DuckDB: one stands in for all of them.
SYNONYM_SQL = r"""
    with plain as (select *, regexp_replace(lower(line), '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'x', 'g') as plain from lines_d),
    v as (select * from (values """ + _values((k, c, len(k), i) for i, (k, c) in enumerate(lex.CLINICAL_SYNONYMS.items())) + r""") v(k, c, len, ord)),
    b as (select * from (select l.trial_id, l.pos, v.k, v.c, row_number() over (partition by l.trial_id, l.pos order by len desc, ord) as r
      from plain l join v on contains(l.plain, v.k) and regexp_matches(l.plain, '\b' || regexp_escape(v.k) || '\b')) q where r = 1)
    select l.trial_id, l.pos, b.k as synonym, b.c as code, case """ + " ".join(f"when contains(lower(line), '{k}') then '{c}'" for k, c in lex.RECODE_BY_PHRASE.items()) + r""" else 'KEEP' end as recoded
    from lines_d l left join b on b.trial_id = l.trial_id and b.pos = l.pos"""


def _loose(s, d):
    return ph.significant_word_hits(_lines(s, d, dialect="A").select("trial_id", "pos", "line"), _concepts(s, d)).select("trial_id", "pos", "phrase")


LOOSE_SQL = r"""
    with c as (select phrase, list_distinct(list_filter(string_split_regex(phrase, '[^a-z]+'), lambda w: length(w) >= 5)) as ws from concepts),
    l as (select trial_id, pos, lower(line) as low, list_distinct(string_split_regex(lower(line), '[^a-z0-9_]+')) as words from lines_a),
    h as (select trial_id, pos, phrase from l join c on contains(low, phrase) or (len(ws) > 0 and len(list_filter(ws, lambda w: not list_contains(words, w))) = 0))
    select trial_id, pos, phrase from (select *, row_number() over (partition by trial_id, pos order by length(phrase) desc, phrase desc) as r from h) t where r = 1"""


def _title_fix(s, d):
    """Criteria named by words of a supplier's lines against part names, both ways round."""
    i = Inputs(s, d)
    titles = i.table("part").groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("seq")).withColumn("code", F.concat(F.lit("P"), "seq"))
    crit = i.table("supplier").select(F.col("s_suppkey").alias("trial_id"), F.concat(F.lit("needs a "), F.expr(
        "case s_suppkey % 4 when 0 then 'small ring' when 1 then 'RED widget and hot gear' when 2 then 'olt' else 'nothing' end")).alias("t"),
        F.lit("OLD").alias("entity_code")).withColumn("raw_entity", F.when(F.col("trial_id") % 4 == 2, F.lit("olt")).otherwise(F.col("t")))
    return ph.fix_codes_by_title(crit, titles).select("trial_id", "entity_code")


TITLE_SQL = """
    with t as (select lower(p_name) as title, min(p_partkey) as seq from part group by 1),
    c as (select s_suppkey as trial_id, case s_suppkey % 4 when 0 then 'needs a small ring' when 1 then 'needs a red widget and hot gear' when 2 then 'olt' else 'needs a nothing' end as raw from supplier)
    select trial_id, coalesce('P' || cast(min(seq) as varchar), 'OLD') as entity_code from c left join t on contains(title, raw) or contains(raw, title) group by trial_id"""


def _fuzzy(s, d):
    lines = _lines(s, d, "criteria_text", "A").select("trial_id", "pos", "line")
    return ph.fuzzy_medications(lines, _concepts(s, d)).groupBy("phrase").agg(F.count("*").alias("n"))


def _registered(s, d):
    return Inputs(s, d).view("registered").withColumn("conditions", F.array("condition"))


def _conditions(s, d):
    return cr.filter_by_condition(_registered(s, d)).select("trial_id", "matched_term")


def _condition_histogram(s, d):
    """Terms are looked for once in each list of conditions that occurs."""
    lists = _registered(s, d).groupBy("conditions").agg(F.count("*").alias("times"))
    return qu.term_histogram(cr.filter_by_condition(lists), times="times")


TARGETS = tx.target_terms()
CONDITION_SQL = r"""
    with t as (select * from (values """ + _terms(TARGETS) + r""") v(o, term)),
    c as (select trial_id, lower(trim(x)) as c from (select trial_id, unnest(string_split_regex(condition, '[|;,]')) as x from registered) u where length(trim(x)) > 2)
    select trial_id, arg_min(term, o) as matched_term from c join t on contains(c, term) and regexp_matches(c, '\b' || regexp_escape(term) || '\b') group by trial_id"""


def _facts(s, d):
    docs = Inputs(s, d).view("clinical_text").withColumn("t", F.concat(F.lit("Phase II study of 1,250 patients with acute "), F.col("trial_id"), F.lit(" lung-injury, "), F.col("eligibility_criteria")))
    return docs.select("trial_id", tx.sample_size(F.col("t")).alias("n"), tx.phase(F.col("t")).alias("phase"), tx.condition_after_with(F.col("t")).alias("condition"))


def _standard(s, d):
    df = Inputs(s, d).table("part").select("p_partkey", F.expr("case p_partkey % 5 when 0 then 'diagnosis' when 1 then 'lab' when 2 then 'prescription' when 3 then 'diagnosis' else 'other' end").alias("kind"),
                                           F.expr("case when p_size % 3 = 0 then ' Heart Failure ' when p_size % 3 = 1 then 'Creatinine' else p_name end").alias("concept"))
    return df.select("p_partkey", tx.standard_code(F.col("kind"), F.col("concept")).alias("code"))


def _phases(s, d):
    return qu.phase_counts(_registered(s, d))


QUERIES = {
    "criteria_sections": Query(lambda s, d: _lines(s, d), _q("select * from lines_d")),
    "criteria_sections_plain": Query(lambda s, d: _lines(s, d, "criteria_text"), _q("select * from lines_plain")),
    "criteria_sections_strict": Query(lambda s, d: _lines(s, d, dialect="A"), _q("select * from lines_a")),
    "criteria_sections_loose": Query(lambda s, d: _lines(s, d, dialect="B"), _q("select * from lines_b")),
    "parse_terms": Query(_parse_d, _q("""
        with t as (select b.*, lower(line) as low from bounds_d b),
        f as (select t.trial_id, t.pos, arg_min(c.code, c.ord) as dx from t join first_codes c on contains(t.low, c.phrase) and c.code is not null group by 1, 2),
        x as (select t.*, case """ + " ".join(f"when contains(low, '{k}') then '{v}'" for k, v in lex.LAB_TERMS.items()) + """ end as lab,
          case """ + " ".join(f"when contains(low, '{m}') then '{m}'" for m in lex.MEDICATION_TERMS) + """ end as med, f.dx
          from t left join f on f.trial_id = t.trial_id and f.pos = t.pos)
        select trial_id, pos, line as raw_entity, case when lab is not null then 'lab' when med is not null then 'medication' else 'diagnosis' end as entity_type,
          case when lab is not null then lab when med is not null then 'UNK_MED_' || substr(md5(med), 1, 8) when dx is not null then dx else 'UNK_DIA_' || substr(md5(line), 1, 8) end as entity_code,
          case when lab is not null then operator when med is null and dx is not null and not is_inclusion then 'NOT_EXISTS' else 'EXISTS' end as operator,
          case when lab is not null then value end as value, case when lab is not null then max_value end as max_value, is_inclusion, 1e0 as severity_weight from x""")),
    "parse_dictionary": Query(_parse_a, _q("""
        with n as (select *, lower(line) as low, list_transform(regexp_extract_all(line, """ + NUM + """), lambda x: cast(x as double)) as v from matched_a),
        o as (select *, case when len(v) = 0 then 'EXISTS' when contains(line, '>') or contains(low, 'greater than') then 'GT' when contains(line, '<') or contains(low, 'less than') then 'LT'
            when contains(line, '=') or contains(low, 'equal') then 'EQ' when contains(low, 'between') and len(v) >= 2 then 'BETWEEN' else 'EXISTS' end as operator from n)
        select trial_id, pos, line as raw_entity,
          case when admin then 'administrative' when manual_code is not null then 'diagnosis' else coalesce(entity_type, """ + _case_contains("low", lex.TYPE_KEYWORDS, "diagnosis") + """) end as entity_type,
          case when admin then 'NON_CLINICAL' else coalesce(manual_code, entity_code, 'UNMATCHED_' || lpad(cast(cast(('0x' || substr(md5(line), 1, 8)) as bigint) % 100000 as varchar), 5, '0')) end as entity_code,
          operator, case when operator <> 'EXISTS' then v[1] end as value, cast(null as double) as max_value, is_inclusion, 1e0 as severity_weight from o""")),
    "parse_operator_words": Query(_parse_fuzzy("B"), None),
    "parse_triplets": Query(_parse_fuzzy("C"), None),
    "parse_keywords": Query(lambda s, d: cr.parse_criteria(Inputs(s, d).view("clinical_text"), "E").groupBy("entity_type", "operator", "is_inclusion").agg(F.count("*").alias("n")), None),
    "extraction_rates": Query(lambda s, d: qu.extraction_rates(_parse_a(s, d)), _q("""
        select count(*) as n_criteria, count(*) filter (where not admin and coalesce(manual_code, entity_code) is not null) as n_matched,
          count(*) filter (where admin) as n_administrative, count(*) filter (where not admin and coalesce(manual_code, entity_code) is null) as n_unmatched from matched_a""")),
    "concept_dictionary": Query(_concepts, _q("select * from concepts")),
    "phrase_match": Query(lambda s, d: ph.best_phrases(_lines(s, d, dialect="A").select("trial_id", "pos", "line"), _concepts(s, d)),
                          _q("select trial_id, pos, phrase, entity_type, entity_code from best_phrases")),
    "loose_phrase_match": Query(_loose, _q(LOOSE_SQL)),
    "title_code_fix": Query(_title_fix, TITLE_SQL),
    "fuzzy_medication": Query(_fuzzy, None),
    "numeric_bounds": Query(_bounds(tx.bounds_patterns), _q("select trial_id, pos, operator, value, max_value from bounds_d")),
    "numeric_bounds_span": Query(_span, _q(SPAN_SQL)),
    "numeric_bounds_first": Query(_bounds(lambda c: tx.bounds_first_number(c, True)), _q("""
        with n as (select *, lower(line) as low, list_transform(regexp_extract_all(line, """ + NUM + """), lambda x: cast(x as double)) as v from lines_d),
        o as (select *, case when len(v) = 0 then 'EXISTS' when contains(line, '>') or contains(low, 'greater than') then 'GT' when contains(line, '<') or contains(low, 'less than') then 'LT'
            when contains(line, '=') or contains(low, 'equal') then 'EQ' when contains(low, 'between') and len(v) >= 2 then 'BETWEEN'
            when contains(line, '≥') or contains(low, 'or above') then 'GTE' when contains(line, '≤') or contains(low, 'or below') then 'LTE' else 'EXISTS' end as operator from n)
        select trial_id, pos, operator, case when operator <> 'EXISTS' then v[1] end as value, cast(null as double) as max_value from o""")),
    "numeric_bounds_words": Query(_bounds(tx.bounds_operator_words), _q("""
        with n as (select *, list_transform(regexp_extract_all(line, """ + NUM + """), lambda x: cast(x as double)) as v,
          case """ + " ".join(f"when contains(lower(line), '{k}') then '{v}'" for k, v in lex.OPERATOR_WORDS.items()) + """ else 'EXISTS' end as operator from lines_d)
        select trial_id, pos, operator, case when operator in ('GT', 'GTE', 'LT', 'LTE', 'EQ') or (operator = 'BETWEEN' and len(v) >= 2) then v[1] end as value,
          case when operator = 'BETWEEN' and len(v) >= 2 then v[2] end as max_value from n""")),
    "numeric_bounds_signs": Query(_bounds(tx.bounds_sign_then_words), _q(r"""
        with n as (select *, regexp_extract(line, '(<=|=<|≤|<|>=|=>|≥|>|=)\s*([0-9]+(?:\.[0-9]+)?)', 1) as sg, try_cast(regexp_extract(line, '(<=|=<|≤|<|>=|=>|≥|>|=)\s*([0-9]+(?:\.[0-9]+)?)', 2) as double) as sv,
          try_cast(regexp_extract(line, '([0-9]+(?:\.[0-9]+)?)', 1) as double) as av, case """ + " ".join(f"when contains(lower(line), '{k}') then '{v}'" for k, v in lex.OPERATOR_SIGNS.items()) + r""" end as wo from lines_d)
        select trial_id, pos, case when sg <> '' then case sg """ + " ".join(f"when '{k}' then '{v}'" for k, v in lex.OPERATOR_SIGNS.items() if len(k) <= 2) + r""" end when wo is not null and av is not null then wo end as operator,
          case when sg <> '' then sv when wo is not null then av end as value, cast(null as double) as max_value from n""")),
    "negation_flags": Query(_negation, _q(NEGATION_SQL)),
    "line_flags": Query(_line_flags, _q(FLAGS_SQL)),
    "synonym_scan": Query(_synonyms, _q(SYNONYM_SQL)),
    "condition_filter": Query(_conditions, _q(CONDITION_SQL)),
    "condition_histogram": Query(_condition_histogram, _q(
        "select matched_term, count(*) as n from (" + CONDITION_SQL.replace("with t as", "with tt as").replace("join t on", "join tt on") + ") z group by 1 order by n desc, 1 limit 10")),
    "condition_codes": Query(lambda s, d: cr.condition_codes(_dx_codes(s, d)), _q(f"""
        select phrase, code from (select phrase, code, row_number() over (partition by phrase order by code) as r
          from (values {_values(lex.CONDITION_PREFIXES.items())}) v(phrase, prefix) join (select distinct code from pcodes where entity_type = 'diagnosis') c on starts_with(code, prefix)) t""")),
    "registered_conditions": Query(
        lambda s, d: cr.registered_conditions(_registered(s, d), _dx_codes(s, d)).select("trial_id", "raw_entity", "entity_code", "severity_weight"), _q(f"""
        select trial_id, condition as raw_entity, code as entity_code, 1.5e0 as severity_weight from registered
        join (select phrase, code from (values {_values(lex.CONDITION_PREFIXES.items())}) v(phrase, prefix) join (select distinct code from pcodes where entity_type = 'diagnosis') c on starts_with(code, prefix)) p
          on p.phrase = lower(trim(condition))""")),
    "phase_counts": Query(_phases, _q("select phase, count(*) as n from registered group by 1")),
    "condition_topk": Query(lambda s, d: qu.top_conditions(_registered(s, d)), _q("select condition, count(*) as n from registered group by 1 order by n desc, 1 limit 10")),
    "trial_facts": Query(_facts, _q("select trial_id, 1250 as n, 'Phase II' as phase, 'acute ' || cast(trial_id as varchar) || ' lung-injury' as condition from clinical_text")),
    "standard_codes": Query(_standard, """
        with t as (select p_partkey, p_partkey % 5 as k, lower(trim(case when p_size % 3 = 0 then ' Heart Failure ' when p_size % 3 = 1 then 'Creatinine' else p_name end)) as c from part)
        select p_partkey, case when k in (0, 3) then case c when 'heart failure' then 'I509' else 'ICD_' || replace(upper(c), ' ', '_') end
          when k = 1 then case c when 'creatinine' then '50912' else 'LAB_' || replace(upper(c), ' ', '_') end when k = 2 then 'NDC_' || replace(upper(c), ' ', '_') else 'UNKNOWN' end as code from t"""),
}
