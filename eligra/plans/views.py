"""Hospital, registry and vocabulary inputs derived from the star-schema tables.

One SQL text serves both engines: ``view(spark, dir, name)`` runs it in Spark, and ``with_views``
puts it in front of an oracle query as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ICD10 = ("chr(cast(65 + {k} % 26 as int)) || lpad(cast(cast(floor({k} / 26) as bigint) % 20 as string), 2, '0')"
          " || cast(cast(floor({k} / 520) as bigint) % 4 as string)")
_ICD9 = ("substr(lpad(cast({k} as string), 5, '0'), 1, 3) || '.' || substr(lpad(cast({k} as string), 5, '0'), 4, 2)")

VIEWS = {
    "admissions_raw": """
        select o_custkey as subject_id, o_orderkey as hadm_id, o_orderdate as admittime from orders""",
    "crosswalk_raw": f"""
        select p_partkey as seq, {_ICD9.format(k='p_partkey')} as icd9cm, {_ICD10.format(k='p_partkey')} as icd10cm,
          case when p_size % 10 = 0 then '1' when p_size % 10 = 1 then null else '0' end as no_map
        from part""",
    "diagnoses_raw": f"""
        select o_custkey as subject_id, l_orderkey as hadm_id, l_linenumber as seq_num,
          case when l_linenumber = 3 then ' ' else '' end || {_ICD9.format(k='l_partkey')} as icd9_code
        from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 1""",
    "prescriptions_raw": """
        select o_custkey as subject_id, l_orderkey as hadm_id, p_name as drug,
          case when l_partkey % 17 = 0 then '0' else cast(10000 + l_partkey % 300 as string) || '.0' end as ndc
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        where l_linenumber % 2 = 0""",
    "labevents_raw": """
        select event_id, user_id as subject_id,
          case event_type when 'click' then 50912 when 'view' then 51222 when 'purchase' then 50931
                          when 'signup' then 50971 else 50983 end as itemid,
          ts as charttime, value as valuenum
        from events""",
    "trial_lines": """
        select * from (
          select l_suppkey as trial_id, l_partkey, l_returnflag, l_quantity,
            row_number() over (partition by l_suppkey
              order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as rn
          from lineitem) t where rn <= 12""",
    "criteria": f"""
        select trial_id, rn as criterion_idx,
          case when rn = 12 then 'administrative' when rn % 6 = 0 then 'lab'
               when rn % 6 = 1 then 'medication' else 'diagnosis' end as entity_type,
          case when rn = 12 then 'NON_CLINICAL' when rn = 11 then 'UNMATCHED_' || lpad(cast(l_partkey as string), 5, '0')
               when rn % 6 = 0 then (case cast(l_partkey % 5 as int) when 0 then '50912' when 1 then '51222'
                    when 2 then '50931' when 3 then '50971' else '50983' end)
               when rn % 6 = 1 then lpad(cast(10000 + l_partkey % 300 as string), 11, '0')
               else {_ICD10.format(k='l_partkey')} end as entity_code,
          case when rn % 6 = 0 and rn < 12 then (case cast(l_quantity as int) % 6 when 0 then 'GT' when 1 then 'LT'
                    when 2 then 'GTE' when 3 then 'LTE' when 4 then 'EQ' else 'BETWEEN' end)
               when rn % 6 > 1 and l_partkey % 13 = 0 then 'NOT_EXISTS' else 'EXISTS' end as operator,
          case when rn % 6 = 0 and rn < 12 then l_quantity end as value,
          case when rn % 6 = 0 and rn < 12 and cast(l_quantity as int) % 6 = 5 then l_quantity + 10 end as max_value,
          l_returnflag <> 'R' as is_inclusion, 0.5e0 + l_quantity / 50e0 as severity_weight
        from trial_lines""",
    "part_codes": f"select {_ICD10.format(k='p_partkey')} as c from part",
    "hierarchy_edges": """
        select distinct substr(c, 1, 3) as parent, c as child from part_codes
        union
        select distinct substr(c, 1, 1) as parent, substr(c, 1, 3) as child from part_codes""",
    "scored_pairs": """
        select d.doc_id as pair_id, d.doc_id % 10 as group_id, l.quality as y, (d.n_chars % 101) / 100e0 as score
        from documents d join labels l on d.doc_id = l.doc_id""",
    "criteria_text": """
        select doc_id as trial_id, 'Inclusion Criteria:' || chr(10) || text || chr(10) || 'Exclusion Criteria:' || chr(10)
          || 'creatinine ' || (case cast(doc_id % 5 as int) when 0 then '>= ' when 1 then '< ' when 2 then 'between 1 and '
               when 3 then 'at least ' else 'no more than ' end) || cast(doc_id % 30 + 2 as string) || ' mg' as eligibility_criteria
        from documents""",
}


def with_views(body: str, ctes: dict[str, str] | None = None) -> str:
    """``body`` preceded by every view it mentions, directly or through another one."""
    known = {**VIEWS, **(ctes or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in order:
                if known[name] is text:
                    continue
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = "with " + ",\n".join(f"{n} as ({known[n]})" for n in order)
    own = re.match(r"\s*with\s", body)
    return f"{ctes},\n{body[own.end():]}" if own else f"{ctes}\n{body}"


_opened: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its footer is read once per session."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _opened:
        _opened[key] = spark.read.parquet(path)
    return _opened[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"select * from {name}")
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
