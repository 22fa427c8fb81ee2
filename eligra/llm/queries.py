"""Registered queries of the corpus operators, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eligra.llm import (alignment, decontamination, importance, mixing, neighbours, pii, quality, secret_scan, simhash, substring_dedup, suffix_dedup,
                        toxicity, url_filter)


TOKENIZERS = "/opt/tokenizers"
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), owner_col="source", repo_col="lang", max_owners=3)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.decide(_table(spark, sf_dir, "documents"), share=1.5, cap=2.0, weights=(3, 1, 2))
            .select("doc_id", "size", "source_size", "target", "taken", "source", "copies"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, one row for each document and item; clean documents have none."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=13, same=0.8).drop("rid")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, distance=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.tag(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), run=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_neighbours": op2_neighbours,
    "op3_source_mix": op3_source_mix,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
    "op11_importance": op11_importance,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_alignment": op13_alignment,
}

def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: The base patterns and the token pattern in DuckDB's dialect, with the group that holds the value and its least length.
SECRET_PATTERNS = (
    (f"({_either_case('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32), ("[A-Za-z0-9+/_=-]{12,}", 0, 12))

ORACLES: dict[str, str] = {
    "op1_secret_scan": f"""
        with t as (select row_number() over () as rn, doc_id, coalesce(text, '') as x, coalesce(source, '') as owner,
            concat_ws(chr(0), source, lang) as repo from documents),
        hits as ({" union all ".join(
            f"select rn, {k} as kind, unnest(regexp_extract_all(x, '{p}', 0)) as hit, unnest(regexp_extract_all(x, '{p}', {g})) as val, "
            f"unnest(string_split_regex(x, '{p}')[:-2]) as gap, generate_subscripts(regexp_extract_all(x, '{p}', 0), 1) as i, {n} as least "
            f"from t where regexp_matches(x, '{p}')" for k, (p, g, n) in enumerate(SECRET_PATTERNS))}),
        placed as (select rn, kind, val, least, sum(length(gap) + length(hit)) over (partition by rn, kind order by i) as e, length(hit) as n from hits),
        sized as (select rn, kind, val, e - n as s, e from placed where length(val) >= least),
        looks as (select *, len(list_distinct(string_split(val, ''))) as chars, regexp_matches(val, '[0-9]') as d, regexp_matches(val, '[a-z]') as lo,
            regexp_matches(val, '[A-Z]') as up from sized),
        base as (select * from looks where kind < 3),
        tokens as (select * from looks k where kind = 3 and d and (lo or up) and chars >= 8 and not exists (
            select 1 from base b where b.rn = k.rn and b.s < k.e and k.s < b.e)),
        every as (select * from base union all select * from tokens),
        owners as (select val, count(distinct owner) as owners, bool_or(kind < 3) as known from every join t using (rn) group by val),
        found as (select e.rn, e.kind, e.s, e.e, length(e.val) >= 12 and e.d and (e.lo or e.up) and e.chars >= 8 as live, o.owners > 3 as copied
          from every e join owners o using (val)
          where e.kind < 3 or (o.owners <= 3 and (o.known or (length(e.val) >= 20 and e.d and e.lo and e.up and e.chars >= 12)))),
        named as (select *, (case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'owned' end) || ':' || cast(s as bigint) || ':' || cast(e as bigint) as span
          from found),
        rows as (select rn, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
            string_agg(span, ',' order by s, kind) filter (kind < 3) as base, string_agg(span, ',' order by s, kind) as spans,
            count(*) filter (live and not copied) as n_live, count(*) filter (copied) as n_copied from named group by rn)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
          sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
        from t left join rows using (rn)""",
    "op9_suffix_dedup": """
        with t as (select row_number() over () as rn, doc_id, encode(coalesce(text, '')) as b from documents),
        w as (select rn, b, unnest(range(0, octet_length(b) - 199)) as i from t where octet_length(b) >= 200),
        k as (select rn, i, md5(array_slice(b, i + 1, i + 200)) as h from w),
        d as (select rn, i from k qualify count(*) over (partition by h) > 1),
        g as (select rn, i, case when i - lag(i) over (partition by rn order by i) <= 200 then 0 else 1 end as start from d),
        r as (select rn, i, sum(start) over (partition by rn order by i) as run from g),
        runs as (select rn, min(i) as s, max(i) + 200 as e from r group by rn, run),
        gaps as (select rn, coalesce(lag(e) over (partition by rn order by s), 0) as a, s as z from runs
          union all select rn, max(e), 9223372036854775806 from runs group by rn),
        pieces as (select gaps.rn, a, case when z > a and octet_length(b) > a then hex(array_slice(b, a + 1, least(z, octet_length(b)))) else '' end as piece from gaps join t using (rn)),
        kept as (select rn, sha256(unhex(string_agg(piece, '' order by a))) as kept from pieces group by rn),
        sums as (select rn, cast(sum(e - s) as bigint) as n_removed, count(*) as n_spans from runs group by rn)
        select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
          coalesce(kept, sha256(b)) as kept_sha256 from t left join sums using (rn) left join kept using (rn)""",
    "op11_importance": """
        with d as (select row_number() over () as rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
        dw as (select rn, unnest(w) as word from d), bw as (select unnest(w) as word from b),
        known as (select distinct word from (select word from dw union all select word from bw)),
        crc as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(word))),
              lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
              lambda c, x: list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                lambda y, z: xor(y >> 1, case when y & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint) % 10000 as bucket from known),
        s as (select bucket, count(*) as n from dw join crc using (word) group by bucket),
        t as (select bucket, count(*) as n from bw join crc using (word) group by bucket),
        g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from dw) + 10000)
              / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bw) + 10000))))::bigint as gain
          from (select distinct bucket from crc) left join s using (bucket) left join t using (bucket)),
        sums as (select rn, sum(gain)::bigint as total from dw join crc using (word) join g using (bucket) group by rn),
        scored as (select rn, doc_id, len(w)::bigint as n_features, coalesce(floor(total / len(w)), 0)::bigint as weight,
            ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join sums using (rn)),
        full_score as (select rn, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
        places as (select rn, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from full_score where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from full_score left join places using (rn)""",
    "op12_substring_dedup": """
        with t as (select row_number() over () as rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        p as (select rn, doc_id, w, unnest(range(0, len(w) - 49)) as i from t where len(w) >= 50),
        k as (select rn, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as h from p),
        least as (select h, min(doc_id) as first from k group by h),
        gone as (select rn, i from k join least using (h) where doc_id > first),
        lost as (select distinct rn, i + j as pos from gone, range(0, 50) r(j)),
        words as (select rn, unnest(w) as word, unnest(range(0, len(w))) as pos from t),
        kept as (select rn, string_agg(word, ' ' order by pos) as kept from words anti join lost using (rn, pos) group by rn),
        sums as (select rn, count(*) as n from lost group by rn)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from t left join kept using (rn) left join sums using (rn)""",
    "op7_url_filter": f"""
        with rules(verdict, rule) as (values {", ".join(f"('{v}', '{h}{p}')" for v, h, p in URL_RULES)}),
        rest as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as r from pages),
        parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from rest),
        fits as (select n, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
          from parts join rules on ends_with('.' || host, '.' || split_part(rule, '/', 1))
            and starts_with(path, substr(rule, position('/' in rule))) group by n)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (n)""",
}
