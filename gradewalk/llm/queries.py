"""The operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradewalk.llm import fill_in_middle, filter_audit, fingerprints, langid, minhash, packing, pitman_yor, pivots, reply_trees, secrets, sentencepiece_bpe, toxicity, urls
from gradewalk.llm.common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_report(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.chat_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_fingerprints": op2_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash": op9_minhash,
    "op10_lm_score": op10_lm_score,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_format": op13_chat_format,
}

HOSTS = """parsed as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
  cut as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parsed)"""
ORACLES = {
    "op4_url_filter": "with " + HOSTS + ", rules(rule, verdict) as (values " + ", ".join(f"('{r}', '{v}')" for v, r in URL_RULES) + """),
  fits as (select c.page_id, c.host, c.path, r.rule, r.verdict, row_number() over (partition by c.page_id, c.host, c.path order by length(r.rule) desc nulls last, r.rule desc) as n from cut c left join rules r
    on (c.host = split_part(r.rule, '/', 1) or ends_with(c.host, '.' || split_part(r.rule, '/', 1))) and starts_with(c.path, substr(r.rule, instr(r.rule, '/'))))
  select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where n = 1""",
}


def _secret_sql() -> str:
    parts = []
    for place, r in enumerate([*secrets.BASE, *secrets.ADDED]):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select r, {place} as place, '{r.kind}' as kind, s, s + length(m) as e from (select r, m, g, coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s "
            f"from (select r, unnest(ms) as m, unnest(gs) as g, unnest(range(1, len(ms) + 1)) as i, ms, pieces from (select r, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {r.group}) as gs, string_split_regex(t, '{p}') as pieces from d where regexp_matches(t, '{p}')))) where length(g) >= {r.least}")
    one = "kind || ':' || s::bigint || ':' || e::bigint"
    return (
        "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), f as (" + " union all ".join(parts) + "), "
        f"k as (select r, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex, coalesce(string_agg({one}, ',' order by s, place) filter (place < {len(secrets.BASE)}), '') as base, string_agg({one}, ',' order by s, place) as spans from f group by 1) "
        "select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join k using (r)"
    )


ORACLES["op8_secret_scan"] = _secret_sql()

BITS = {x: 1 << i for i, x in enumerate("ABCDE")}
ORACLES["op11_filter_audit"] = f"""with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
  l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
  m as (select part, case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when coalesce(w.doc_id > first, false) then 16 else 0 end as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l on w.doc_id = l.doc_id),
  c as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by 1, 2),
  b(x, bit) as (values {", ".join(f"('{x}', {bit})" for x, bit in BITS.items())}),
  o as (select p.x || q.x || r.x || s.x || t.x as filter_order from b p, b q, b r, b s, b t where p.bit + q.bit + r.bit + s.bit + t.bit = 31 and p.bit | q.bit | r.bit | s.bit | t.bit = 31),
  e as (select filter_order, step, (select bit from b where x = filter_order[step]) as own, coalesce((select sum(bit) from b where instr(filter_order, x) < step), 0)::int as before from o, range(1, 6) as k(step)),
  a as (select part, filter_order, step::int as step, own, sum(n) filter (mask & (before | own) = 0) as kept, sum(n) filter (mask & own <> 0 and mask & before = 0) as removed, sum(n) filter (mask & own <> 0 and mask & before <> 0) as redundant, sum(n) filter (mask = own) as unique_fails,
    sum(g) filter (mask & own <> 0 and mask & before = 0) as good_lost, sum(x) filter (mask & own <> 0 and mask & before = 0) as toxic_lost from e, c group by 1, 2, 3, 4)
  select part, filter_order, step, {", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley from a"""
ORACLES["op12_fill_in_middle"] = f"""with u as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as us, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
  r as (select *, len(us) as n, {", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))} from u),
  k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from r),
  p as (select *, array_to_string(us[:i], '') as pre, array_to_string(us[i + 1:j], '') as mid, array_to_string(us[j + 1:], '') as suf from k)
  select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""
_ESCAPED = "length(regexp_replace(regexp_replace({0}, '<(\\\\*/?s>)', '<\\\\\\1', 'g'), '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g'))"
ORACLES["op13_chat_format"] = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from (select conv_id, turn, role, text from conversations union all select -7, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' from range(2) as k(i)))
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, t)) as turns_sha256, coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(t, '' order by turn nulls first, role, t) filter (role = 'assistant'), '')) as loss_sha256, sum(13 + {_ESCAPED.format("role")} + {_ESCAPED.format("t")})::bigint as formatted_chars from c group by 1"""
