"""The text operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, jaccard, langid, license, lines, ngrams, quality, repeats, tokens

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_lm_scores": ngrams.op2_lm_scores,
    "op3_language_id": langid.op3_language_id,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_license_scan": license.op6_license_scan,
    "op7_repeated_spans": repeats.op7_repeated_spans,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

_WORDS = r"""w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)"""

OP2_SQL = f"""
with {_WORDS},
t as (select doc_id, w[i] as b, case when i > 1 then w[i - 1] end as a from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)),
u as (select b, count(*)::double as n from t group by b), total as (select sum(n) as n from u),
g as (select a, b, count(*)::double as n from t where a is not null group by a, b),
s as (select t.doc_id, coalesce(t.a is not null and g.n < {ngrams.MIN_COUNT}, false) as off,
  case when t.a is null then ln(u.n / total.n) when g.n >= {ngrams.MIN_COUNT} then ln(g.n / v.n) else ln({ngrams.BACKOFF}::double * u.n / total.n) end as x
  from t join u on u.b = t.b left join g on g.a = t.a and g.b = t.b left join u v on v.b = t.a, total)
select d.doc_id, count(s.x) as n_words, count(*) filter (where s.off) as n_backoff, round(coalesce(sum(s.x), 0), 3) as log_score,
  case when count(s.x) > 0 then round(sum(s.x) / count(s.x), 6) end as mean_log_score
from documents d left join s on s.doc_id = d.doc_id group by d.doc_id
"""

OP9_SQL = f"""
with recursive {_WORDS},
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as h from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.root) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_lm_scores": OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op9_jaccard_join": OP9_SQL,
}
