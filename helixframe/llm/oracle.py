"""SQL that states the results of the curation queries, where SQL can and is fast enough on whole tables."""

from __future__ import annotations

from ..functions.sequence import RESIDUES


def _clean(x: str = "sequence") -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^{RESIDUES}]', '', 'g')"


_GRAMS = "unnest(list_distinct(list_transform(range(greatest(length(s) - 4, 0)), lambda i: s[i + 1:i + 5])))"

_SPANS = """with recs as (select distinct id, sequence as s from (select id, sequence from candidates union all select id, sequence from train_seqs) where id is not null and length(sequence) >= 50),
 w as (select id, p, substr(s, p + 1, 50) as t from (select id, s, unnest(range(length(s) - 49)) as p from recs)), many as (select t from w group by t having min(id) <> max(id)),
 hit as (select w.id, w.p from w semi join many using (t)), g as (select id, p, sum(case when p - prev <= 50 then 0 else 1 end) over (partition by id order by p) as k from (select id, p, lag(p) over (partition by id order by p) as prev from hit)),
 spans as (select id as rec_id, min(p)::int as span_start, (max(p) - min(p) + 50)::int as span_len from g group by id, k)"""

_SIMILAR = f"""recs as (select distinct id, {_clean()} as s from cas13_sequences where id is not null and {_clean()} <> ''), grams as (select id, {_GRAMS} as t from recs),
 n as (select id, count(*) as n from grams group by id), pr as (select a.id as a, b.id as b, count(*) as c from grams a join grams b on a.t = b.t and a.id < b.id group by 1, 2),
 near as (select a, b from pr join n x on x.id = a join n y on y.id = b where c >= 0.7::double * (x.n + y.n - c))"""

_ACROSS = f"""ev as (select distinct split_name, id, {_clean()} as s from (select 'valid' as split_name, id, sequence from valid_seqs union all select 'test', id, sequence from test_seqs) where id is not null and {_clean()} <> ''),
 tr as (select distinct id, {_clean()} as s from train_seqs where id is not null and {_clean()} <> ''), eg as (select split_name, id, {_GRAMS} as t from ev), tg as (select id, {_GRAMS} as t from tr),
 en as (select split_name, id, count(*) as n from eg group by 1, 2), tn as (select id, count(*) as n from tg group by 1), pr as (select split_name, eg.id as a, tg.id as b, count(*) as c from eg join tg using (t) group by 1, 2, 3),
 found as (select pr.split_name, a as eval_id, b as train_id from pr join en on en.id = a and en.split_name = pr.split_name join tn on tn.id = b where c >= 0.6::double * (en.n + tn.n - c)
 union select split_name, ev.id, tr.id from ev join tr using (s))"""

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"
_RUNS = "unnest(list_distinct(list_transform(range(greatest(len(w) - 11, 0)), lambda i: array_to_string(w[i + 1:i + 12], ' '))))"

_HEX = "\\b(" + "|".join(f"[a-f]{{{k}}}[0-9][0-9a-f]{{{max(0, 5 - k)},}}" for k in range(5)) + "|[a-f]{5,}[0-9][0-9a-f]*)\\b"
_EVEN = f"""regexp_replace(regexp_replace(regexp_replace(x, '{_HEX}', '#', 'g'), '[0-9]+', '#', 'g'), '[ \\t\\x0B\\f]+', ' ', 'g')"""

_GROUPS = """recs as (select id, case when regexp_matches(operon_id, '[0-9]') then lower(trim(operon_id, chr(9) || chr(10) || chr(13) || ' ')) end as a, case when trim(sha256) <> '' then lower(sha256) end as b from cas13_sequences where id is not null),
 keys as (select id, 'a' || a as k from recs where a is not null union select id, 'b' || b from recs where b is not null), edges as (select distinct x.id as u, y.id as v from keys x join keys y using (k)),
 reach(u, v) as (select u, v from edges union select reach.u, e.v from reach join edges e on e.u = reach.v), grp as (select u as id, min(v) as group_id, count(*) as n from reach group by u)"""

SQL = {
    "p1_found": f"{_SPANS} select * from spans",
    "p1_amounts": f"{_SPANS} select rec_id, sum(span_len)::bigint as shared_chars, count(*) as n_spans, max(span_len) as longest from spans group by rec_id",
    "p3_found": f"with {_SIMILAR} select a as id_a, b as id_b from near",
    "p3_classes": f"""with {_SIMILAR}, cls as (select id, min(id) over (partition by s) as class_id, count(*) over (partition by s) as n_copies from recs),
 ends as (select a as p, b as q from near union all select b, a from near), lk as (select x.class_id as c, count(distinct y.class_id) as n from ends join cls x on x.id = p join cls y on y.id = q where x.class_id <> y.class_id group by 1)
 select r.id, coalesce(class_id, r.id) as class_id, coalesce(n_copies, 1)::bigint as n_copies, coalesce(n, 0)::bigint as n_links from (select distinct id from cas13_sequences where id is not null) r
 left join cls on cls.id = r.id left join lk on lk.c = cls.class_id""",
    "p4_found": f"with {_ACROSS} select * from found",
    "p4_report": f"""with {_ACROSS}, recs as (select distinct split_name, id, source from (select 'valid' as split_name, id, source from valid_seqs union all select 'test', id, source from test_seqs)),
 h as (select split_name, eval_id, count(*) as n from found group by 1, 2) select recs.split_name, source, count(*) as n_records, count(n) as n_overlapping, coalesce(sum(n), 0)::bigint as n_pairs
 from recs left join h on h.split_name = recs.split_name and h.eval_id = recs.id group by 1, 2""",
    "p5_found": f"with recursive {_GROUPS} select id, group_id from grp where n > 1",
    "p5_checks": "select count(distinct id) as n_rows, count(distinct id) as n_records, 0::bigint as n_unassigned, true as shares_hold, 0::bigint as n_divided from cas13_sequences",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_report": f"""with d as (select doc_id, unnest(range(len(w) - 11)) as p, unnest(list_transform(range(len(w) - 11), lambda i: array_to_string(w[i + 1:i + 12], ' '))) as r from (select distinct doc_id, {_WORDS} as w from documents where text is not null) where len(w) >= 12),
 i as (select distinct item_id, {_RUNS} as r from (select item_id, {_WORDS} as w from eval_items)), h as (select distinct doc_id, item_id, p from d join i using (r)),
 g as (select *, sum(case when p - prev <= 12 then 0 else 1 end) over (partition by doc_id, item_id order by p) as k from (select *, lag(p) over (partition by doc_id, item_id order by p) as prev from h)),
 s as (select doc_id, item_id, (max(p) - min(p) + 12)::int as n_words from g group by doc_id, item_id, k) select item_id, count(distinct doc_id) as n_docs, max(n_words) as longest_words from s group by item_id""",
    "p7_found": f"""with d as (select distinct doc_id, {_RUNS} as r from (select doc_id, {_WORDS} as w from documents where text is not null)), i as (select distinct item_id, {_RUNS} as r from (select item_id, {_WORDS} as w from eval_items))
 select distinct doc_id, item_id from d join i using (r)""",
    "p8_boilerplate": f"""with d as (select coalesce(source, '') as host, list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '<[^<>\\n]*>', chr(10), 'g')), '[\\r\\n]+'), lambda x: trim(x, ' ') <> '')) as lines from documents where text is not null),
 n as (select host, count(*) as docs from d group by host), l as (select host, unnest(list_distinct(list_transform(list_filter(lines, lambda x: len(list_filter(string_split_regex(x, '[ \\t\\x0B\\f]+'), lambda w: w <> '')) between 1 and 14), lambda x: trim({_EVEN}, ' ')))) as line from d where len(lines) > 1)
 select host, line, count(*) as n from l join n using (host) where length(line) >= 4 group by host, line, docs having count(*) >= 3 and count(*) >= 0.002::double * docs""",
}
