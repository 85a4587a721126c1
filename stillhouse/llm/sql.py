"""DuckDB equivalents of the training-text queries that SQL can express on the test tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

_GRAMS = f"""ew as (select item_id, {_WORDS.format('text')} as w from eval_items where text is not null), eg as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 9)) as i from ew)),
 dw as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), dg as (select distinct doc_id, array_to_string(w[i:i + 9], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 9)) as i from dw)), hit as (select distinct doc_id, item_id from dg join eg using (g))"""

_NEAR = f"""rec as (select distinct 'chunk' as record_kind, chunk_id as id, text as t from document_chunks union select 'question', id, question from qa_benchmark), rw as (select record_kind, id, {_WORDS.format('t')} as w from rec where t is not null),
 sh as (select distinct record_kind, id, array_to_string(w[i:i + 2], ' ') as g from (select record_kind, id, w, unnest(generate_series(1, len(w) - 2)) as i from rw)), n as (select record_kind, id, count(*) as n from sh group by 1, 2),
 c as (select a.record_kind, a.id as id_a, b.id as id_b, count(*) as c from sh a join sh b on a.record_kind = b.record_kind and a.g = b.g and a.id < b.id group by all)
 select c.record_kind, id_a, id_b from c join n x on x.record_kind = c.record_kind and x.id = id_a join n y on y.record_kind = c.record_kind and y.id = id_b where c.c >= 0.45 * (x.n + y.n - c.c)"""

_NEIGHBOURS = """fx as (select profile_id as id, unnest(map_entries(features)) as e from sample_profiles), v as (select id, replace(lower(trim(e.key)), ' ', '_') as f, e.value as x from fx where e.value is not null and not isnan(e.value)),
 sq as (select p.profile_id as id, coalesce(sum(x * x), 0) as s from sample_profiles p left join v on v.id = p.profile_id group by 1), dt as (select a.id as a, b.id as b, sum(a.x * b.x) as d from v a join v b using (f) where a.id <> b.id group by 1, 2),
 ds as (select p.id as a, q.id as b, sqrt(greatest(p.s + q.s - 2 * coalesce(d, 0), 0)) as d from sq p join sq q on p.id <> q.id left join dt on dt.a = p.id and dt.b = q.id), r as (select *, row_number() over (partition by a order by d, b) as r from ds)"""

_RAW = r"""regexp_replace(trim(regexp_replace(regexp_replace(translate(upper(raw_sample_id), '０１２３４５６７８９', '0123456789'), '^.*[/\\]|^\s*[A-Z]+:', ''), '^\s+|\s+$', '', 'g')), '\.(XLSX?|CSV|TSV|TXT|JSON|PDF|DAT)$', '')"""
_SPLITS = rf"""m as (select entry_id, lower(trim(split)) as split, nullif(lower(trim(sample_id)), '') as sid, regexp_replace({_RAW}, '(?:[\s_\-]*(?:\(\d+\)|COPY|DUP(?:LICATE)?|RE-?RUN(?:[\s_\-]*\d+)?|[\s_\-]R\d+))+\s*$', '') as x from manifest),
 k as (select entry_id, split, sid, regexp_extract(x, '^\s*([A-Z]+)(?:[^A-Z0-9]+|)([0-9O](?:[0-9O\s]*[0-9O])?)[^A-Z0-9]*(F[0-9])?\s*$', 1) as l, regexp_extract(x, '^\s*([A-Z]+)(?:[^A-Z0-9]+|)([0-9O](?:[0-9O\s]*[0-9O])?)[^A-Z0-9]*(F[0-9])?\s*$', 2) as n, regexp_extract(x, '^\s*([A-Z]+)(?:[^A-Z0-9]+|)([0-9O](?:[0-9O\s]*[0-9O])?)[^A-Z0-9]*(F[0-9])?\s*$', 3) as f from m where split in ('train', 'test', 'valid')),
 e as (select entry_id, split, 's' || sid as key from k where sid is not null union select entry_id, split, 'r' || l || ltrim(replace(regexp_replace(n, '\s', '', 'g'), 'O', '0'), '0') || f from k where l <> ''),
 nb as (select distinct a.entry_id as a, b.entry_id as b from e a join e b using (key)), reach as (with recursive t(a, b) as (select a, b from nb union select t.a, nb.b from t join nb on t.b = nb.a) select distinct a, b from t)
 select distinct least(p.entry_id, q.entry_id) as entry_id_a, greatest(p.entry_id, q.entry_id) as entry_id_b from reach join k p on p.entry_id = a join k q on q.entry_id = b where p.split = 'train' and q.split <> 'train'"""

_FOLDED = rf"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RAW}, '(?:[\s_\-]*(?:\(\d+\)|COPY|DUP(?:LICATE)?|RE-?RUN(?:[\s_\-]*\d+)?|[\s_\-]R\d+))+\s*$', ''), '[^\p{{L}}\p{{N}}]', '', 'g'), '^([^0-9]*[^0-9])0+([0-9])', '\1\2'), 'O+', 'O', 'g'), '')"""

_RUNS = f"""ep as (select item_id, i - 1 as pi, array_to_string(w[i:i + 9], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 9)) as i from (select distinct item_id, {_WORDS.format('text')} as w from eval_items where text is not null))),
 dp as (select doc_id, i - 1 as pd, array_to_string(w[i:i + 9], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 9)) as i from (select distinct doc_id, {_WORDS.format('text')} as w from documents where text is not null))),
 mt as (select doc_id, item_id, pd, pi, pd - row_number() over (partition by doc_id, item_id, pd - pi order by pd) as island from dp join ep using (g)), rn as (select doc_id, item_id, min(pd) as doc_word, min(pi) as item_word, count(*) + 9 as words from mt group by doc_id, item_id, pd - pi, island),
 best as (select doc_id, item_id, words, doc_word, item_word from (select *, row_number() over (partition by doc_id, item_id order by words desc, doc_word, item_word) as r from rn) where r = 1)"""

SQL = {
    "p3_found": f"with {_NEAR}",
    "p4_found": f"with {_NEIGHBOURS} select distinct least(a, b) as profile_id_a, greatest(a, b) as profile_id_b from r where r <= 5 and d <= 2.0",
    "p4_nearest": f'with {_NEIGHBOURS} select a as id, b as neighbour, r as rank, round(d, 6) as distance from r where r <= 5 and a % 50 = 0',
    "p5_found": f"with {_SPLITS}",
    "p9_found": f"with {_GRAMS} select doc_id, item_id from hit",
    "p5_report": f"""with {_SPLITS.rsplit("select distinct least", 1)[0].rstrip()}, v as (select distinct k.entry_id, k.split, m.source from k join manifest m using (entry_id) where k.split <> 'train'), t as (select distinct a from reach join k on k.entry_id = b where k.split = 'train') select split, source, count(*) as entries, count(t.a) as overlapping from v left join t on t.a = v.entry_id where exists (select 1 from e where e.entry_id = v.entry_id) group by 1, 2""",
    "p5_groups": f"""with {_SPLITS.rsplit("select distinct least", 1)[0].rstrip()}, c as (select r.a, min(r.b) as class_id, count(distinct r.b) filter (k.split = 'train') as tr, count(distinct r.b) filter (k.split <> 'train') as ev from reach r join k on k.entry_id = r.b group by 1)
 select k.entry_id, k.split, m.source, class_id, case when k.split = 'train' then ev else tr end as partners from k join manifest m using (entry_id) join c on c.a = k.entry_id""",
    "p5_links": rf"""with m as (select distinct lower(trim(split)) as split, {_FOLDED} as s from manifest), e as (select distinct s from m where split in ('test', 'valid') and s is not null), t as (select distinct s from m where split = 'train' and s is not null),
 n as (select distinct case when s like '%O%' then regexp_replace(s, '^([A-Z]+?)O([0-9])', '\1\2') else s end as nm, s from m where s is not null) select e.s as s_eval, t.s as s_train, levenshtein(e.s, t.s)::int as edits, x.nm = y.nm as same from e join t on levenshtein(e.s, t.s) <= 1 join n x on x.s = e.s join n y on y.s = t.s""",
    "p9_matches": f"with {_RUNS} select * from best",
    "p9_items": f"with {_RUNS}, n as (select item_id, count(*) as documents, max(words) as longest from best group by 1) select i.item_id, suite, coalesce(documents, 0) as documents, coalesce(longest, 0) as longest from (select distinct item_id, suite from eval_items) i left join n on n.item_id = i.item_id",
    "p9_clean_documents": f"with {_GRAMS} select doc_id from documents where doc_id not in (select doc_id from hit)",
}
