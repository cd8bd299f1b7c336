"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embeddings, lines, manifest, mixing, ogg, packing, pii, quality, search, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substrings": substrings.op2_substrings,
    "op3_quality": quality.op3_quality,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ogg": ogg.op6_ogg,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_lines": lines.op10_lines,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_manifest": manifest.op12_manifest,
    "op13_search": search.op13_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": """with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
  s as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w), n as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as said from s), f as (select said, min(doc_id) as first from n group by said),
  g as (select distinct doc_id, unnest(range(i, i + 13)) as place from n join f using (said) where first < doc_id), e as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from w),
  k as (select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n from e anti join g using (doc_id, place) group by doc_id)
  select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)""",
    "op4_embeddings": """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  u as (select *, sqrt(list_dot_product(e, e)) as norm from v where list_dot_product(e, e) > 0), l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
  r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), n as (select a, count(*) as n from l group by a), m as (select a, min(b) as b from r group by a)
  select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m.b, vec_id)) as component_id, vec_id <= coalesce(m.b, vec_id) as kept from embeddings left join n on n.a = vec_id left join m on m.a = vec_id""",
    "op11_decontamination": r"""with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
  iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
  i as (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as k from iw where len(w) > 0), j as (select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as said from i),
  d as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from dw, (select distinct size from j)), h as (select doc_id, k, size, item_id from (select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as said from d) join j using (said, size)),
  p as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(k, k + size)) as place from h) group by doc_id), n as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by doc_id)
  select doc_id, cast(len(w) as bigint) as n_words, coalesce(p.n, 0) as n_hit, coalesce(n.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(p.n, 0) > 0 as contaminated from dw left join p using (doc_id) left join n using (doc_id)""",
    "op12_manifest": r"""with recursive e as (select *, case when doc_id is not null and n_chars is not null and xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, strlen(cast(doc_id as varchar)) + 1), lambda k: list_prepend(256 + ord(cast(doc_id as varchar)[k]), [0, 0, 0, 0, 0, 0, 0, 0])))),
    lambda c, s: case when s > 0 then xor(c, s - 256) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) % 7 = 0 then 1 else 0 end as more from documents),
  f as (select doc_id, lang, more, [cast(doc_id as varchar), source, lang, cast(n_chars as varchar), text] as own, [cast(doc_id as varchar), source, lang, cast(n_chars + more as varchar), text] as other from e),
  g as (select doc_id, lang, sha256(array_to_string(list_transform(own, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) as leaf, sha256(array_to_string(list_transform(other, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) as other from f),
  h as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from g),
  t(lang, level, hs) as (select lang, 0, list(leaf order by i) from h group by lang union all select lang, level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda x: sha256(hs[2 * x + 1] || coalesce(hs[2 * x + 2], ''))) from t where len(hs) > 1),
  s as (select lang, hs[1] as subroot, row_number() over (order by lang nulls first) - 1 as g from t where len(hs) = 1),
  u(level, hs) as (select 0, list(subroot order by g) from s union all select level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda x: sha256(hs[2 * x + 1] || coalesce(hs[2 * x + 2], ''))) from u where len(hs) > 1),
  r as (select hs[1] as root from u where len(hs) = 1),
  p as (select doc_id, leaf, 0 as top, level, case when xor(i >> level, 1) >= len(hs) then 'S' when (i >> level) & 1 = 1 then 'L' || hs[xor(i >> level, 1) + 1] else 'R' || hs[xor(i >> level, 1) + 1] end as step from h join t on t.lang is not distinct from h.lang where len(hs) > 1
    union all select doc_id, leaf, 1, level, case when xor(g >> level, 1) >= len(hs) then 'S' when (g >> level) & 1 = 1 then 'L' || hs[xor(g >> level, 1) + 1] else 'R' || hs[xor(g >> level, 1) + 1] end from h join s on s.lang is not distinct from h.lang, u where len(hs) > 1),
  w as (select doc_id, leaf, list(step order by top, level) as way from p group by doc_id, leaf),
  a as (select h.doc_id, h.leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(way, []), lambda x: x[2:]), '')) as proof_sha256,
    list_reduce(list_prepend(h.other, coalesce(way, [])), lambda c, x: case x[1] when 'S' then sha256(c) when 'L' then sha256(x[2:] || c) else sha256(c || x[2:]) end) as folded_root from h join s on s.lang is not distinct from h.lang left join w on w.doc_id is not distinct from h.doc_id and w.leaf = h.leaf, r)
  select *, folded_root = root as verified from a""",
    "op13_search": r"""with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
  q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
  d as (select doc_id, cast(count(*) as bigint) as n from t group by doc_id), s as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from d), f as (select doc_id, term, cast(count(*) as bigint) as tf from t where term in (select term from q) group by doc_id, term),
  w as (select term, cast(floor(1000 * ln(cast(2 * any_value(nn) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from f, s group by term),
  i as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) as part from f join d using (doc_id) join w using (term), s),
  c as (select item_id, doc_id, cast(sum(part) as bigint) as score from q join i using (term) group by item_id, doc_id having sum(part) > 0), r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from c)
  select * from r where rank <= 50""",
}
