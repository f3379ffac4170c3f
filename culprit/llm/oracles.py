"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

#: The base-32 digits of five hexadecimal digits at a time.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as integer) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '')"

WARC = f"""with records as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type, case when page_id is distinct from top then top end as refers_to from records"""

EMBEDDINGS = """with recursive usable as (select vec_id, cast(embedding as double[]) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9),
  reached(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reached r join links l on l.a = r.b),
  components as (select a as vec_id, min(b) as component_id from reached group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from components"""

SUBSTRINGS = """with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  strings as (select doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as s from bytes where length(h) >= 200)),
  again as (select doc_id, s from strings qualify row_number() over (partition by m order by doc_id, s) > 1),
  marked as (select *, case when s - lag(s) over (partition by doc_id order by s) <= 100 then 0 else 1 end as fresh from again),
  spans as (select doc_id, k, min(s) as a, max(s) + 100 as z from (select *, sum(fresh) over (partition by doc_id order by s) as k from marked) group by doc_id, k),
  pieces as (select doc_id, k, a, z, lag(z, 1, 0) over (partition by doc_id order by k) as p from spans),
  cut as (select doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by k) || substr(any_value(h), 2 * max(z) + 1) as kept, sum(z - a) as n_removed, count(*) as n_spans
    from pieces join bytes using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from bytes left join cut using (doc_id)"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""with items as (select item_id, {_WORDS} as w from benchmark),
  windows as (select item_id, least(13, len(w)) as n, array_to_string(w[k : k + 12], ' ') as t from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as k from items where len(w) > 0)),
  docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
  places as (select r, k, n, array_to_string(w[k : k + n - 1], ' ') as t from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from docs join (select distinct n from windows) on len(w) >= n)),
  met as (select r, k, p.n, item_id from places p join windows i on i.t = p.t and i.n = p.n),
  hits as (select r, count(distinct place) as n_hit from (select r, unnest(range(k, k + n)) as place from met) group by r),
  ids as (select r, count(distinct cast(item_id as varchar)) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from met group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (r) left join ids using (r)"""

SQL = {"op1_warc_revisits": WARC, "op5_embedding_neardup": EMBEDDINGS, "op9_substring_dedup": SUBSTRINGS, "op10_decontamination": DECONTAMINATION}
