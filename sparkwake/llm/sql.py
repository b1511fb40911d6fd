"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK_WORDS, MAX_REPEAT, SEED, SHARD_WORDS, WEIGHTS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

def url_sql() -> str:
    """Rules by length; then all token sets that are frequent and confident, found by listing the subsets of each labelled URL."""
    from .queries import URL_RULES
    from .url_filter import DEFAULT, MIN_CONFIDENCE, MIN_SUPPORT

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
with parsed as (
  select page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UP}', '{_LOW}') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
rules(v, h, p) as (values {rules}),
fits as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as label
  from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
tokened as (
  select page_id, host, path, rule, label, case when host = '' then [] else list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(coalesce(regexp_extract(url, '\\?([^#]*)', 1), ''), '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1]),
    [case when starts_with(url, 'https://') then 's:https' else 's:other' end]))) end as tokens
  from parsed left join fits using (page_id)),
labelled as (select page_id, tokens, label from tokened where label is not null),
subsets as (
  select label, list_filter(tokens, lambda x, i: (mask >> (i - 1)::int) & 1 = 1) as rule
  from labelled, lateral (select unnest(generate_series(1, (1 << len(tokens)) - 1)) as mask)),
counted as (select rule, label, count(*) as n, sum(count(*)) over (partition by rule) as m from subsets group by rule, label),
mined as (
  select rule, label, n / m as confidence, n / (select count(*) from labelled) as support from counted
  where n >= ceil({MIN_SUPPORT} * (select count(*) from labelled)) and n / m >= {MIN_CONFIDENCE}),
parts as (select rule, label, confidence, unnest(list_transform(rule, lambda t: list_filter(rule, lambda u: u <> t))) as part from mined),
weaker as (select distinct p.rule, p.label from parts p join mined g on g.rule = p.part and g.label = p.label and g.confidence >= p.confidence),
kept as (select * from mined anti join weaker using (rule, label)),
best as (
  select page_id, max_by(struct_pack(l := k.label, c := confidence), struct_pack(a := confidence, b := support, c := k.label, d := k.rule)) as b
  from tokened t join kept k on list_has_all(t.tokens, k.rule) where t.label is null group by page_id)
select page_id, host, path, rule, coalesce(label, b.l, '{DEFAULT}') as verdict,
       case when rule is not null then 'rule' when b is not null then 'mined' else 'default' end as "by", case when rule is null then b.c end as confidence
from tokened left join best using (page_id)
"""


OP4 = f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) end as s from d),
t as (select doc_id, len(s)::bigint as n, unnest(s) as x from s),
pairs as (select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as u, count(*) as c from t a join t b using (x) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n),
links as (select a, b from pairs where 100 * c >= 80 * u),
edges as (select a as x, b as y from links union all select b, a from links),
reach as (select doc_id as x, doc_id as y from documents union select reach.x, edges.y from reach join edges on reach.y = edges.x),
roots as (select x as doc_id, min(y) as component_id from reach group by x)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join roots using (doc_id)
"""

OP9 = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from d join g using (norm)
"""


def _seats(parties: str, group: str, party: str, weight: str, seats: str) -> str:
    """Sainte-Laguë by ranking quotients, over a superset of those that can win."""
    by = f"partition by {group}" if group else ""
    key = f"{group}, {party}" if group else party
    return f"""
    select {key}, (max(lo) + count(*) filter (nth <= open))::bigint as seats from (
      select {key}, lo, open, row_number() over ({by} order by w / (2 * k - 1) desc, {party}, k) as nth from (
        select {key}, w, lo, open, unnest(generate_series(lo + 1, hi)) as k from (
          select *, (n - sum(lo) over ({by}))::double as open from (
            select *, greatest(0, floor(w * (n - m / 2.0) / total + 0.5) - 1)::bigint as lo,
                   (floor(w * (n + m / 2.0) / total + 0.5) + 1)::bigint as hi from (
              select {key}, w, n, sum(w) over ({by}) as total, count(*) over ({by}) as m from (
                select {key}, ({weight})::double as w, ({seats})::double as n from {parties}) where w > 0 and n > 0))))) group by {key}
    """


def mix_sql(documents: str = "documents") -> str:
    b = BLOCK_WORDS
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, coalesce('s' || source, 'n') as skey
  from {documents}),
src as (select skey, source, sum(size)::bigint as source_size from sized group by skey, source),
weighed as (
  select *, (source_size * {MAX_REPEAT})::bigint as cap,
         {list(WEIGHTS)}[((row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} + 1)::int]::bigint as weight from src),
tight as (
  select *, row_number() over o as nth,
         (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
         (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as rest_weight
  from weighed window o as (order by cap::double / weight, source asc nulls last)),
stop as (select min_by(struct_pack(nth := nth, rest := rest, rest_weight := rest_weight), nth) as f from tight where cap * rest_weight > rest * weight),
targets as (
  select skey, source, source_size,
         case when f is null or nth < f.nth then cap::double else (f.rest * weight)::double / f.rest_weight::double end as target
  from tight, stop),
sources as (
  select *, greatest(1, (sum(source_size) over () + {b // 2}) // {b})::bigint as blocks,
         greatest(1, (source_size + {SHARD_WORDS - 1}) // {SHARD_WORDS})::bigint as shards from targets),
seats as ({_seats("sources", "", "skey", "target", "blocks")}),
placed as (
  select skey, doc_id, size, ('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id)), 1, 8))::bigint % shards as shard,
         md5(concat_ws('|', '{SEED}', 'order', doc_id)) as turn
  from sized join sources using (skey) where size > 0),
laid as (
  select *, (sum(size) over (partition by skey, shard order by turn, doc_id, size rows unbounded preceding) - size)::bigint as start from placed),
shards as (select skey, shard, sum(size)::bigint as shard_size from laid group by skey, shard),
shares as (select * from shards join seats using (skey)),
quotas as ({_seats("shares", "skey", "shard", "shard_size", "seats")}),
bounded as (
  select skey, shard, n, least(seats, n * {MAX_REPEAT}) as quota
  from (select *, (shard_size + {b - 1}) // {b} as n from shards join quotas using (skey, shard)) where least(seats, n * {MAX_REPEAT}) > 0),
blocks as (select skey, shard, n, quota, unnest(generate_series(0, n - 1)) as b from bounded),
chosen as (
  select skey, shard, b, quota // n + (row_number() over (partition by skey, shard order by md5(concat_ws('|', '{SEED}', skey, shard, b)), b) <= quota % n)::int as copies
  from blocks),
pieces as (
  select skey, shard, start, doc_id, size, unnest(generate_series(start // {b}, (start + size - 1) // {b})) as b from laid),
taken as (
  select skey, shard, start, doc_id, size,
         sum((least(start + size, (b + 1) * {b}) - greatest(start, b * {b})) * coalesce(copies, 0))::bigint as taken
  from pieces left join chosen using (skey, shard, b) group by all)
select doc_id, size, source_size, target, taken from (
  select skey, doc_id, size, taken from taken
  union all select skey, doc_id, size, 0 from sized where size = 0) join sources using (skey)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1, "op2_url_filter": url_sql(), "op4_near_dedup": OP4, "op9_exact_dedup": OP9, "op10_mix_sources": mix_sql()}
