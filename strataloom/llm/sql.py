"""Independent SQL for the queries that SQL can express."""

from __future__ import annotations

from strataloom.plans.sql_text import CANONICAL_IDENTITY, PIECES

SQL: dict[str, str] = {}

_RANKED = """
with m as (
  select match_id, any_value(queue_id) q, any_value(embedding_score) e, any_value(nullif(description_score, 0)) d,
         any_value(structural_score) s, any_value(-locality_tier) t
  from matches where match_id is not null group by match_id
), x as (
  select match_id, q, sig, v from (
    select match_id, q, 'e' sig, e::double v from m union all select match_id, q, 'd', d from m
    union all select match_id, q, 's', s from m union all select match_id, q, 't', t::double from m)
  where v is not null and not isnan(v) and q is not null
), r as (
  select match_id, q, (rank() over (partition by q, sig order by v) - 1
    + count(*) over (partition by q, sig, v) / 2) / count(*) over (partition by q, sig) p from x
), v as (
  select match_id, q, count(*)::int scored, list_sort(list_transform(list(p) || list_resize([]::double[], 4 - count(*), avg(p)), lambda x: round(x, 12))) vec from r group by match_id, q
), o as (
  select match_id, q queue_id, scored, row_number() over (partition by q order by vec desc, match_id) place from v
)
"""
SQL["p1_found"] = _RANKED + "select queue_id, match_id from o join review_queues using (queue_id) where place <= top_k"
SQL["p1_order"] = _RANKED + "select queue_id, match_id, place, scored from o"

SQL["p6_found"] = f"""
with recursive ends as (
  select left_identity l, right_identity r from matches where left_identity is not null and right_identity is not null
  union
  select p.left_identity, p.right_identity from matches m join pairs p using (pair_id)
  where m.left_identity is null or m.right_identity is null
), e as (
  select distinct {CANONICAL_IDENTITY('l')} a, {CANONICAL_IDENTITY('r')} b from ends
), s as (select a, b from e where a <> b union select b, a from e where a <> b),
reach as (select a identity, b other from s union select reach.identity, s.b from reach join s on s.a = reach.other)
select identity, min(other) group_identity from reach group by identity
"""

_SHINGLES = """
with c as (
  select block_id, max_by(content, loaded_at) body from blocks where block_id is not null group by block_id
), t as (
  select block_id, body, regexp_extract_all(body, '[A-Za-z0-9_]+|[^ \\t\\r\\n]') k from c where body <> ''
), s as (
  select distinct block_id, md5(array_to_string(k[i:i + 4], chr(1))) h
  from (select block_id, k, unnest(range(1, len(k) - 3)) i from t where len(k) >= 5)
), n as (select block_id, count(*) n from s group by block_id)
"""
SQL["p3_found"] = _SHINGLES + """
select a.block_id block_a, b.block_id block_b from s a join s b on a.h = b.h and a.block_id < b.block_id
join n x on x.block_id = a.block_id join n y on y.block_id = b.block_id
group by a.block_id, b.block_id, x.n, y.n having 5 * count(*) >= 3 * (x.n + y.n - count(*))
union
select a.block_id, b.block_id from t a join t b on a.body = b.body and a.block_id < b.block_id
"""
SQL["p5_found"] = """
with v as (
  select vec_id, any_value(channel) ch, any_value(vec)::double[] x from vectors
  where vec_id is not null and channel is not null and len(vec) = 64 and len(list_filter(vec, lambda e: e is null or not isfinite(e))) = 0
    and len(list_filter(vec, lambda e: e <> 0)) > 0 group by vec_id
), s as (
  select a.vec_id i, b.vec_id j, list_cosine_similarity(a.x, b.x) c from v a join v b on a.ch = b.ch and a.vec_id <> b.vec_id
), r as (select i, j, c, row_number() over (partition by i order by round(c, 12) desc, j) k from s)
select distinct least(i, j) vec_a, greatest(i, j) vec_b from r where k <= 5 and c >= 0.85
"""

_LAST = "(select block_id, max_by(content, loaded_at) body from blocks where block_id is not null group by block_id)"
_CUT = PIECES(f"(select block_id, body from {_LAST} where strlen(body) > 2000)")
SQL["p4_found"] = f"with recursive {_CUT} select block_id, ix::int chunk_ix, s::int start_byte, e::int end_byte from p"
SQL["p4_match_pieces"] = f"""
with recursive {_CUT},
c as (select block_id, count(*) k from p group by 1),
i as (select {CANONICAL_IDENTITY('identity')} identity, max(coalesce(k, 1)) pieces from (select block_id, max_by(identity, loaded_at) identity from blocks where block_id is not null group by 1) left join c using (block_id)
  where identity is not null group by 1),
m as (select match_id, max_by(left_identity, loaded_at) li, max_by(right_identity, loaded_at) ri, max_by(left_chunk, loaded_at) lc, max_by(right_chunk, loaded_at) rc from matches where match_id is not null group by 1),
s as (select match_id, 'left' side, {CANONICAL_IDENTITY('li')} identity, lc chunk_ix from m union all select match_id, 'right', {CANONICAL_IDENTITY('ri')}, rc from m)
select match_id, side, chunk_ix, case when pieces is null then 'no block' when chunk_ix < pieces then 'piece' else 'out of date' end state
from s left join i using (identity) where identity is not null and chunk_ix is not null
"""
