"""Fragments of SQL shared by the independent statements."""

from __future__ import annotations


def CANONICAL_PATH(c: str) -> str:  # noqa: N802
    """Forward slashes, no leading or inner ``./``; the tables hold no other irregular paths."""
    return f"regexp_replace(regexp_replace(replace({c}, '\\', '/'), '^(\\./)+', ''), '/(\\./|/)+', '/', 'g')"


def CANONICAL_IDENTITY(c: str) -> str:  # noqa: N802
    return f"{CANONICAL_PATH(f'''split_part({c}, '::', 1)''')} || substr({c}, instr({c}, '::'))"


def PIECES(bodies: str, limit: int = 2000, window: int = 512, overlap: int = 256) -> str:  # noqa: N802
    """``p`` (block_id, ix, s, e, n): pieces of texts as byte ranges, by recursion over hex strings and the bytes after
    each line end. bodies: (block_id, body)."""
    inside = "substr(h, 2 * ({0}) + 1, 1) in ('8', '9', 'A', 'B')"
    back = f"case when not {inside.format(f's + {limit}')} then s + {limit} when not {inside.format(f's + {limit - 1}')} then s + {limit - 1} when not {inside.format(f's + {limit - 2}')} then s + {limit - 2} else s + {limit - 3} end"
    end = f"case when n - s <= {limit} then n else coalesce(list_max(list_filter(l, lambda q: q > s + {limit - window} and q <= s + {limit})), {back}) end"
    o = overlap
    ahead = f"case when not {inside.format(f'e - {o}')} then e - {o} when not {inside.format(f'e - {o - 1}')} then e - {o - 1} when not {inside.format(f'e - {o - 2}')} then e - {o - 2} else e - {o - 3} end"
    return f"""b as (select block_id, strlen(body) n, hex(encode(body)) h, list_transform(range(1, len(x)), lambda i: list_sum(list_transform(x[1:i], lambda y: strlen(y) + 1))::bigint) l
      from (select block_id, body, string_split(body, chr(10)) x from {bodies})),
    p as (select block_id, 0 ix, 0::bigint s, e, n from (select block_id, n, {end} e from (select *, 0::bigint s from b))
      union all select block_id, ix, s, {end} e, n from (select p.block_id, p.ix + 1 ix, {ahead.replace('e - ', 'p.e - ')} s, b.n, b.h, b.l from p join b using (block_id) where p.e < p.n))"""
