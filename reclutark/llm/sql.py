"""Checking SQL of the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping

PREFERENCE = """
with told as (
  select conv_id as pair_id, turn, role, text from conversations where conv_id is not null),
ranked as (
  select pair_id, turn, coalesce(text, '') as text,
         row_number() over (partition by pair_id order by turn desc, coalesce(text, '') desc) as k
  from told where role = 'assistant' and turn is not null),
reply as (select pair_id, turn, text from ranked where k = 1),
rejected as (
  select t.* from told t left join reply r using (pair_id)
  where r.turn is null or t.turn is null or t.turn < r.turn
  union all
  select r.pair_id, r.turn, 'assistant', o.text from reply r join reply o on o.pair_id = xor(r.pair_id, 1)),
sides as (
  select distinct side, pair_id, coalesce(turn, -4611686018427387904) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from (select 0 as side, * from told union all select 1 as side, * from rejected)),
placed as (select *, row_number() over (partition by side, pair_id, turn order by role, text) as place from sides),
c as (select * from placed where side = 0),
r as (select * from placed where side = 1),
met as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.turn, r.turn) as turn, coalesce(c.place, r.place) as place,
         c.role as c_role, c.text as c_text, r.role as r_role, r.text as r_text,
         c.role is distinct from r.role or c.text is distinct from r.text as differs
  from c full join r on c.pair_id = r.pair_id and c.turn = r.turn and c.place = r.place),
marked as (
  select *, coalesce(bool_or(differs) over (partition by pair_id order by turn, place rows between unbounded preceding and current row), false) as apart
  from met),
rows_of as (
  select pair_id, 'prompt' as part, turn, place, c_role as role, c_text as text from marked where not apart
  union all
  select pair_id, 'chosen', turn, place, c_role, c_text from marked where apart and c_role is not null
  union all
  select pair_id, 'rejected', turn, place, r_role, r_text from marked where apart and r_role is not null)
select pair_id, part, turn, cast(place as integer) as place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as segment,
       cast(case when part <> 'prompt' and role = 'assistant' then length(role) + 5 end as integer) as learnt_from,
       cast(case when part <> 'prompt' and role = 'assistant' then length(role) + 5 + length(text) + 8 end as integer) as learnt_to
from rows_of
"""


def mixing(domains: tuple[str, ...], weights: Mapping[str, Mapping[str, int]], tenths: int = 8, epochs: int = 4, seed: int = 3) -> str:
    """Leaf budgets level by level, then running sums along the seeded order of each leaf's next epoch."""
    tree = ["domain", "lang", "source"]
    named = " ".join(f"when {i} then '{d}'" for i, d in enumerate(domains))
    parts = [f"""
with docs as (
  select doc_id, case coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint), 0) % {len(domains)} {named} end as domain,
         lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens from docs group by all)"""]
    for k, level in enumerate(tree):
        path, over = ", ".join(tree[: k + 1]), ", ".join(["1", *tree[:k]])
        cases = " ".join(f"when {level} = '{name}' then {w}" for name, w in weights.get(level, {}).items())
        weight = f"case {cases} else 1 end" if cases else "1"
        parent = (
            f"least((sum(sum(tokens)) over ()) * {tenths} // 10, (sum(sum(tokens)) over ()) * {epochs})" if not k else
            f"(select a.budget from b{k - 1} a where " + " and ".join(f"a.{c} is not distinct from leaves.{c}" for c in tree[:k]) + ")"
        )
        order = f"partition by {over} order by cast(capacity as double) / weight, {level} nulls first"
        parts.append(f"""
n{k} as (
  select {path}, cast(sum(tokens) * {epochs} as hugeint) as capacity, {weight} as weight, cast({parent} as hugeint) as parent
  from leaves group by {path}),
r{k} as (
  select *, coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0) as below,
         sum(weight) over ({order} rows between current row and unbounded following) as from_here
  from n{k} where weight > 0),
f{k} as (select *, capacity * from_here <= (parent - below) * weight as is_full from r{k}),
s{k} as (
  select *, parent - coalesce(sum(capacity) filter (is_full) over (partition by {over}), 0) as rest,
         sum(weight) filter (not is_full) over (partition by {over}) as open_weight
  from f{k}),
g{k} as (select *, case when not is_full then cast(rest * weight as hugeint) // cast(open_weight as hugeint) end as fair from s{k}),
b{k} as (
  select {path}, cast(case when is_full then capacity else fair + cast(
           row_number() over (partition by {over} order by is_full, {level} nulls first) <= rest - sum(fair) over (partition by {over}) as integer) end as bigint) as budget
  from g{k})""")
    parts.append(f"""
shares as (
  select l.*, coalesce(b.budget, 0) as budget, case when tokens > 0 then coalesce(b.budget, 0) // tokens else 0 end as epochs,
         case when tokens > 0 then coalesce(b.budget, 0) % tokens else 0 end as rest
  from leaves l left join b2 b on l.domain is not distinct from b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
placed as (
  select d.*, s.epochs, s.rest, cast('0x' || substr(md5('{seed}|' || s.epochs || '|' || coalesce(cast(d.doc_id as varchar), '')), 1, 15) as bigint) as place
  from docs d join shares s
    on d.domain is not distinct from s.domain and d.lang is not distinct from s.lang and d.source is not distinct from s.source),
sums as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by place, doc_id nulls first, n_tokens
                                rows between unbounded preceding and current row) as sum_tokens
  from placed)
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, epoch from (
  select doc_id, domain, lang, source, n_tokens, cast(unnest(range(epochs)) as bigint) as epoch from placed
  union all
  select doc_id, domain, lang, source, n_tokens, cast(epochs as bigint) from sums where rest > 0 and sum_tokens <= rest)
""")
    return ",".join(parts[:-1]) + "," + parts[-1]

#: A path is the string of its turns' digests, 32 characters each; ancestors of a path are its beginnings.
PREFIX_TRIE = r"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), turns as (
  select conv_id, turn, md5(concat(length(role), ':', role, text)) as t,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
  from told
), own as (
  select *, row_number() over (partition by conv_id order by turn nulls first, t) as pos from turns
), convs as (
  select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))
  ), 4294967295) % 4 as h
  from (select distinct conv_id from own)
), rebuilt as (
  select c.conv_id, o.pos, o.t, o.words from convs c join own o on o.conv_id = c.base and o.pos <= c.h
  union all
  select c.conv_id, o.pos + 1000000, o.t, o.words from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h
), paths as (
  select conv_id, row_number() over w as depth, string_agg(t, '') over w as path, words, count(*) over (partition by conv_id) as n
  from rebuilt window w as (partition by conv_id order by pos)
  union all
  select c.conv_id, 0, '', 0, (select count(*) from rebuilt r where r.conv_id = c.conv_id) from convs c
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(words) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256
  from paths group by path, depth
), families as (
  select p.conv_id, p.depth, count(k.path) as n_children
  from nodes p left join nodes k on k.depth = p.depth + 1 and left(k.path, 32 * p.depth) = p.path group by all
), above as (
  select left(path, 32 * unnest(range(depth + 1))) as path, saved, n_children
  from nodes join families using (conv_id, depth)
), below as (
  select path, count_if(n_children = 0) as n_leaves, sum(saved) as saved_tokens from above group by path
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, f.n_children, b.n_leaves::bigint as n_leaves,
  b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join families f using (conv_id, depth) join below b using (path)
left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, 32 * (n.depth - 1)) and n.depth > 0
"""
