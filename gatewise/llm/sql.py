"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

from gatewise.llm import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def secret_ledger() -> str:
    """Places follow from the lengths of matches and of what stands between them."""
    rules = (
        ("assign", secrets.ASSIGN, 2, secrets.MIN_ASSIGN), ("access", secrets.ACCESS, 0, secrets.MIN_ACCESS),
        ("hex", secrets.HEX, 0, secrets.MIN_HEX))
    parts = " union all ".join(
        f"""select doc_id, {k} as k, '{kind}' as kind, regexp_split_to_array(t, {_quoted(p)}) as gaps,
  regexp_extract_all(t, {_quoted(p)}, 0) as found, regexp_extract_all(t, {_quoted(p)}, {g}) as tested, {least} as least from d"""
        for k, (kind, p, g, least) in enumerate(rules))
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({parts}),
i as (select *, unnest(range(1, len(found) + 1)) as i from m where len(found) > 0),
p as (select doc_id, k, kind, found[i] as f,
  cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as s
  from i where length(tested[i]) >= least),
a as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
  count(*) filter (where k = 2) as n_hex, string_agg(kind || ':' || s || ':' || (s + length(f)), ',' order by s, k) as spans from p group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
 sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


def contamination() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""with dw as (select doc_id, regexp_extract_all({_lowered('text')}, '{words}') as w from documents),
bw as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_lowered('text')}, '{words}') as w from benchmark),
bs as (select item, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from bw where len(w) > 0),
win as (select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as x from bs),
dp as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from win) where len(w) >= size),
hit as (select doc_id, i, dp.size, item from dp join win on win.size = dp.size and win.x = array_to_string(w[i:i + dp.size - 1], ' ')),
n as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + size)) as place from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join n using (doc_id) left join it using (doc_id)"""


def jaccard() -> str:
    words = r"[^\x20\x09-\x0D]+"
    return f"""with recursive dw as (select doc_id, regexp_extract_all({_lowered('text')}, '{words}') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from dw where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from sh a join sh b using (s) where a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
reach(doc_id, c) as (select doc_id, doc_id from dw union select b, c from reach join link on a = reach.doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select doc_id, min(c) as component_id from reach group by doc_id) left join n using (doc_id)"""


def near_vectors() -> str:
    """All pairs, exactly; the tables compared this way hold a few hundred vectors."""
    return """with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings),
ok as (select * from v where len(x) > 0 and len(list_filter(x, lambda c: c is null or isnan(c) or isinf(c))) = 0 and list_max(list_transform(x, lambda c: abs(c))) > 0),
link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.9),
reach(vec_id, c) as (select vec_id, vec_id from v union select b, c from reach join link on a = reach.vec_id),
comp as (select vec_id, min(c) as component_id from reach group by vec_id),
n as (select a as vec_id, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from comp left join n using (vec_id)"""


def repeats() -> str:
    """Bytes as pairs of hex digits; a window is removed if it is not the first of its kind."""
    return """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, s, md5(substring(h, cast(2 * s + 1 as bigint), 200)) as k
  from (select doc_id, h, unnest(range(0, cast(length(h) / 2 as bigint) - 99)) as s from d)),
gone as (select doc_id, s from (select *, row_number() over (partition by k order by doc_id, s) as place from w) where place > 1),
runs as (select *, sum(opens) over (partition by doc_id order by s) as run from (
  select *, case when s - lag(s) over (partition by doc_id order by s) <= 100 then 0 else 1 end as opens from gone)),
spans as (select doc_id, min(s) as b, max(s) + 100 as e from runs group by doc_id, run),
cut as (select *, coalesce(lag(e) over (partition by doc_id order by b), 0) as prior from spans),
kept as (select doc_id, count(*) as n, cast(sum(e - b) as bigint) as gone, max(e) as last,
  string_agg(substring(h, cast(2 * prior + 1 as bigint), cast(2 * (b - prior) as bigint)), '' order by b) as head
  from cut join d using (doc_id) group by doc_id)
select doc_id, cast(length(h) / 2 as bigint) as n_bytes, coalesce(gone, 0) as n_removed, coalesce(n, 0) as n_spans,
 sha256(unhex(coalesce(head, '') || substring(h, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from d left join kept using (doc_id)"""


def _field(column: str) -> str:
    text = f"cast({column} as varchar)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _crc32(text: str) -> str:
    """CRC-32 by its definition, a byte and a bit at a time; ``text`` is ASCII."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def manifest() -> str:
    """Trees level by level; proofs by folding leaves with the other nodes of their runs."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    plain = " || ".join(map(_field, fields))
    cut = " || ".join(map(_field, (*fields[:-1], "shown")))
    return f"""with recursive d as (select *, case when {_crc32("cast(doc_id as varchar)")} % 2 = 0 then replace(text, chr(10), '') else text end as shown from documents),
p as (select doc_id, source, sha256({plain}) as leaf, sha256({cut}) as folded from d),
s as (select source, row_number() over (order by source nulls first) - 1 as tree, count(*) over () as trees from (select distinct source from documents)),
l as (select p.*, s.tree, s.trees, row_number() over () as row, row_number() over (partition by s.tree order by doc_id nulls first, leaf) - 1 as pos,
  count(*) over (partition by s.tree) as n from p join s on p.source is not distinct from s.source),
nodes as (select tree, 0 as level, pos, leaf as h, n from l
  union all select tree, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from nodes where n > 1 group by tree, level, pos // 3, n),
sub as (select tree, h as subroot from nodes where n = 1),
top as (select 0 as level, tree as pos, subroot as h, (select count(*) from sub) as n from sub
  union all select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from top where n > 1 group by level, pos // 3, n),
run as (select tree, level, pos // 3 as parent, list(h order by pos) as hs from nodes where n > 1 group by tree, level, pos // 3
  union all select -1, level, pos // 3, list(h order by pos) from top where n > 1 group by level, pos // 3),
f as (select row, tree, 0 as level, pos, folded as h, '' as seen from l
  union all select row, f.tree, f.level + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3], '') || f.h || array_to_string(hs[pos % 3 + 2:], '')),
    seen || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  from f join run on run.tree = f.tree and run.level = f.level and run.parent = pos // 3),
own as (select row, tree, arg_max(h, level) as h, arg_max(seen, level) as seen from f group by row, tree),
g as (select row, 0 as level, tree as pos, h, seen from own
  union all select row, g.level + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3], '') || g.h || array_to_string(hs[pos % 3 + 2:], '')),
    seen || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  from g join run on run.tree = -1 and run.level = g.level and run.parent = pos // 3),
whole as (select row, arg_max(h, level) as h, arg_max(seen, level) as seen from g group by row),
r as (select h as root from top where n = 1)
select doc_id, leaf, subroot, root, sha256(seen) as proof_sha256, h as folded_root, h = root as verified
from l join sub using (tree) join whole using (row), r"""


def negatives() -> str:
    """All anchors against all rows."""
    return """with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x,
  case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from embeddings
  where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
  coalesce(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])), 0) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select distinct anchor_id, id, score from
  (select *, dense_rank() over (partition by anchor_id order by score desc, id) as place from s where same) where place <= 5),
n as (select distinct p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
  dense_rank() over (partition by p.anchor_id, p.id, p.score order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, cast(positive_score as bigint) as positive_score,
 cast(negative_score as bigint) as negative_score from n where rank <= 10"""
