"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(column: str) -> str:
    return f"translate({column}, '{_ABC}', '{_ABC.lower()}')"


#: The table of the byte-wise crc32, made by its rule.
_TABLE = """
crc_table as (select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)))"""


def _crc(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; t is the table."""
    data = f"hex(encode({text}))"
    each = f"list_transform(range(0, length({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {each}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_TABLE = _TABLE.replace("(c, x) ->", "lambda c, x:")

#: n_features, weights, scores and the draw, from hashed words and word pairs.
RESAMPLE = f"""
with {_TABLE.strip()},
texts as (
    select 0 as kind, doc_id as id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
    union all select 1, item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
found as (select kind, id, unnest(w || list_transform(range(1, length(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from texts),
hashed as (select f, {_crc("f")} % 10000 as bucket from (select distinct f from found), crc_table),
counts as (
    select b as bucket, count(f.kind) filter (f.kind = 0) as s, count(f.kind) filter (f.kind = 1) as t
    from range(10000) r(b) left join (select kind, bucket from found join hashed using (f)) f on f.bucket = b group by b),
gains as (select bucket, floor(1000 * ln((t + 1.0::double) * (sum(s) over () + 10000)::double / ((s + 1.0::double) * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
sums as (select id, count(*) as n, sum(gain)::bigint as g from found join hashed using (f) join gains using (bucket) where kind = 0 group by id),
weighed as (select doc_id, coalesce(n, 0) as n_features, coalesce(floor(g::double / n), 0)::bigint as weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h from documents left join sums on id = doc_id),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 39)
select doc_id, n_features, weight, score, case when place <= n * 25 // 100 then place end as rank from scored left join placed using (doc_id)
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Leaves, roots and proofs: first the trees of sources, then the one over them; a node is (grp, level, idx).
MANIFEST = f"""
with recursive {_TABLE.strip()},
leaves as (
    select doc_id, source, {_leaf("text")} as leaf, case when {_crc("doc_id::varchar")} % 5 = 0 then {_leaf(_lower("text"))} else {_leaf("text")} end as forged,
        dense_rank() over (order by source nulls first) - 1 as grp, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as width
    from documents, crc_table),
nodes as (
    select grp, 0 as level, idx, leaf as digest, width from leaves
    union all
    select grp, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(width) + 15) // 16 from nodes where width > 1 group by grp, level, idx // 16),
upper as (
    select 0 as level, grp as idx, digest, count(*) over () as width from nodes where width = 1
    union all
    select level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(width) + 15) // 16 from upper where width > 1 group by level, idx // 16),
every as (
    select grp, level, idx, digest, width from nodes where width > 1
    union all select -1, level, idx, digest, width from upper where width > 1),
beside as (
    select a.grp, a.level, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as r
    from every a join every b on a.grp = b.grp and a.level = b.level and a.idx // 16 = b.idx // 16 group by a.grp, a.level, a.idx),
path as (
    select v.grp, v.idx, b.level + 100 * (b.grp = -1)::int as step, l, r from leaves v
    join beside b on (b.grp = v.grp and b.idx = v.idx // (16 ** b.level)::bigint) or (b.grp = -1 and b.idx = v.grp // (16 ** b.level)::bigint)),
proofs as (
    select v.grp, v.idx, v.forged, sha256(coalesce(string_agg(l || r, '' order by step), '')) as proof, list({{'l': l, 'r': r}} order by step) filter (step is not null) as p
    from leaves v left join path p on p.grp = v.grp and p.idx = v.idx group by v.grp, v.idx, v.forged),
folded as (
    select grp, idx, proof, forged as digest, 1 as done, p from proofs
    union all select grp, idx, proof, sha256(p[done].l || digest || p[done].r), done + 1, p from folded where done <= coalesce(len(p), 0)),
top as (select digest as root from upper where width = 1),
sub as (select grp, digest as subroot, level as own from nodes where width = 1)
select doc_id, leaf, subroot, root, proof as proof_sha256, digest as folded_root, digest = root as verified, source, coalesce(len(p), 0)::int as n_levels
from leaves join folded using (grp, idx) join sub using (grp), top where done = coalesce(len(p), 0) + 1
"""
