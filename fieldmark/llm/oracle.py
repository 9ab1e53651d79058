"""SQL, for DuckDB on the same tables, of the operators that SQL can express."""

from __future__ import annotations

from .mixing import _CLASS, _LAST, _PARTS
from .sharding import _BUCKETS
from .url_rules import CONFIDENCE, DEFAULT, RULES, SUPPORT

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_SQL9 = (
    "with d as (select doc_id, "
    + _WORDS.format(text="coalesce(text, '')")
    + """ as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1)))::bigint as i from d),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from p),
m as (select k, min(doc_id) as first from g group by k),
f as (select g.doc_id, g.i from g join m using (k) where m.first < g.doc_id),
c as (select distinct doc_id, unnest(range(i, i + 13)) as j from f),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d),
k as (select u.doc_id, count(*) filter (c.j is not null) as n_removed, string_agg(u.word, ' ' order by u.j) filter (c.j is null) as kept from u left join c on u.doc_id = c.doc_id and u.j = c.j group by u.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (doc_id)"""
)

_SQL7 = (
    "with recursive d as (select doc_id, "
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ as w from documents),
s as (select distinct doc_id, k from (select doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3))::bigint as i from d where len(w) >= 5)
 union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
pairs as (select a, b from e union all select b, a from e),
r(id, seen) as (select doc_id, doc_id from d union select r.id, pairs.b from r join pairs on r.seen = pairs.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, t.component_id from d left join n using (doc_id) join (select id, min(seen) as component_id from r group by id) t on t.id = d.doc_id"""
)

_SQL6 = rf"""with d as (select doc_id, case when source is null then '1' else '0' || source end as s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
t as (select s, sum(size)::bigint as ss, ([5.0::double, 2.0::double, 1.0::double])[((row_number() over (order by s) - 1) % 3 + 1)::int] as w from d group by s),
b as (select *, ss * 3 as cap, coalesce(sum(ss * 3) over o, 0)::bigint as caps, coalesce(sum(w) over o, 0.0) as used, (sum(ss) over ())::bigint as total, sum(w) over () as weights from t window o as (order by (ss * 3)::double / w, s rows between unbounded preceding and 1 preceding)),
l as (select *, (total - caps)::double / (weights - used) as level from b),
f as (select *, level * w >= cap as full_ from l),
g as (select s, ss, case when full_ then cap::double else (select min_by(level, (cap::double / w, s)) from f where not full_) * w end as target from f),
r as (select d.*, ss, target, case when ss > 0 then target / ss else 0.0 end as rate, row_number() over (partition by s order by least(size // {_CLASS}, {_LAST}), ('0x' || substr(md5(coalesce(doc_id, 0) || ':' || size), 1, 4))::bigint % {_PARTS}, size, doc_id) - 1 as k,
 ('0x' || substr(md5('1:' || s), 1, 8))::bigint::double / 4294967296.0::double as u from d join g using (s))
select doc_id, size, ss as source_size, target, (size * (floor((k + 1) * rate + u) - floor(k * rate + u)))::bigint as taken from r"""


def _score(shard: int) -> str:
    return f"{{'v': 1.0::double / -ln((('0x' || substr(md5(key || ':{shard}'), 1, 13))::bigint + 0.5) / 4503599627370496.0::double), 's': {shard}}}"


#: The CRC of each text runs over its bytes with a table that the polynomial gives.
_CRC = """with t as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, u: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i))"""


def _shards(n: int) -> str:
    return f"list_max([{', '.join(_score(s) for s in range(n))}]).s"


_SQL10 = f"""{_CRC},
b as (select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, '') as key from documents),
h as (select *, hex(encode(text)) as x from b),
c as (select h.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda a, v: xor(a >> 8, t.t[(xor(a, v) & 255) + 1])), 4294967295::bigint) as crc from h, t),
s as (select doc_id, (length(x) // 2 + 1)::bigint as size, crc as text_crc32, {_shards(8)} as shard, {_shards(9)} as grown_shard from c)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || size || ':' || text_crc32), 1, 6))::bigint % {_BUCKETS}, doc_id, size, text_crc32) - 1 as slot, grown_shard from s"""

#: Squared distance of a part to an entry, and a list's componentwise floor(sum / count).
_DISTANCE = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: ((p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))::hugeint))"


def _assigned(k: int) -> str:
    return f"a{k} as materialized (select p.vec_id, p.part, p.x, min(struct_pack(d := {_DISTANCE}, e := c.e)) as m from p join c{k} c on c.part = p.part group by all)"


def _moved(k: int) -> str:
    return f"""u{k} as (select part, m.e as e, i, sum(x[i])::hugeint as s, count(*) as n from (select part, m, x, unnest(range(1, len(x) + 1)) as i from a{k}) group by all),
w{k} as (select part, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from u{k} group by all),
c{k + 1} as materialized (select c.part, c.e, coalesce(w.x, c.x) as x from c{k} c left join w{k} w on w.part = c.part and w.e = c.e)"""


_SQL11 = f"""with k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] as x from (select vec_id, v, unnest(range(8)) as part from k)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as e, x from p qualify row_number() over (partition by part order by vec_id) <= 16),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(6))}, {_assigned(6)},
r as (select vec_id, string_agg(printf('%02x', m.e), '' order by part) as code, sum(m.d)::bigint as error from a6 group by 1),
b as (select sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' order by part, e)) as h from c6)
select k.vec_id, r.code, r.error, (sum(r.error) over (partition by k.label))::bigint as label_error, b.h as codebooks_sha256 from k join r using (vec_id), b"""

_FIT = "(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{rest}')"


def _listed(column: int) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    return "case " + " ".join(f"when {_FIT.format(own=r[0].split('/')[0], rest=r[0].split('/', 1)[1])} then '{r[column]}'" for r in longest) + " end"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tokens(kind: str, values: str) -> str:
    return f"list_transform(list_filter({values}, lambda x: x <> ''), lambda x: '{kind}:' || x)"


#: All combinations of each token set's frequent tokens are counted, without pruning.
_SQL13 = f"""with u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
h as (select page_id, url, case when pos > 0 then substr(url, pos + 3) else '' end as rest, case when pos > 0 then substr(url, 1, pos - 1) else '' end as scheme from u),
b as (select page_id, scheme, {_lower("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path, {_lower("regexp_extract(rest, '(?s)^[^?#]*[?]([^#]*)', 1)")} as query, instr(rest, '#') > 0 as fragment from h),
r as (select *, {_listed(0)} as rule, {_listed(1)} as said, list_sort(list_distinct(list_concat({_tokens("scheme", "[" + _lower("scheme") + "]")}, {_tokens("host", "string_split(host, '.')")},
 {_tokens("word", "list_filter(string_split(replace(host, '-', '.'), '.'), lambda x: instr(host, '-') > 0)")}, {_tokens("path", f"string_split(regexp_replace({_lower('path')}, '[0-9]+', '#', 'g'), '/')")},
 {_tokens("query", "list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1])")}, case when fragment then ['fragment:'] else [] end))) as tokens from b),
l as (select ceil({SUPPORT} * count(*)) as need from r where rule is not null),
f as (select token from (select unnest(tokens) as token from r where rule is not null) group by 1 having count(*) >= (select need from l)),
s as materialized (select tokens, coalesce(list(token order by token) filter (token in (select token from f)), []) as held from (select tokens, unnest(tokens) as token from (select distinct tokens from r)) group by 1),
t as (select held, said, count(*) as n from r join s using (tokens) where rule is not null group by all),
c as (select list_filter(held, lambda x, i: (m >> (i - 1)) & 1 = 1) as part, said, n from (select held, said, n, unnest(range(1, 1 << len(held))) as m from t)),
g as (select part, said, sum(n) as n, sum(sum(n)) over (partition by part) as total from c group by part, said),
a as materialized (select part, said, n, n::double / total::double as confidence from g where n >= (select need from l) and n::double / total::double >= {CONFIDENCE}),
o as (select held, list_filter(held, lambda x, i: (m >> (i - 1)) & 1 = 1) as part from (select held, unnest(range(1, 1 << len(held))) as m from (select distinct held from r join s using (tokens) where rule is null))),
v as (select o.held, max(struct_pack(confidence := a.confidence, n := a.n, said := a.said)).said as mined from o join a using (part) group by 1)
select r.page_id, r.host, r.path, r.rule, coalesce(r.said, v.mined, '{DEFAULT}') as verdict from r left join s using (tokens) left join v using (held)"""

SQL = {"op6_mixing": _SQL6, "op7_ngram_join": _SQL7, "op9_substring_dedup": _SQL9, "op10_sharding": _SQL10, "op11_vector_codes": _SQL11, "op13_url_rules": _SQL13}
