"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, {_SPACE}) as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') as g from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * shared >= 85 * (x.n + y.n - shared)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""

KNN_JOIN = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings),
p as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::bigint as score from v q, v d where q.vec_id % 50 = 0 and d.vec_id <> q.vec_id)
select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""

SUBSTRING_DEDUP = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) as w from documents),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 35), ' ')) as g from (select doc_id, w, unnest(range(len(w) - 34)) as i from w where len(w) >= 35)),
t as (select g from g group by g having count(*) > 1),
gone as (select distinct doc_id, i + k as i from (select g.doc_id, g.i, unnest(range(35)) as k from g join t on t.g = g.g)),
each as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from w),
kept as (select each.doc_id, string_agg(word, ' ' order by each.i) as text, count(*) as n from each left join gone on gone.doc_id = each.doc_id and gone.i = each.i where gone.i is null group by each.doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id
"""

CONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOW}, {_ALNUM}) as w from documents), b as (select item_id, regexp_extract_all({_LOW}, {_ALNUM}) as w from benchmark),
g as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, s + 1, s + 10), ' ') as g from (select item_id, w, unnest(range(greatest(1, len(w) - 9))) as s from b where len(w) > 0)),
p as (select doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') as g from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as s from d, (select distinct n from g) k where len(w) >= n)),
h as (select p.doc_id, p.s, p.n, g.item_id from p join g on g.n = p.n and g.g = p.g),
c as (select doc_id, count(*) as n_hit from (select distinct doc_id, s + k as s from (select doc_id, s, unnest(range(n)) as k from h)) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id),
o as (select item_id, lower(word) as term, row_number() over (partition by item_id order by place) - 1 as off from (select item_id, word, min(place) as place from (select item_id, unnest(w) as word, unnest(range(len(w))) as place from b) group by item_id, word)),
t as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from (select doc_id, list_transform(w, lambda x: lower(x)) as w from d)),
k as (select term, count(*) as n from t group by term),
r as (select *, count(*) over (partition by item_id) as needed from (select o.*, coalesce(n, 0) as n, row_number() over (partition by item_id order by coalesce(n, 0), off) as nth from o left join k on k.term = o.term) where nth <= 3),
a as (select doc_id, item_id, pos, off, needed from t join r on r.term = t.term where item_id not in (select item_id from r where n = 0)),
m as (select doc_id, count(distinct item_id) as n_near from (select x.doc_id, x.item_id, x.pos from a x join a y on y.doc_id = x.doc_id and y.item_id = x.item_id and y.pos between x.pos and x.pos + 29 group by x.doc_id, x.item_id, x.pos having count(distinct y.off) = any_value(x.needed)) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join c on c.doc_id = d.doc_id left join i on i.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


def sort_means_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Plain k-means: every distance of every round."""
    def nearest(r):
        return f"a{r} as materialized (select i, c, d from (select v.i, c{r}.c, list_sum(list_transform(list_zip(v.v, c{r}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d, row_number() over (partition by v.i order by d, c) as nth from v, c{r}) where nth = 1)"

    def moved(r):
        each = f"select a.c, e.dim, sum(e.x)::bigint as s, count(*) as n from a{r} a join e on e.i = a.i group by a.c, e.dim"
        return f"c{r + 1} as materialized (select o.c, coalesce(m.m, o.m) as m from c{r} o left join (select c, list((s - ((s % n) + n) % n) // n order by dim) as m from ({each}) group by c) m on m.c = o.c)"

    steps = ", ".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))
    return f"""
with v as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width}),
e as materialized (select i, unnest(v) as x, unnest(range({width})) as dim from v),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, v as m from v order by sha256('{seed}:' || vec_id) limit {k}),
{steps}, {nearest(rounds)},
t as (select c, sum(d)::bigint as w from a{rounds} group by c)
select v.vec_id, a.c::integer as cluster, a.d as distance, t.w as cluster_inertia, (select sum(w) from t)::bigint as inertia, sha256(array_to_string(o.m, ',')) as centroid_sha256
from v join a{rounds} a on a.i = v.i join t on t.c = a.c join c{rounds} o on o.c = a.c
"""


SORT_MEANS = sort_means_sql()

COSINE_DUPLICATES = """
with recursive v as materialized (select vec_id, embedding::double[] as v from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.9),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
c as (select a as vec_id, min(b) as component_id from r group by a), n as (select a as vec_id, count(*) as n from e group by a)
select d.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, d.vec_id = c.component_id as kept from embeddings d left join n on n.vec_id = d.vec_id left join c on c.vec_id = d.vec_id
"""
