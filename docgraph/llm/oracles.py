"""SQL that says the same as the mixing and the rules queries, built from the operators' own fixed values."""

from __future__ import annotations

from docgraph.llm import rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mix(passes: int = 4) -> str:
    """Targets by running sums in order of cap over weight; each source's level by running sums in order of size; expected
    copies, their whole part and Pareto ranks by their formulas; then the ranks that fit, one pass each."""
    sql = rf"""
with base as (select source, doc_id, coalesce(doc_id, -(1::bigint << 62)) as id, len({_WORDS})::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496::double as u from documents),
s as (select source, sum(size)::bigint as source_size from base group by source),
k as (select *, row_number() over (order by source nulls last) - 1 as k from s),
w as (select *, ((k % 3) + 1)::double as w, 3 * source_size::double as cap from k),
l as (select *, (sum(source_size) over ())::double as total, coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by cap / w, k rows between current row and unbounded following) as ahead from w),
c as (select *, (total - before) / ahead as level from l),
f as (select *, min((level * w > cap)::int) over (order by cap / w, k rows between unbounded preceding and current row) = 1 as capped from c),
g as (select source, source_size, case when capped then cap else (select level from f where not capped order by cap / w, k limit 1) * w end as target from f),
z as (select b.source, size, any_value(target) as target, count(*) as n, floor(1e6::double / sqrt(size::double))::bigint as x
    from base b join g on b.source is not distinct from g.source where size > 0 group by b.source, size),
y as (select *, (target - (3 * coalesce(sum(n * size) over (partition by source order by size rows between unbounded preceding and 1 preceding), 0))::double)
    / (sum(n * size * x) over (partition by source order by size rows between current row and unbounded following))::double as level from z),
v as (select source, arg_min(level, size) as level from y where level * x <= 3 group by source),
e as (select b.*, source_size, target, case when size > 0 then least(3::double, level * floor(1e6::double / sqrt(size::double))::bigint) else 0 end as expected
    from base b join g on b.source is not distinct from g.source left join v on b.source is not distinct from v.source),
r as (select *, floor(expected) as whole, expected - floor(expected) as p from e),
x0 as (select *, (u / (1 - u)) / nullif(p / (1 - p), 0) as odds, false as again, -1::double as last, target - sum(whole * size) over (partition by source) as gap from r)"""
    for i in range(passes):
        sql += f""",
n{i} as (select *, odds is not null and size between 1 and gap and not again and odds > last as free from x{i}),
a{i} as (select *, free and sum(size) over (partition by source, free order by odds, id, size) <= gap as added from n{i}),
x{i + 1} as (select * exclude (free, added) replace (again or added as again, greatest(last, max(odds) filter (added) over (partition by source)) as last,
    gap - coalesce(sum(size) filter (added) over (partition by source), 0) as gap) from a{i})"""
    return sql + f"\nselect doc_id, size, source_size, target, (size * (whole + again::int))::bigint as taken from x{passes}"


def line_rules(loses_at_most: float = 0.3) -> str:
    q = lambda s: s.replace("'", "''")
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, count(distinct i + j) as n from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri), (values (0), (1), (2)) as o(j) where c > 1 group by doc_id),
ln as (select doc_id, line, length(line) as size, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
v as (select *, len(ws) as n,
    not regexp_matches(line, '{q(rules.TERMINAL)}') and len(ws) < 10 or regexp_matches(line, '{q(rules.NAVIGATION)}') or regexp_matches(line, '{q(rules.BOILERPLATE)}')
    or regexp_matches(line, '{rules.SYMBOL}') and len(regexp_extract_all(line, '{rules.SYMBOL}')) * 10 >= len(ws)
    or not regexp_matches(line, '\p{{Ll}}') and regexp_matches(line, '\p{{Lu}}') and len(ws) >= 4
    or len(ws) >= 8 and len(list_distinct(ws)) * 3 <= len(ws)
    or len(list_filter(range(1, len(ws) - 3), lambda i: ws[i] = ws[i + 1] and ws[i] = ws[i + 2] and ws[i] = ws[i + 3] and ws[i] = ws[i + 4])) > 0 as bad from ln),
s as (select doc_id, count(*) - count(distinct line) as dup, sum(size) as size, coalesce(sum(size) filter (bad), 0) as lost from v group by doc_id),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '{rules.SYMBOL}'))::bigint as n_symbols,
    coalesce(dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(size, 0) as size, coalesce(lost, 0) as lost from d left join s using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= size * {loses_at_most}::double as kept from b"""


def kmeans(k: int = 40, dim: int = 64, rounds: int = 5) -> str:
    """Every vector against every centre, round after round."""
    steps = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
where len(embedding) = {dim} and list_count(embedding) = {dim} and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
long as materialized (select vec_id, unnest(range(1, {dim + 1})) as i, unnest(v) as x from kept),
c0 as materialized (select c, unnest(range(1, {dim + 1})) as i, unnest(v) as x from (select v, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from kept qualify c < {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (select vec_id, c, sum((l.x - m.x) * (l.x - m.x))::bigint as d from long l join c{r} m using (i) group by vec_id, c),
a{r} as materialized (select vec_id, c, d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select m.c, m.i, coalesce(n.x, m.x) as x from c{r} m left join
(select c, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as x from a{r} join long using (vec_id) group by c, i) n using (c, i))""")
    return f"""with {", ".join(steps)},
h as (select c, sha256(string_agg(x::bigint::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{rounds} join h using (c)"""


def filter_audit() -> str:
    """Every order and step over the counts of every combination of failures."""
    hit = lambda f, mask: f"(fails & {mask}) = 0 and (fails & {f}) > 0"
    return f"""with w as (select *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
m as (select coalesce(source, '') as part, quality, toxic, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
  + case when 100 * len(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) > 2 * length(coalesce(text, '')) then 4 else 0 end
  + case when regexp_matches(coalesce(text, ''), '[#$%&*|]') then 8 else 0 end + case when doc_id > first then 16 else 0 end as fails from w left join labels using (doc_id)),
g as (select part, fails, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as bad from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
o as (select row_number() over () as o, a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31),
s as (select filter_order, unnest(range(1, 6)) as step, bits from o),
e as (select filter_order, step, bits[step] as f, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from s),
r as (select part, filter_order, step, f, coalesce(sum(n) filter ((fails & (before | f)) = 0), 0)::bigint as kept, coalesce(sum(n) filter ({hit("f", "before")}), 0)::bigint as removed,
  coalesce(sum(n) filter ((fails & f) > 0 and (fails & before) > 0), 0)::bigint as redundant, coalesce(sum(n) filter (fails = f), 0)::bigint as unique_fails,
  coalesce(sum(good) filter ({hit("f", "before")}), 0)::bigint as good_lost, coalesce(sum(bad) filter ({hit("f", "before")}), 0)::bigint as toxic_lost
  from g cross join e group by part, filter_order, step, f)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r"""


def near_duplicates() -> str:
    """Exact sets, every pair that shares a shingle, and the closure of the links."""
    return """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
k as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as materialized (select a, b from k union all select b, a from k),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as least from r group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id, coalesce(c.least, d.doc_id) >= d.doc_id as kept
from documents d left join n using (doc_id) left join c using (doc_id)"""
