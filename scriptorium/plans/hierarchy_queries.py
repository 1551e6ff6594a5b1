"""Queries over parent-child rows and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import hierarchy
from scriptorium.sources.tables import table


def p4_found(spark, d):
    return hierarchy.lost_nodes(table(spark, d, "concepts"))


def p4_nested_sets(spark, d):
    return hierarchy.nested_sets(table(spark, d, "concepts"))


def p4_descendants(spark, d):
    """Descendants of every concept whose number is divisible by 20, against all concepts."""
    ranges = hierarchy.cut(hierarchy.nested_sets(table(spark, d, "concepts")))
    asked = ranges.filter(F.expr("try_cast(substr(concept_id, 2) as bigint) % 20 = 0")).select("concept_id")
    return hierarchy.descendants_of(ranges, asked)


QUERIES = {f.__name__: f for f in (p4_found, p4_nested_sets, p4_descendants)}

_NODES = """with recursive k as (select lower(regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as id,
   nullif(lower(regexp_replace(parent, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '') as parent, updated_at from concepts),
 n as (select id, parent from (select *, row_number() over (partition by id order by updated_at desc, parent desc nulls last) as r
   from k where id <> '') where r = 1),
"""
_TREE = _NODES + """ t as (select n.id, n.id as root, 0 as depth, n.id as path from n left join n p on n.parent = p.id where p.id is null
   union all select n.id, t.root, t.depth + 1, t.path || '/' || n.id from t join n on n.parent = t.id),
 pairs as (select a.id as ancestor_id, b.id as concept_id from t a join t b on starts_with(b.path, a.path || '/'))
"""

SQL = {
    "p4_found": _NODES + """ up as (select id, parent as up_to, 1 as steps from n where parent is not null
   union all select up.id, n.parent, up.steps + 1 from up join n on n.id = up.up_to where n.parent is not null and up.up_to <> up.id and up.steps < 400),
 loops as (select distinct id from up where up_to = id),
 ends as (select up.id, max(case when n.id is null then 1 else 0 end) as missing, max(case when n.id is not null and n.parent is null then 1 else 0 end) as top
   from up left join n on n.id = up.up_to group by up.id)
 select e.id as concept_id, case when l.id is not null then 'cycle' when missing = 1 then 'orphan' else 'below_cycle' end as state
 from ends e left join loops l on l.id = e.id where l.id is not null or top = 0""",
    "p4_nested_sets": _TREE + """, size as (select ancestor_id, count(*) as below from pairs group by 1),
 s as (select t.*, coalesce(below, 0) as below from t left join size on t.id = ancestor_id),
 o as (select *, row_number() over (order by depth) as x from s),
 sib as (select s.id, s.path, case when p.id is null then 0 else 1 end + coalesce(sum(s.below + 1) over (partition by p.id order by s.id
   rows between unbounded preceding and 1 preceding), 0) as shift from s left join n on s.id = n.id left join n p on n.parent = p.id),
 lft as (select b.id, sum(a.shift) as lft from sib b join sib a on a.id = b.id or starts_with(b.path, a.path || '/') group by b.id)
 select s.id as concept_id, root, cast(depth as bigint) as depth, path, below as descendants, cast(lft as bigint) as lft, cast(lft + below as bigint) as rgt
 from s join lft on s.id = lft.id""",
    "p4_descendants": _TREE + "select ancestor_id, concept_id from pairs where try_cast(substr(ancestor_id, 2) as bigint) % 20 = 0",
}
