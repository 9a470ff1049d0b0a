"""Queries over the two general data problems: hierarchies (p2) and orphan references (p4)."""

from __future__ import annotations

from docframe.operators import hierarchy, references
from docframe.plans.sql import blank_trim
from docframe.sources.tables import table


def p2_found(spark, folder):
    return hierarchy.styles_in_circles(table(spark, folder, "style_defs"))


def p2_hierarchy(spark, folder):
    return hierarchy.style_hierarchy(table(spark, folder, "style_defs"))


def p2_descendants(spark, folder):
    return hierarchy.style_descendants(table(spark, folder, "style_defs"))


def _orphans(spark, folder):
    return references.orphans(*(table(spark, folder, t) for t in ("style_defs", "hf_entries", "package_parts")))


def p4_found(spark, folder):
    return _orphans(spark, folder).select("src_table", "owner_key", "item_key", "ref_field", "period")


def p4_report(spark, folder):
    return references.orphan_report(_orphans(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p4_found, p4_report)}

_STYLES = """
now as (
  select template_key, trim(style_id) as id,
    arg_max(struct_pack(b := nullif(trim(based_on), ''), n := nullif(trim("next"), ''), l := nullif(trim(link), ''), d := coalesce(is_deleted, false), t := loaded_at),
      struct_pack(r := coalesce(revision, -2147483648), t := loaded_at, d := coalesce(is_deleted, false), b := coalesce(nullif(trim(based_on), ''), ''))) as c,
    min(loaded_at) as first_loaded
  from style_defs where template_key is not null and trim(coalesce(style_id, '')) <> '' group by all),
alive as (select template_key, id, c.b as b from now where not c.d),
links as (select a.template_key, a.id, p.id as parent from alive a left join alive p on p.template_key = a.template_key and p.id = a.b)"""

_TREE = f"""{_STYLES},
down as (
  select template_key, id, id as root, 0::bigint as depth, [id] as path from links where parent is null
  union all
  select l.template_key, l.id, d.root, d.depth + 1, list_append(d.path, l.id)
  from links l join down d on d.template_key = l.template_key and d.id = l.parent),
pairs as (
  select template_key, path[i::bigint] as style_id, id as descendant_id, depth - i + 1 as distance
  from (select *, unnest(generate_series(1, depth)) as i from down where depth > 0)),
up as (
  select template_key, id, parent as anc from links where parent is not null
  union
  select u.template_key, u.id, l.parent from up u join links l on l.template_key = u.template_key and l.id = u.anc where l.parent is not null),
circle as (select template_key, id from up where id = anc)"""

_ORPHANS = f"""{_STYLES},
refs as (
  select 'style_defs' as src_table, template_key as owner_key, id as item_key, f as ref_field,
    case f when 'based_on' then c.b when 'next' then c.n else c.l end as target, c.t as loaded_at
  from now, (values ('based_on'), ('next'), ('link')) v(f) where not c.d),
entries as (
  select distinct 'hf_entries', file_key, entry_id::varchar, 'part_name',
    nullif(trim(regexp_replace(trim(part_name), '^(\\./|/)', '')), ''), loaded_at from hf_entries where file_key is not null),
parts as (
  select file_key, nullif(trim(regexp_replace(trim(part_name), '^(\\./|/)', '')), '') as target,
    arg_max(coalesce(is_deleted, false), struct_pack(r := coalesce(revision, -2147483648), t := loaded_at, d := coalesce(is_deleted, false))) as gone,
    min(loaded_at) as first_loaded
  from package_parts where file_key is not null group by all),
judged as (
  select r.*, case when p.id is null then 'missing' when p.c.d then 'deleted' when r.loaded_at < p.first_loaded then 'later' end as reason
  from refs r left join now p on p.template_key = r.owner_key and p.id = r.target where r.target is not null
  union all
  select e.*, case when p.file_key is null then 'missing' when p.gone then 'deleted' when e.loaded_at < p.first_loaded then 'later' end
  from entries e left join parts p on p.file_key = e.file_key and p.target = e.column4 where e.column4 is not null),
found as (select *, strftime(loaded_at, '%Y-%m') as period from judged where reason is not null)"""
_ORPHANS = _ORPHANS.replace("select distinct 'hf_entries', file_key, entry_id::varchar, 'part_name',", "select distinct 'hf_entries' as column0, file_key, entry_id::varchar as column2, 'part_name' as column3,").replace(
    "'^(\\./|/)', '')), ''), loaded_at from hf_entries", "'^(\\./|/)', '')), '') as column4, loaded_at from hf_entries"
)

ORACLES = {
    "p2_found": f"with recursive {_TREE} select template_key, id as style_id from circle",
    "p2_hierarchy": f"""with recursive {_TREE},
named as (select c.template_key, c.id, min(u.anc) as root from circle c join up u on u.template_key = c.template_key and u.id = c.id group by c.template_key, c.id),
led as (select u.template_key, u.id, min(n.root) as root from up u join named n on n.template_key = u.template_key and n.id = u.anc group by u.template_key, u.id),
size as (select template_key, style_id, count(*) as n from pairs group by template_key, style_id)
select d.template_key, d.id as style_id, 'tree' as status, root, depth, array_to_string(path, ' > ') as path, coalesce(n, 0) as n_descendants
from down d left join size s on s.template_key = d.template_key and s.style_id = d.id
union all
select l.template_key, l.id, case when c.id is null then 'into_circle' else 'circle' end,
  coalesce(m.root, e.root),
  -1, null, -1
from links l left join circle c on c.template_key = l.template_key and c.id = l.id
left join named m on m.template_key = l.template_key and m.id = l.id
left join led e on e.template_key = l.template_key and e.id = l.id
where not exists (select 1 from down d where d.template_key = l.template_key and d.id = l.id)""",
    "p2_descendants": f"with recursive {_TREE} select template_key, style_id, descendant_id, distance from pairs",
    "p4_found": f"with {_ORPHANS} select src_table, owner_key, item_key, ref_field, period from found",
    "p4_report": f"""with {_ORPHANS} select src_table, ref_field, reason, period, count(*) as n_references, count(distinct owner_key) as n_owners
from found group by all""",
}
ORACLES = {name: blank_trim(sql) for name, sql in ORACLES.items()}
