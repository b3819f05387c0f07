"""SQL twins of the data-processing queries, in the dialect of the checking database.

The nested documents are read by a recursive query of its own over JSON values, which shares nothing with the
shredding operator but the rules of what is an entity.
"""

from __future__ import annotations

_NODES = """
with recursive docs as (
  select ruleset_id, version, row_number() over () k, case when json_type(p) = 'VARCHAR' then case when json_valid(p ->> '$') then (p ->> '$')::json end else p end p
  from (select distinct ruleset_id, version, case when json_valid(payload_json) then payload_json::json end p from ruleset_versions)),
nodes(k, ruleset_id, version, node_path, parent_node, place, kind, state, entity, parent_path, inner_path, value) as (
  select k, ruleset_id, version, '', '', 0::ubigint, json_type(p), 'root', '', '', '', p from docs where json_type(p) in ('OBJECT', 'ARRAY')
  union all
  select k, ruleset_id, version, path, parent_node, id, type, next[1], next[2], inner_path, if(next[2] <> '', path, inner_path), value
  from (
    select n.k, n.ruleset_id, n.version, if(n.node_path = '', c.key, n.node_path || '/' || c.key) path, n.node_path parent_node, c.id, c.type, c.value, n.inner_path,
      case n.state
        when 'root' then if(c.key = 'rules', ['rules', ''], ['data', ''])
        when 'rules' then if(c.type = 'OBJECT' and n.kind = 'ARRAY', ['rule', 'rule'], ['data', ''])
        when 'rule' then case when c.key = 'when' and c.type = 'OBJECT' then member when c.key = 'assign' then ['assigns', ''] else ['data', ''] end
        when 'group' then if(c.key in ('all', 'any') and c.type = 'ARRAY', ['members', ''], ['data', ''])
        when 'members' then if(c.type = 'OBJECT', member, ['data', ''])
        when 'condition' then if(c.key in ('left', 'right'), ['operand', ''], ['data', ''])
        when 'assigns' then case when c.type = 'NULL' then ['data', ''] when n.kind = 'OBJECT' then ['operand', 'assignment'] when c.type = 'OBJECT' then ['assignment', 'assignment'] else ['data', ''] end
        when 'assignment' then if(c.key = 'value', ['operand', ''], ['data', ''])
        when 'operand' then if(c.key = 'custom_function' and c.type = 'OBJECT', ['call', 'call'], ['data', ''])
        when 'call' then if(c.key = 'args', ['args', ''], ['data', ''])
        else case when n.state not in ('args', 'plain') then ['data', '']
                  when c.type = 'OBJECT' then if(list_has_any(json_keys(c.value), ['field', 'assigned', 'literal', 'custom_function']), ['operand', ''], ['plain', ''])
                  when c.type = 'ARRAY' then ['plain', ''] else ['data', ''] end
      end next
    from nodes n, json_each(n.value) c, lateral (select if(c.type = 'OBJECT' and list_has_any(json_keys(c.value), ['all', 'any']), ['group', 'group'], ['condition', 'condition']) member)
    where n.kind in ('OBJECT', 'ARRAY') and n.state <> 'data'))
"""

#: SQL types of attributes by Spark type.
_TYPES = {"string": "varchar", "bigint": "bigint", "boolean": "boolean"}


def entity_sql(entity: str, attributes: dict[str, str]) -> str:
    """The flat table of one entity; a scalar member gives its text, and copies of a version count once."""
    scalars = "('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')"
    picked = [f"""try_cast(max(case when json_type(value, '$."{name}"') in {scalars} then value ->> '$."{name}"' end) as {_TYPES[kind]}) {name}""" for name, kind in attributes.items()]
    return f"""{_NODES},
ranked as (select *, (row_number() over (partition by k, parent_node order by place) - 1)::int ordinal from nodes where node_path <> '')
select ruleset_id, version, node_path, max(parent_path) parent_path, max(ordinal) ordinal, {", ".join(picked)}
from ranked where entity = '{entity}' group by ruleset_id, version, node_path"""


LINKS = f"{_NODES} select distinct ruleset_id, version, entity node_kind, node_path, parent_path from nodes where entity <> ''"

_ORPHANS = f"""{_NODES},
named as (select distinct ruleset_id, version, value ->> '$.name' function_name from nodes where entity = 'call' and json_type(value, '$.name') in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')),
spelled as (select ruleset_id, version, regexp_extract(trim(published_at), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})[T ](\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d{{1,9}})?)?) ?(Z|z|[+-]\\d{{2}}:?\\d{{2}})?$', ['day', 'clock', 'a', 'b', 'zone']) s from ruleset_versions),
instants as (select ruleset_id, version, try_cast(s.day || ' ' || if(len(s.clock) = 5, s.clock || ':00', s.clock) as timestamp)
    - to_minutes(case when s.zone[1] in ('+', '-') then if(s.zone[1] = '+', 1, -1) * (s.zone[2:3]::int * 60 + right(s.zone, 2)::int) else 0 end) as moment from spelled),
published as (select ruleset_id, version, max(moment) moment from instants group by all),
changes as (select distinct change_id, function_name, change_kind, changed_at from registry_changes where function_name is not null and changed_at is not null),
refs as (select n.*, p.moment from named n join published p on p.ruleset_id is not distinct from n.ruleset_id and p.version is not distinct from n.version),
found as (select r.* from refs r where case
    when r.moment is null then not exists (select 1 from function_registry f where f.function_name = r.function_name)
    when exists (select 1 from registry_changes c where c.function_name = r.function_name)
    then coalesce((select arg_max(c.change_kind, (c.changed_at, c.change_id)) from changes c where c.function_name = r.function_name and c.changed_at <= r.moment), '') not in ('registered', 'reactivated')
    else not exists (select 1 from function_registry f where f.function_name = r.function_name and f.active_flag) end)
"""
ORPHANS = f"{_ORPHANS} select distinct ruleset_id, version, function_name from found"
ORPHAN_REPORT = f"""{_ORPHANS} select 'ruleset_versions' table_name, strftime(moment, '%Y-%m') "month", count(*) orphan_references, count(distinct function_name) missing_keys from found group by 2"""

_FIGURES = """
with d as (select distinct result_id, rule_id, final_winning_rule_id, coalesce(changed, false) c, coalesce(effective, false) e
           from assignment_results where result_id is not null),
u as (select 'rule_id' field_name, rule_id, c, e from d union all select 'final_winning_rule_id', final_winning_rule_id, c, e from d),
g as (select field_name, rule_id, count(*) n_records, sum(c::int)::bigint n_changed, sum(e::int)::bigint n_effective
      from u where rule_id is not null group by all),
f as (select *, (sum(n_records) over (partition by field_name))::bigint total_records from g)
"""
HEAVY = f"{_FIGURES} select field_name, rule_id from f where n_records * 50 >= total_records"
FIGURES = f"{_FIGURES} select * from f"
