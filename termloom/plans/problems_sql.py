"""SQL of the queries of the general data problems, for a check on the same tables."""

from __future__ import annotations

from termloom.functions import quantity as Q
from termloom.operators.units import UNITS


def _case(text: str, table: dict[str, str], whole: bool) -> str:
    q = lambda p: p.replace("'", "''")
    return "case " + " ".join(f"when regexp_matches({text}, '{'^(?:' + q(p) + ')$' if whole else q(p)}') then '{u}'" for u, p in table.items()) + " end"


def _by_field(make) -> str:
    return "case field " + " ".join(f"when '{q}' then {make(q)}" for q in UNITS) + " end"


def measured() -> str:
    """CTEs ending in m(tbl, row_id, field, clock, number, unit, hundredths)."""
    parts = [f"select 'ns_msi_sample' tbl, fee_row_id row_id, '{q}' field, {q} value, description text, feed from ns_msi_sample" for q in ("units", "amount")]
    parts += [f"select 'fee_record', record_id, '{q}', fee_values['{q}'], array_to_string(description, ' '), feed from fee_record" for q in UNITS]
    rest = "case when field = 'amount' then lower(regexp_replace(bare, '^(\\D*?)" + Q.NUMBER + "', '\\1')) else lower(regexp_replace(bare, '" + Q.NUMBER + "', '', 'g')) end"
    said = _by_field(lambda q: _case("rest", {u: p + ("|hours" if u == "hour" else "") for u, p in Q.VALUE_UNITS[q].items()}, True))
    heard = _by_field(lambda q: _case("lower(text)", Q.TEXT_UNITS[q], False))
    factor = "case field || '/' || unit " + " ".join(f"when '{q}/{u}' then {f!r}::decimal(12,6)" for q, us in UNITS.items() for u, f in us) + " end"
    return f"""v as ({' union all '.join(parts)}),
    b as (select *, trim(regexp_replace(value, '(?i)\\s*\\+\\s*(mu|t)\\s*$', '')) bare, field = 'duration' and regexp_matches(value, '{Q.CLOCK}') clock from v where value is not null),
    c as (select *, regexp_extract(bare, '{Q.NUMBER}', 1) raw, regexp_replace({rest}, '[\\s.()]', '', 'g') rest from b where not contains(value, '%')),
    n as (select *, case when regexp_matches(value, '{Q.CLOCK}') then 60 * regexp_extract(value, '{Q.CLOCK}', 1)::decimal(20,8) + regexp_extract(value, '{Q.CLOCK}', 2)::decimal(20,8)
        when regexp_matches(raw, '^[\\d,]*\\d,\\d{{2}}$') then (replace(raw[:-4], ',', '') || '.' || right(raw, 2))::decimal(20,8) else replace(raw, ',', '')::decimal(20,8) end number from c where raw <> ''),
    f as (select n.*, case field when 'units' then units_unit when 'amount' then amount_unit else duration_unit end by_feed from n left join feed_info using (feed)),
    u as (select *, case when clock then 'minute' else coalesce({said}, {heard}, by_feed) end unit from f),
    m as (select tbl, row_id, field, clock, number, unit, round((number::decimal(20,6) * ({factor})::decimal(12,6))::decimal(30,6) * 100::decimal(5,0))::bigint hundredths from u)"""


P1 = f"""with {measured()} select distinct tbl, row_id, field, hundredths common_value from m
where clock or unit not in ('msu', 'dollar', 'minute')"""

_KEY = "nullif(lower(regexp_replace(code, '[.\\s -]', '', 'g')), '')"
_REFS = f"""r as (
    select 'concept_relationship' tbl, edge_id row_id, year(e.valid_start)::varchar period, case when c.concept_id is null then 'missing' when c.valid_end < e.valid_start then 'deleted' when c.valid_start > e.valid_start then 'later' end reason
    from concept_relationship e left join concept c on c.concept_id = e.concept_id_2 where concept_id_2 is not null
    union all
    select 'index_term', entry_id, release_year::varchar, case when c.k is null then 'missing' when c.valid_end < make_date(release_year - 1, 10, 1) then 'deleted' when c.valid_start > make_date(release_year - 1, 10, 1) then 'later' end
    from (select *, {_KEY} k from index_term) t left join (select {_KEY} k, valid_start, valid_end from concept where vocabulary_id = 'ICD10CM') c using (k) where t.k is not null)"""
P2 = f"with {_REFS} select distinct tbl, row_id, reason from r where reason is not null"
P2_COUNTS = f"""with {_REFS} select tbl, coalesce(period, 'none') period, count(*) n_refs, count(*) filter (reason = 'missing') n_missing,
    count(*) filter (reason = 'deleted') n_deleted, count(*) filter (reason = 'later') n_later from r group by 1, 2"""

_VERSIONS = f"""{measured()},
    s as (
    select 'concept_snapshot' tbl, concept_id::varchar entity, snapshot_date as on_day, lower(regexp_replace(name, '\\s+', '', 'g')) || '/' || coalesce(valid_end::varchar, '') state, received_at received, snapshot_row_id row_id
    from concept_snapshot where concept_id is not null and snapshot_date is not null
    union all
    select 'ns_msi_sample', concat_ws('|', coalesce(code, ''), coalesce(modifier, ''), coalesce(locality, '')), effective_start, hundredths::varchar, loaded_at, row_id
    from ns_msi_sample join m on m.tbl = 'ns_msi_sample' and m.field = 'units' and m.row_id = fee_row_id where effective_start is not null and hundredths is not null),
    d as (select * from s qualify row_number() over (partition by tbl, entity, on_day order by received desc nulls last, row_id desc) = 1),
    g as (select *, lag(state) over w is distinct from state or lag(on_day) over w is null as fresh from d window w as (partition by tbl, entity order by on_day)),
    h as (select tbl, entity, on_day valid_from, state, row_number() over w as version, lead(on_day) over w valid_to from g where fresh window w as (partition by tbl, entity order by on_day))"""
P3 = f"with {_VERSIONS} select tbl, entity, strftime(valid_from, '%Y-%m-%d') valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), 'open') valid_to from h"

_TREE = """l as (
    select distinct 'release_parent' tbl, release_year, coalesce(code, parent_code) node, case when code is not null then parent_code end parent from release_parent where coalesce(code, parent_code) is not null and release_year is not null
    union select distinct 'concept_relationship', 0, (case relationship_id when 'is_a' then concept_id_1 else concept_id_2 end)::varchar, (case relationship_id when 'is_a' then concept_id_2 else concept_id_1 end)::varchar
    from concept_relationship where relationship_id in ('is_a', 'subsumes')),
    e as (select tbl, release_year, node, min(parent) parent from (select * from l union all select tbl, release_year, parent, null from l where parent is not null) group by all),
    t as (select tbl, release_year, node, [node] path from e where parent is null
        union all select e.tbl, e.release_year, e.node, list_append(t.path, e.node) from e join t on e.tbl = t.tbl and e.release_year = t.release_year and e.parent = t.node),
    x as (select e.* from e anti join t on e.tbl = t.tbl and e.release_year = t.release_year and e.node = t.node),
    y as (select tbl, release_year, node, parent up from x union select y.tbl, y.release_year, y.node, x.parent from y join x on x.tbl = y.tbl and x.release_year = y.release_year and x.node = y.up)"""
P5 = f"""with recursive {_TREE} select tbl, release_year, node, array_to_string(path, '>') path from t
    union all select tbl, release_year, node, case when exists (select 1 from y where y.tbl = x.tbl and y.release_year = x.release_year and y.node = x.node and y.up = x.node) then '#cycle' else '#below' end from x"""
P5_DESCENDANTS = f"""with recursive {_TREE}, q as (select tbl, release_year, node, path, unnest(range(1, len(path))) distance from t)
    select tbl, release_year, node, path[len(path) - distance] ancestor, distance::int distance from q"""

P7 = """with i as (select distinct code, effective_start lo, coalesce(effective_end, date '9999-12-31') hi from ns_msi_sample where code is not null and effective_start is not null and (effective_end is null or effective_end >= effective_start)),
    j as (select *, max(hi) over (partition by code order by lo, hi rows between unbounded preceding and 1 preceding) reach from i),
    k as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by code order by lo, hi rows unbounded preceding) run from j),
    p as (select code, run, min(lo) lo, max(hi) hi from k group by all)
    select code, 'period' kind, strftime(lo, '%Y-%m-%d') from_date, case when hi = date '9999-12-31' then 'open' else strftime(hi, '%Y-%m-%d') end to_date from p
    union all select code, 'gap', strftime(hi + 1, '%Y-%m-%d'), strftime(after - 1, '%Y-%m-%d') from (select *, lead(lo) over (partition by code order by run) after from p) where after is not null"""

SQL = {"p1_found": P1, "p2_found": P2, "p2_counts": P2_COUNTS, "p3_found": P3, "p5_found": P5, "p5_descendants": P5_DESCENDANTS, "p7_found": P7}
