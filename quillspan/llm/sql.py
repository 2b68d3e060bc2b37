"""SQL counterparts of the queries that SQL can express."""

_ID = "case when lower(regexp_replace(trim({0}), '[.]0$', '')) not in ('', 'nan', 'none', '<na>') then regexp_replace(trim({0}), '[.]0$', '') end"
_POS = "regexp_replace(replace(upper(trim(position, ' ')), '/', '-'), ' *- *', '-', 'g')"
_ONE = "PG|SG|SF|PF|C|G|F"


def _height(c: str) -> str:
    return f"case when regexp_full_match({c}, ' *[0-9]+([.][0-9]+)? *') and cast(trim({c}, ' ') as double) between 60 and 96 then trim({c}, ' ') end"


_FIELDS = {
    "position": f"case when regexp_full_match({_POS}, '{_ONE}') or (regexp_full_match({_POS}, '({_ONE})-({_ONE})') and split_part({_POS}, '-', 1) <> split_part({_POS}, '-', 2)) then {_POS} end",
    "height_wo_shoes": _height("height_wo_shoes"),
    "height_w_shoes": _height("height_w_shoes"),
    "weight": "case when not isnan(weight) then cast(weight as varchar) end",
    "wingspan": "case when not isnan(wingspan) then cast(wingspan as varchar) end",
}

SQL = {
    "p3_found": f"""
with recursive e as (select event_id, {_ID.format('nba_player_id')} as p, {_ID.format('college_espn_id')} as c from draft_classification),
link as (
  select event_id as a, min(event_id) over (partition by p) as b from e where p is not null
  union select event_id, min(event_id) over (partition by c) from e where c is not null),
both_ways as (select a, b from link where a <> b union select b, a from link where a <> b),
reach(a, b) as (select event_id, event_id from e union select r.a, l.b from reach r join both_ways l on r.b = l.a),
comp as (select a as event_id, min(b) as g from reach group by a)
select g as group_event_id, event_id from comp where g <> event_id""",
    "p5_found": f"""
with r as (select *, {_ID.format('nba_player_id')} as pid from combine_anthro),
k as (select *, count(*) over (partition by pid, draft_year) as of_key from r where pid is not null),
v as ({' union all '.join(f"select pid, draft_year, '{f}' as field, anthro_row_id, trust_rank, loaded_at, {x} as value from k where of_key > 1" for f, x in _FIELDS.items())})
select pid as nba_player_id, draft_year, field, anthro_row_id from v where value is not null
qualify row_number() over (partition by pid, draft_year, field order by trust_rank nulls last, loaded_at desc nulls last, anthro_row_id) = 1""",
    "p9_found": r"""
with iw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
ig as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 11))) as i from iw)),
dg as (select distinct doc_id, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) as i from dw))
select distinct doc_id, item_id from dg join ig using (g)""",
}
