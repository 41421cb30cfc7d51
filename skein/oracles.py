"""SQL for the engine's queries, as DuckDB reads it."""

EVENTS = "(select event_id, user_id, event_type, ts, value, case when event_type='purchase' then value end as v from events)"

REGION, NATION, CUSTOMER, NEXT, TURN = 100_000_000, 200_000_000, 300_000_000, 400_000_000, 20_000_000_000

SQL = {
    "flagship": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus='F' and o_totalprice>1000 and not (o_orderpriority='1-URGENT') order by o_totalprice desc, o_orderkey limit 10",  # F18 O1 O8
    "scan_table": "select n_nationkey, n_name, n_regionkey from nation",  # S1
    "scan_list_default": "select conv_id, turn, cast(row_number() over (order by coalesce(turn,0), conv_id)-1 as bigint) as pos from conversations",  # S2
    "scan_list_group": "select turn, role from conversations where conv_id=3 order by turn",  # S3
    "point_read": "select o_orderkey, o_totalprice from orders where o_orderkey=7",  # S4 S5
    "list_length": "select conv_id, count(*) as n from conversations group by conv_id",  # S7
    "flt_eq": "select c_custkey from customer where c_mktsegment='BUILDING'",  # F5
    "flt_ne": "select c_custkey from customer where c_mktsegment<>'BUILDING'",  # F6
    "flt_gt": "select c_custkey from customer where c_acctbal>5000",  # F7
    "flt_lt": "select c_custkey from customer where c_acctbal<0",  # F8
    "flt_ge": "select p_partkey from part where p_size>=40",  # F9
    "flt_le": "select p_partkey from part where p_size<=5",  # F10
    "flt_bool_ne": "select c_custkey from customer where (c_acctbal<0)<>false",  # F6
    "flt_binary_eq": "select c_custkey from customer where c_mktsegment='BUILDING'",  # F5
    "flt_and_range": "select p_partkey from part where p_size>10 and p_size<30 and p_retailprice>=920 and p_retailprice<=980",  # F11 X4
    "flt_or": "select p_partkey from part where p_size<3 or p_retailprice<950",  # F12
    "flt_not": "select p_partkey from part where not (p_size<25)",  # F13 L1
    "flt_mixed": "select o_orderkey from orders where (o_orderstatus='F' or o_orderstatus='P') and not (o_totalprice>50000)",  # F11 F12 F13
    "flt_match_all": "select count(*) as n from orders where true",  # F14
    "flt_null_lt": f"select event_id from {EVENTS} e where v<50 or v is null",  # F8
    "flt_null_gt": f"select event_id from {EVENTS} e where v>50",  # F7
    "flt_null_ne": f"select event_id from {EVENTS} e where v<>50 or v is null",  # F6
    "flt_null_eq_null": f"select event_id from {EVENTS} e where v is null",  # F16
    "var_pred": "select event_id from events where event_type='purchase' and value>50",  # F15
    "var_not_pred": "select event_id from events where not (event_type='purchase' and value>50)",  # F15 L2
    "flt_chain_after_limit": "select event_id from (select event_id, value from events order by event_id limit 500) z where value>50",  # F17
    "sort_desc_tie_id": "select c_custkey, rn from (select c_custkey, cast(row_number() over (order by c_nationkey desc, c_custkey) as bigint) as rn from customer) z where rn<=20",  # O1 O3
    "sort_nulls_lowest": f"select event_id, rn from (select event_id, cast(row_number() over (order by v asc nulls first, event_id) as bigint) as rn from {EVENTS} e) z",  # O1
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",  # O8
    "offset_limit": "select o_orderkey from orders order by o_orderkey limit 10 offset 20",  # O6 O7
    "agg_count": "select count(*) as n from events",  # A1
    "agg_sum": "select cast(sum(o_orderkey) as bigint) as s from orders",  # A2
    "agg_min_max": "select min(c_acctbal) as lo, max(c_acctbal) as hi from customer",  # A3 A4
    "agg_count_by_parent": "select o_custkey, count(*) as n from orders group by o_custkey",  # A5 A7
    "agg_sum_by_parent": "select o_custkey, round(sum(o_totalprice),2) as s from orders group by o_custkey",  # A5 A8
    "agg_max_by_variant": "select event_type, max(value) as m from events group by event_type",  # A4 A5
    "agg_parent_selection": "select n_regionkey, count(*) as n from nation where n_regionkey=1 or n_regionkey=2 or n_regionkey=2 group by n_regionkey",  # A9 J1
    "agg_over_limited": "select count(*) as n, round(sum(value),2) as s from (select value from events order by event_id limit 100 offset 50) z",  # A13
    "agg_null_min_lowest": f"select event_type, case when count(*)>count(v) then null else min(v) end as m from {EVENTS} e group by event_type",  # A3
    "rel_fk_selection": "select o_orderkey from orders where o_custkey=1 or o_custkey=2",  # J1
    "rel_join_parent": "select o.o_orderkey, c.c_name, n.n_name from orders o join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey where o.o_totalprice>200000",  # J9
    "rel_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>200000)",  # J1
    "rel_anti_referential": "select event_id from events e where not exists (select 1 from customer where c_custkey=e.user_id and c_acctbal>0)",  # J6 C7
    "rel_descendants": "with recursive edges as (select * from (select 100000000+r_regionkey as id, cast(null as bigint) as parent from region union all select 200000000+n_nationkey, 100000000+n_regionkey from nation union all select 300000000+c_custkey, 200000000+c_nationkey from customer) x), d(id, depth) as (select id, 0 from edges where id=100000001 union all select c.id, d.depth+1 from edges c join d on c.parent=d.id) select id, depth from d",  # J7 M4
    "rel_ancestors": "with recursive edges as (select * from (select 100000000+r_regionkey as id, cast(null as bigint) as parent from region union all select 200000000+n_nationkey, 100000000+n_regionkey from nation union all select 300000000+c_custkey, 200000000+c_nationkey from customer) x), d(id, parent, depth) as (select id, parent, 0 from edges where id=300000005 union all select c.id, c.parent, d.depth+1 from edges c join d on d.parent=c.id) select id, depth from d",  # J8
    "nbr_prev_next": "select event_id, lag(event_id) over w as prev_id, lead(event_id) over w as next_id from events window w as (partition by user_id order by ts, event_id)",  # J4 J5 W1
    "nbr_probe_prev": "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev_id from orders",  # J4
    "nbr_first_k": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events) z where rn<=2",  # W3
    "ivl_pairs": "select a.event_id as a_id, b.event_id as b_id from (select event_id, user_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint)+20 as t from events) a join (select event_id, user_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint)+20 as t from events) b on a.user_id=b.user_id and a.s<b.t and b.s<a.t and a.event_id<b.event_id",  # J2
    "ivl_probe": "select event_id from (select event_id, user_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint)+20 as t from events) a where user_id=5 and s<60 and t>40",  # J2 J3
    "list_rotate": "select conv_id, turn, case when turn>=0 and turn<3 then (((turn-0-1) % 3) + 3) % 3 else turn end as new_index from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*)>=3)",  # M8
    "list_insert_shift": "select conv_id, turn, case when turn>=1 then turn+1 else turn end as new_index from conversations",  # M3
    "list_remove_at": "select conv_id, turn, case when turn>1 then turn-1 else turn end as new_index from conversations where turn<>1",  # M5
    "list_reindex": "select conv_id, turn, cast(row_number() over (partition by conv_id order by turn)-1 as bigint) as new_index from conversations where role<>'system'",  # W2
    "chk_unique_global": "select c_nationkey, count(*) as n from customer group by c_nationkey having count(*)>1",  # C3
    "chk_unique_scoped": "select o_custkey, o_orderpriority, count(*) as n from orders where o_custkey is not null group by o_custkey, o_orderpriority having count(*)>1",  # C4
    "chk_check_predicate": "select c_custkey from customer where not (c_acctbal>=0 and c_acctbal<=10000)",  # C2
    "chk_lineitem_key": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*)>1",  # C3
    "comp_chain": "select l_orderkey, l_linenumber, net, net*(1+l_tax) as gross from (select *, l_extendedprice*(1-l_discount) as net from lineitem) z",  # C11 U2
    "chg_merge": "select item, col, min(seq) as first_seq, arg_min_null(newv,seq) as first_new, arg_max_null(newv,seq) as last_new from (select event_id as seq, user_id as item, event_type as col, value as newv, lag(value) over (partition by user_id, event_type order by event_id) as oldv from events) l group by item, col",  # M16 W4
    "chg_invert": "select cast(row_number() over (order by seq desc) as bigint) as inv_seq, item, col, newv as inv_old, oldv as inv_new from (select event_id as seq, user_id as item, event_type as col, value as newv, lag(value) over (partition by user_id, event_type order by event_id) as oldv from events) l",  # M15
    "chg_replay_state": "select item, col, arg_max_null(newv,seq) as value from (select event_id as seq, user_id as item, event_type as col, value as newv, lag(value) over (partition by user_id, event_type order by event_id) as oldv from events) l group by item, col",  # T5
    "set_intersect_equiv": "select p_partkey from part where p_size>10 intersect select p_partkey from part where p_retailprice>950",  # §2.7
    "set_union_equiv": "select p_partkey from part where p_size<5 union select p_partkey from part where p_retailprice<950",  # §2.7
    "set_except_equiv": "select p_partkey from part except select p_partkey from part where p_size<25",  # §2.7
    "agg_by_list_group_top": "select role, count(*) as n, max(turn) as m from conversations group by role",  # A5 S2
    # state after transactions and sets of rows
    "txn_insert": f"select cast(n_nationkey+{NATION} as bigint) as item_id, n_name as name, cast(n_regionkey+{REGION} as bigint) as region from nation union all select cast({NEXT + 1} as bigint), 'LEMURIA', cast({NEXT} as bigint)",  # M1 M2 M9 M18
    "txn_update_cell": f"select item_id, balance, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_custkey=5 then 1.5 else c_acctbal end as balance from customer) z",  # M6 C11
    "txn_update_cells": f"select item_id, balance, segment, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_custkey=7 then 2.0 else c_acctbal end as balance, case when c_custkey=7 then 'OTHER' else c_mktsegment end as segment from customer) z",  # M7
    "txn_remove_cascade": f"select cast({NATION}+n_nationkey as bigint) as item_id from nation where n_nationkey<>3 union all select {CUSTOMER}+c_custkey from customer where c_nationkey<>3",  # M4
    "txn_rollback": f"select {CUSTOMER}+c_custkey as item_id, c_acctbal as balance from customer",  # M10
    "txn_failure": f"select {CUSTOMER}+c_custkey as item_id, c_acctbal as balance, 'rolled_back' as state from customer",  # M11 C3
    "txn_undo": f"select item_id, balance, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_custkey=5 then 1.5 else c_acctbal end as balance from customer) z",  # M12 M13
    "txn_redo": f"select item_id, balance, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_custkey=5 then 2.5 else c_acctbal end as balance from customer) z",  # M12
    "txn_history": "select cast(a as integer) as at, cast(u as integer) as undo, cast(r as integer) as redo from (values (1, 2, 1), (2, 3, 0), (3, 3, 0)) v(a, u, r)",  # M13 M14
    "bulk_insert": f"select cast({NEXT - 1}+row_number() over (order by n_name) as bigint) as item_id, n_name as name, cast(0 as double) as balance, 'NONE' as segment, cast(0 as double) as twice, cast({NATION}+n_nationkey as bigint) as nation from nation",  # M2 C7 C10 C11
    "bulk_update": f"select item_id, balance, segment, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_mktsegment='BUILDING' then c_acctbal+100 else c_acctbal end as balance, c_mktsegment as segment from customer) z",  # M6 C2
    "bulk_remove_cascade": f"select cast({NATION}+n_nationkey as bigint) as item_id from nation where n_regionkey<>1 and n_nationkey<>2 union all select {CUSTOMER}+c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey=1 or n_nationkey=2)",  # M4
    "engine_read": f"select {CUSTOMER}+c_custkey as item_id, true as there, c_acctbal as balance from customer where c_custkey=5 union all select cast({CUSTOMER + 1_000_000_000} as bigint), false, null",  # S4 S5 S6
    "list_transactions": f"select conv_id*1000+turn as item_id, cast(case turn when 1 then 0 when 2 then 1 else turn end as bigint) as list_index, role from conversations where conv_id=3 and turn>=1 union all select {TURN}, 2, 'note'",  # M3 M5 M8
    "snapshot_round_trip": f"select {CUSTOMER}+c_custkey as item_id, c_name as name, case when c_custkey=5 then 1.5 else c_acctbal end as balance, cast({NATION}+c_nationkey as bigint) as nation from customer where c_custkey<>6",  # S8 S9
    "log_round_trip": f"select item_id, name, balance, segment, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, c_name as name, case c_custkey when 5 then 1.5 when 6 then 2.5 else c_acctbal end as balance, c_mktsegment as segment from customer union all select {NEXT}, 'new 0', 0, 'NONE' union all select {NEXT + 1}, 'new 1', 0, 'NONE') z",  # S10 S11 T5
    "change_set_codec": f"select item_id, balance, 2*balance as twice from (select {CUSTOMER}+c_custkey as item_id, case when c_custkey=5 then 4.5 else c_acctbal end as balance from customer where c_custkey<>6) z",  # S13 S14 M16
    "txn_hooks": "select item_id, v as value, 2*v as mirror, 3*v as total from (select cast(row_number() over (order by n_nationkey) as bigint) as item_id, cast(case when row_number() over (order by n_nationkey)=1 then 50 else n_nationkey end as bigint) as v from nation order by n_nationkey limit 5) z",  # U2 U3 U4 U7
    "txn_events": "select cast(a as integer) as at, s as stage, o as origin, cast(n as integer) as operations from (values (0, 'after_apply', 'normal', 2), (1, 'after_commit', 'normal', 2), (2, 'after_apply', 'undo', 2), (3, 'after_commit', 'undo', 2), (4, 'rollback', 'normal', 0)) v(a, s, o, n)",  # T2 T3 U6
    # views
    "view_live": "select count(*) as before, count(*)+1 as after from customer",  # T1
    "view_count": "select count(*) as n, count(*)-100 as after_offset, cast(7 as bigint) as within_limit from customer",  # A10
    "view_empty": "select false as rows, true as none, true as past_end",  # A11
    "view_sort": "select c_custkey, cast(row_number() over (order by c_mktsegment desc, c_acctbal, c_custkey)-1 as bigint) as pos from customer",  # O2
    "view_offset": "select c_custkey from customer order by c_acctbal desc, c_custkey offset 100",  # O7
    "view_rows": "select cast(row_number() over (order by c_acctbal desc, c_custkey)-1 as bigint) as pos, c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20",  # S15
    "view_visit": "select c_custkey, c_acctbal from (select * from customer order by c_custkey limit 1000) z where c_custkey<=(select coalesce(min(c_custkey) filter (where c_acctbal<0), max(c_custkey)) from (select * from customer order by c_custkey limit 1000) y)",  # S16 U5
    "view_aggregate_rows": "select c_mktsegment, count(*) as n from customer group by c_mktsegment",  # S17
    "variant_field": "select event_id, cast(row_number() over (order by event_type nulls first, case when event_type='purchase' then value end desc nulls last, event_id)-1 as bigint) as pos from events",  # F3 F15 O1
    # rules
    "chk_not_null": "select 'null' as rule, 'v' as field, event_id as item_id from events where event_type<>'purchase'",  # C1
    "chk_unique_nulls": "select case when event_type='purchase' then cast(floor(value) as bigint) end as v, count(*) as n from events group by 1 having count(*)>1",  # C5
    "chk_variant_rules": "with e as (select case when event_type in ('purchase','view') then event_type end as variant, case when event_type in ('purchase','view') and value>=20 then cast(floor(value) as bigint) end as amount from events) select * from (select 'variant' as rule, 'variant' as field, count(*) as n from e where variant is null union all select 'variant column', 'amount', count(*) from e where variant='view' and amount is not null union all select 'null', 'amount', count(*) from e where variant='purchase' and amount is null union all select 'unique', 'amount', count(*) from (select amount from e where variant='purchase' and amount is not null group by amount having count(*)>1) u) z where n>0",  # C6 C9
    "chk_python": "select 'check' as rule, c_custkey from customer where not (c_acctbal>0)",  # C2 U1
    "chk_against_stored": f"select 'unique' as rule, 'name' as field, cast({NEXT}+n_nationkey as bigint) as item_id from nation where n_nationkey%2=0 and n_nationkey%3<>0 union all select 'reference', 'region', cast({NEXT}+n_nationkey as bigint) from nation where n_nationkey%3=0",  # C4 C7
    "chk_cycles": "with recursive e as (select c_custkey as id, case when c_custkey%5<>4 then c_custkey+1 when c_custkey%10=4 then c_custkey-4 end as parent from customer), w(id, up, n) as (select id, parent, 1 from e union all select w.id, e.parent, w.n+1 from w join e on e.id=w.up where w.n<20) select id from w where n=20 and up is not null",  # C8
    # maintained aggregates and streams
    "rollup_maintained": "select o_custkey, count(*) as n, cast(sum(o_orderkey) as bigint) as total, min(o_orderkey) as lo, max(o_orderkey) as hi from orders group by o_custkey",  # A8
    "stream_rollup": "select o_custkey, count(*) as n, cast(sum(o_orderkey+9007199254740992) as varchar) as total, min(o_orderkey)+9007199254740992 as lo, max(o_orderkey)+9007199254740992 as hi from orders group by o_custkey",  # A8 T4
    "stream_lists": "select conv_id, conv_id*1000+turn as item_id, cast((c-1-turn-1+c)%c as bigint) as list_index from (select conv_id, turn, count(*) over (partition by conv_id) as c from conversations) z",  # T6
}
