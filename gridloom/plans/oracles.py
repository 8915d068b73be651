"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

SQL: dict[str, str] = {
    "mr_sum_squares": """
select cast(sum(o_custkey*o_custkey) as bigint) s from orders
""",
    "mr_sum_init": """
select cast(100+sum(o_custkey*o_custkey) as bigint) s from orders
""",
    "mr_min_max": """
select min(o_custkey) mn, max(o_custkey) mx from orders
""",
    "mr_zip_dot": """
with a as (select row_number() over (order by o_orderkey) rn, o_custkey from orders),
     b as (select row_number() over (order by c_custkey) rn, c_nationkey from customer)
select cast(sum(a.o_custkey*b.c_nationkey) as bigint) s, cast(count(*) as bigint) n from a join b on a.rn=b.rn
""",
    "mr_merge_last_wins": """
select o_custkey, max_by(o_orderpriority, o_orderkey) v from orders group by o_custkey
""",
    "mr_concat_ordered": """
select string_agg(n_name, '|' order by n_nationkey) s from nation
""",
    "mr_concat_flip": """
select string_agg(n_name, '|' order by n_nationkey desc) s from nation
""",
    "split_rank_totals": """
select cast(r as bigint) r, cast(count(*) as bigint) n, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) cents,
       min(o_orderkey) lo, max(o_orderkey) hi
from (select ntile(7) over (order by o_orderkey) r, * from orders) t group by r
""",
    "split_lineitem_totals": """
select cast(r as bigint) r, cast(count(*) as bigint) n, cast(sum(cast(l_quantity as bigint)) as bigint) q
from (select ntile(16) over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) r, l_quantity from lineitem) t group by r
""",
    "split_local_index": """
with t as (select ntile(7) over (order by o_orderkey) r, o_orderkey from orders)
select cast(r as bigint) r, cast(row_number() over (partition by r order by o_orderkey) as bigint) i, o_orderkey from t
""",
    "split_recast": """
with t as (select ntile(5) over (order by o_orderkey) r5, ntile(10) over (order by o_orderkey) r10 from orders)
select cast(r5 as bigint) r5, cast(min(r10) as bigint) lo, cast(max(r10) as bigint) hi from t group by r5
""",
    "split_more_ranks_than_rows": """
select cast(ntile(8) over (order by r_regionkey) as bigint) r, r_name from region
""",
    "halve_floor": """
with t as (select row_number() over (order by n_nationkey) rn, count(*) over () n, n_name from nation)
select case when rn <= n//2 then 'L' else 'R' end side, cast(count(*) as bigint) c, min(n_name) mn from t group by 1
""",
    "zip_slice": """
with t as (select row_number() over (order by n_nationkey) rn, n_name from nation)
select cast(rn as bigint) rn, n_name from t where rn between 9 and 15
""",
    "grid_product": """
select a.i i1, b.i i2, c.i i3 from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i)
""",
    "grid_section": """
select * from (select cast(row_number() over (order by c.i,b.i,a.i) as bigint) idx, a.i i1, b.i i2, c.i i3
from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i)) t where idx between 5 and 11
""",
    "grid_rank_and_local_index": """
with g as (select a.i i1, b.i i2, c.i i3, ntile(7) over (order by c.i,b.i,a.i) r from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i))
select i1,i2,i3, cast(r as bigint) r, cast(row_number() over (partition by r order by i3,i2,i1) as bigint) i from g
""",
    "grid_rank_lookup": """
with g as (select a.i i1, b.i i2, ntile(7) over (order by b.i,a.i) r from range(1,6) a(i), range(2,5) b(i))
select o.o_orderkey, cast(g.r as bigint) r from orders o left join g on g.i1 = o.o_orderkey%7+1 and g.i2 = o.o_custkey%4+1
""",
    "grid_linear_index": """
select i1,i2, cast(row_number() over (order by i2,i1) as bigint) idx
from (select a.i i1, b.i i2 from range(1,5) a(i), range(2,9,3) b(i)) t
""",
    "grid_membership_count": """
with g as (select a.i i1, b.i i2, row_number() over (order by b.i,a.i) idx from range(1,6) a(i), range(2,5) b(i))
select cast(count(*) as bigint) n from orders o join g on g.i1=o.o_orderkey%7+1 and g.i2=o.o_custkey%4+1 where g.idx between 4 and 11
""",
    "grid_extrema_by_rank": """
with g as (select a.i i1, b.i i2, c.i i3, ntile(7) over (order by c.i,b.i,a.i) r from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i))
select cast(r as bigint) r, min(i1) mn1, max(i1) mx1, min(i2) mn2, max(i2) mx2, min(i3) mn3, max(i3) mx3 from g group by r
""",
    "grid_nelements_by_rank": """
with g as (select a.i i1, b.i i2, c.i i3, ntile(4) over (order by c.i,b.i,a.i) r from range(1,6) a(i), range(1,3) b(i), range(1,4) c(i))
select cast(r as bigint) r, cast(count(distinct i1) as bigint) d1, cast(count(distinct i2) as bigint) d2, cast(count(distinct i3) as bigint) d3 from g group by r
""",
    "grid_extrema_common_last_dim": """
with g as (select a.i i1, b.i i2, c.i i3, ntile(10) over (order by c.i,b.i,a.i) r from range(1,4) a(i), range(4,8) b(i), range(2,8) c(i)),
     m as (select *, min(i3) over (partition by r) lo, max(i3) over (partition by r) hi from g)
select cast(r as bigint) r, lo, hi, min(case when i3=lo then i1 end) mn1, min(case when i3=lo then i2 end) mn2,
       max(case when i3=hi then i1 end) mx1, max(case when i3=hi then i2 end) mx2 from m group by r, lo, hi
""",
    "grid_drop_leading": """
with g as (select a.i i1, b.i i2, c.i i3, ntile(7) over (order by c.i,b.i,a.i) r from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i))
select distinct cast(r as bigint) r, i2, i3 from g
""",
    "grid_stepped_axis": """
select a.i i1, b.i i2, cast(ntile(4) over (order by b.i,a.i) as bigint) r from range(1,10,2) a(i), range(4,7) b(i)
""",
    "grid_float_axis": """
select cast(1+0.5*a.i as double) i1, b.i i2, cast(ntile(4) over (order by b.i,a.i) as bigint) r from range(0,5) a(i), range(2,5) b(i)
""",
    "mr_grid_sum": """
select cast(sum(a.i*b.i) as bigint) s from range(1,11) a(i), range(2,21,2) b(i)
""",
    "section_batch_sum": """
with g as (select a.i i1, b.i i2, ntile(4) over (order by b.i,a.i) r from range(1,11) a(i), range(1,11) b(i))
select cast(r as bigint) r, cast(sum(i1+i2) as bigint) s from g group by r
""",
    "section_reduce_with_init": """
with g as (select a.i i1, ntile(4) over (order by a.i) r from range(1,11) a(i)), p as (select r, max(i1) m from g group by r)
select cast(100+sum(m) as bigint) s from p
""",
    "ew_sum_min_max": """
select cast(pos as bigint) pos, round(sum(cast(v as double)),3) s, cast(min(v) as double) mn, cast(max(v) as double) mx
from (select unnest(range(len(embedding))) pos, unnest(embedding) v from embeddings) t group by pos
""",
    "ew_product": """
select cast(pos as bigint) pos, product(case when v < 0 then -1.0::double else 1.0::double end) p
from (select unnest(range(len(embedding))) pos, unnest(embedding) v from embeddings) t group by pos
""",
    "stack_sum_overlap": """
with x as (select case when label < 5 then label else label+100 end + unnest(range(len(embedding))) idx, unnest(embedding) v from embeddings),
     a as (select idx, sum(cast(v as double)) v from x group by idx), b as (select min(idx) lo, max(idx) hi from a)
select cast(f.i as bigint) idx, round(coalesce(a.v,0),3) v from b, range(0,1000) f(i) left join a on a.idx=f.i where f.i between b.lo and b.hi
""",
    "batch_map_ordered": """
select o_orderkey, 2*o_custkey+1 v from orders
""",
    "batch_sections_one_row_per_rank": """
select cast(r as bigint) r, cast(count(*) as bigint) n from (select ntile(6) over (order by event_id) r from events) t group by r
""",
    "tree_topology_13": """
select cast(i as bigint) i, cast(p as bigint) parent, cast(case when i%2=1 then 0 when i=13 then 1 else 2 end as bigint) nchildren
from (values (1,2),(2,4),(3,2),(4,8),(5,6),(6,4),(7,6),(8,8),(9,10),(10,12),(11,10),(12,8),(13,12)) t(i,p)
""",
}
