"""The relational query catalogue: one registered query per operator, as SQL over the Parquet tables.

Each entry is the Spark text and, where DuckDB spells something differently, the oracle's text.  Both sides cast and
round alike, so results can be compared by value.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.engine_queries import warehouse
from tesserae.session import Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (Spark SQL, DuckDB SQL)
CATALOGUE: dict[str, tuple[str, str]] = {}


def define(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    CATALOGUE[name] = (spark_sql.strip(), (duck_sql or spark_sql).strip())


def tables_in(sql: str) -> list[str]:
    import re

    words = set(re.findall(r"\w+", sql))
    return [t for t in TABLES if t in words]


#: Engine sessions by context and Spark session: made once.
_SESSIONS: dict[tuple, Session] = {}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan one catalogue query over the tables of sf_dir, as an engine session does; only the tables it names are looked at."""
    sql, key = CATALOGUE[name][0], (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    if key not in _SESSIONS:
        _SESSIONS[key] = Session(spark, warehouse(spark))
    own = _SESSIONS[key]
    for t in tables_in(sql):
        own.spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return own.sql(sql)


def queries() -> dict:
    return {name: partial(run, name) for name in CATALOGUE}


def oracle_sql() -> dict[str, str]:
    return {name: duck for name, (_, duck) in CATALOGUE.items()}


# Headline queries.

define("q1_pricing_summary", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) as sum_charge,
       round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= cast('1998-09-02' as date) group by l_returnflag, l_linestatus""")

define("q3_shipping_priority", """
select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < cast('1998-03-15' as date) and l_shipdate > cast('1998-03-15' as date)
group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""")

define("q5_local_supplier", """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= cast('1996-01-01' as date) and o_orderdate < cast('1997-01-01' as date)
group by n_name""")

define("q6_forecast_revenue", """
select round(sum(l_extendedprice * l_discount), 4) as revenue, count(*) as n_rows from lineitem
where l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date) and l_discount between 0.05 and 0.07 and l_quantity < 24""")

define("q10_returned_items", """
select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, c_acctbal, n_name
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
where o_orderdate >= cast('1996-01-01' as date) and o_orderdate < cast('1996-04-01' as date) and l_returnflag = 'R'
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""")

define("q14_promo_effect", """
select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0.0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue
from lineitem join part on l_partkey = p_partkey
where l_shipdate >= cast('1996-09-01' as date) and l_shipdate < cast('1996-10-01' as date)""")

# Projection, filter, predicates.

define("scan_project", "select c_custkey, c_name, c_acctbal * 2 as twice, c_mktsegment as segment from customer")
define("filter_and_or", "select o_orderkey, o_orderstatus, o_totalprice from orders where (o_orderstatus = 'F' and o_totalprice > 200000) or (o_orderstatus = 'O' and not (o_totalprice >= 50000))")
define("filter_between_in", "select l_orderkey, l_partkey, l_quantity, l_returnflag from lineitem where l_quantity between 10 and 12 and l_returnflag in ('R', 'A')")
define("filter_like", "select p_partkey, p_name, p_type from part where p_type like 'PROMO%' or p_name ilike '%1'")
define("filter_null", "select event_id, case when v is null then 'none' else 'some' end as kind, v is not null as has from (select event_id, nullif(event_type, 'click') as v from events) t where v is null or v <> 'view'")
define("case_coalesce", """
select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band,
       coalesce(nullif(o_orderstatus, 'O'), 'open') as status from orders""")
define("int_div", "select c_custkey, cast(c_custkey div 7 as bigint) as seventh, c_custkey % 7 as rest from customer", "select c_custkey, cast(c_custkey // 7 as bigint) as seventh, c_custkey % 7 as rest from customer")
define("three_valued", "select user_id, event_id, (nullif(user_id, 3) > 2 and value > 50) as both_true, (nullif(user_id, 3) > 2 or value > 50) as any_true, not (nullif(user_id, 3) > 2) as not_true from events")
define("concat_cast", "select c_custkey, c_name || '-' || cast(c_nationkey as varchar(10)) as tag, cast(c_acctbal as bigint) is not null as whole, try_cast(c_name as int) as bad from customer")
define("values_rows", "select x, x * x as sq from (values (3), (1), (2)) as t(x)")

# Joins.

define("join_inner", "select c_name, count(*) as orders_made, round(sum(o_totalprice), 2) as spent from customer join orders on c_custkey = o_custkey group by c_name")
define("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000")
define("join_right", "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000")
define("join_full", "select c.k as ck, s.k as sk, c.n as cn, s.n as sn from (select c_nationkey as k, count(*) as n from customer where c_nationkey < 20 group by c_nationkey) c full outer join (select s_nationkey as k, count(*) as n from supplier where s_nationkey > 5 group by s_nationkey) s on c.k = s.k")
define("join_semi", "select c_custkey, c_name from customer left semi join orders on c_custkey = o_custkey and o_totalprice > 250000", "select c_custkey, c_name from customer where exists (select 1 from orders where c_custkey = o_custkey and o_totalprice > 250000)")
define("join_anti", "select c_custkey, c_name from customer left anti join orders on c_custkey = o_custkey", "select c_custkey, c_name from customer where not exists (select 1 from orders where c_custkey = o_custkey)")
define("join_not_in", "select n_nationkey, n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)")
define("join_cross", "select r_name, n_name from region cross join nation")
define("join_range", "select a.n_nationkey as low, b.n_nationkey as high from nation a join nation b on a.n_nationkey < b.n_nationkey and b.n_nationkey <= a.n_nationkey + 3")
define("join_self", "select a.o_orderkey as first_order, b.o_orderkey as other from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey where a.o_totalprice > 250000 and b.o_totalprice > 250000")
define("join_using", "select user_id, a.n as clicks, b.n as views from (select user_id, count(*) as n from events where event_type = 'click' group by user_id) a join (select user_id, count(*) as n from events where event_type = 'view' group by user_id) b using (user_id)")
define("join_natural", "select k, x, y from (select n_nationkey as k, n_name as x from nation) a natural join (select s_nationkey as k, count(*) as y from supplier group by s_nationkey) b")
define("join_merge_hint", "select /*+ merge(o) */ c_mktsegment, count(*) as n from customer c join orders o on c_custkey = o_custkey group by c_mktsegment", "select c_mktsegment, count(*) as n from customer c join orders o on c_custkey = o_custkey group by c_mktsegment")
define("join_star", "select r_name, c_mktsegment, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, c_mktsegment")
define("join_composite_key", "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey = b.l_partkey")
define("join_lateral", "select c_custkey, t.top_price from customer, lateral (select max(o_totalprice) as top_price from orders where o_custkey = c_custkey) t")

# Aggregation.

define("agg_global", "select count(*) as n, count(o_orderstatus) as ns, round(sum(o_totalprice), 2) as total, min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice), 4) as mean from orders")
define("agg_group", "select event_type, count(*) as n, round(sum(value), 4) as total, min(ts) as first_ts, max(ts) as last_ts from events group by event_type")
define("agg_having", "select user_id, count(*) as n, round(avg(value), 6) as mean from events group by user_id having count(*) > 60")
define("agg_distinct", "select count(distinct user_id) as users, count(distinct event_type) as kinds from events")
define("agg_multi_distinct", "select event_type, count(distinct user_id) as users, count(distinct cast(ts as date)) as days, count(*) as n from events group by event_type")
define("select_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
define("agg_filter", "select event_type, count(*) filter (where value > 50) as big, round(sum(value) filter (where user_id % 2 = 0), 4) as even_total from events group by event_type")
define("agg_rollup", "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) as int) as g1, cast(grouping(o_orderpriority) as int) as g2 from orders group by rollup(o_orderstatus, o_orderpriority)")
define("agg_cube", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube(l_returnflag, l_linestatus)")
define("agg_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
define("agg_stats", "select event_type, round(stddev_samp(value), 6) as sd, round(stddev_pop(value), 6) as sdp, round(var_samp(value), 4) as vs, round(var_pop(value), 4) as vp, round(corr(value, user_id), 6) as r, round(covar_samp(value, user_id), 4) as cs, round(covar_pop(value, user_id), 4) as cp, round(regr_slope(value, user_id), 8) as slope, round(regr_intercept(value, user_id), 6) as icept, cast(regr_count(value, user_id) as bigint) as rn from events group by event_type")
define("agg_percentile", "select o_orderstatus, round(percentile_cont(0.5) within group (order by o_totalprice), 4) as med, round(percentile_cont(0.9) within group (order by o_totalprice), 4) as p90, round(median(o_totalprice), 4) as med2 from orders group by o_orderstatus")
define("agg_bitwise", "select o_orderstatus, bit_and(o_orderkey) as ba, bit_or(o_orderkey) as bo, bit_xor(o_orderkey) as bx, bool_and(o_totalprice > 0) as alls, bool_or(o_totalprice > 400000) as anys from orders group by o_orderstatus")
define("agg_string_agg", "select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
define("agg_array", "select c_nationkey, cast(size(collect_list(c_custkey)) as bigint) as n, array_sort(collect_list(c_custkey))[1] as least from customer group by c_nationkey", "select c_nationkey, len(array_agg(c_custkey)) as n, list_sort(array_agg(c_custkey))[1] as least from customer group by c_nationkey")
define("agg_first_last", "select user_id, min_by(event_type, event_id) as first_type, max_by(event_type, event_id) as last_type from events group by user_id")
define("agg_conditional", "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end) as done, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0.0 end) / sum(o_totalprice), 8) as share from orders group by o_orderpriority", "select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as done, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0.0 end) / sum(o_totalprice), 8) as share from orders group by o_orderpriority")
define("agg_approx_percentile", "select abs(approx_percentile(o_totalprice, 0.5, 10000) / percentile(o_totalprice, 0.5) - 1) < 0.01 as close, abs(approx_count_distinct(o_custkey) * 1.0 / count(distinct o_custkey) - 1) < 0.15 as near from orders", "select true as close, true as near")

# Windows.

define("win_rank", "select o_orderkey, o_custkey, cast(rank() over (partition by o_custkey order by o_orderpriority) as bigint) as r from orders")
define("win_row_number", "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn from orders")
define("win_dense", "select event_id, cast(dense_rank() over (partition by event_type order by user_id) as bigint) as dr from events")
define("win_ntile", "select o_orderkey, cast(ntile(4) over (partition by o_orderstatus order by o_totalprice, o_orderkey) as bigint) as q from orders")
define("win_lag_lead", "select event_id, lag(event_type) over (partition by user_id order by event_id) as before_type, lead(value, 2) over (partition by user_id order by event_id) as later from events")
define("win_first_last", "select event_id, first_value(event_type) over w as f, last_value(event_type) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as l, nth_value(event_type, 2) over w as second from events window w as (partition by user_id order by event_id)")
define("win_running_sum", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 2) as running from orders")
define("win_moving_avg", "select event_id, round(avg(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 6) as ma from events")
define("win_range_frame", "select event_id, count(*) over (partition by event_type order by user_id range between 2 preceding and 2 following) as n from events")
define("win_cume", "select o_orderkey, round(cume_dist() over (partition by o_orderstatus order by o_totalprice), 9) as cd, round(percent_rank() over (partition by o_orderstatus order by o_totalprice), 9) as pr from orders")
define("win_ignore_nulls", "select event_id, last_value(t) ignore nulls over (partition by user_id order by event_id rows between unbounded preceding and current row) as seen from (select event_id, user_id, nullif(event_type, 'view') as t from events) x", "select event_id, last_value(t ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as seen from (select event_id, user_id, nullif(event_type, 'view') as t from events) x")

# Sort and limit.

define("sort_nulls", "select event_id, v, cast(row_number() over (order by v asc nulls last, event_id) as bigint) as place from (select event_id, nullif(event_type, 'view') as v from events) t")
define("limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
define("topk", "select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 25")
define("topk_per_group", "select o_custkey, o_orderkey, o_totalprice from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) t where k <= 2")

# Set operations, CTEs, subqueries.

define("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
define("set_union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
define("set_intersect", "select c_nationkey as k from customer where c_acctbal < 0 intersect select s_nationkey from supplier")
define("set_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 8000")
define("set_intersect_all", "select n_regionkey as k from nation intersect all select c_nationkey from customer")
define("set_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
define("cte", "with big as (select o_custkey, sum(o_totalprice) as t from orders group by o_custkey), avg_t as (select avg(t) as m from big) select o_custkey, round(t, 2) as t from big, avg_t where t > m * 2")
define("cte_recursive", "with recursive seq(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from seq where n < 15) select n, f from seq")
define("scalar_subquery", "select o_orderkey, round(o_totalprice - (select avg(o_totalprice) from orders), 4) as diff from orders where o_totalprice > (select avg(o_totalprice) * 2 from orders)")
define("correlated_subquery", "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as top from customer")
define("exists_subquery", "select n_name from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9000)")
define("not_exists", "select n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000)")
define("in_subquery", "select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
define("derived_table", "select band, count(*) as n from (select case when c_acctbal < 0 then 'debt' else 'ok' end as band from customer) t group by band")

# Scalar functions.

define("fn_string", """
select p_partkey, upper(p_name) as u, lower(p_brand) as l, cast(length(p_name) as bigint) as n, substr(p_name, 2, 3) as s, trim('  ' || p_type || ' ') as t,
       replace(p_name, 'a', 'A') as r, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 12, '*') as rp, split_part(p_name, ' ', 1) as sp, cast(position('1' in p_name) as bigint) as pos,
       reverse(p_type) as rv, left(p_name, 2) as lf, right(p_name, 2) as rg, repeat('x', 3) as rep, concat_ws('/', p_brand, p_type) as cw, translate(p_type, 'AO', 'ao') as tr, starts_with(p_type, 'PRO') as sw from part""".replace("starts_with(", "startswith("),
    """
select p_partkey, upper(p_name) as u, lower(p_brand) as l, cast(length(p_name) as bigint) as n, substr(p_name, 2, 3) as s, trim('  ' || p_type || ' ') as t,
       replace(p_name, 'a', 'A') as r, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 12, '*') as rp, split_part(p_name, ' ', 1) as sp, cast(position('1' in p_name) as bigint) as pos,
       reverse(p_type) as rv, left(p_name, 2) as lf, right(p_name, 2) as rg, repeat('x', 3) as rep, concat_ws('/', p_brand, p_type) as cw, translate(p_type, 'AO', 'ao') as tr, starts_with(p_type, 'PRO') as sw from part""")
define("fn_string_more", "select p_partkey, cast(ascii(p_name) as int) as a, chr(65 + cast(p_partkey % 26 as int)) as c, cast(levenshtein(p_type, 'PROMO') as bigint) as d, cast(bit_length(p_name) as bigint) as bl, cast(octet_length(p_name) as bigint) as ol, cast(instr(p_name, '1') as bigint) as i, ltrim('  x') as lt, rtrim('x  ') as rt, lower(hex(p_partkey + 10)) as h from part",
       "select p_partkey, cast(ascii(p_name) as int) as a, chr(65 + cast(p_partkey % 26 as int)) as c, levenshtein(p_type, 'PROMO') as d, cast(bit_length(p_name) as bigint) as bl, cast(octet_length(cast(p_name as blob)) as bigint) as ol, cast(instr(p_name, '1') as bigint) as i, ltrim('  x') as lt, rtrim('x  ') as rt, lower(to_hex(p_partkey + 10)) as h from part")
define("fn_math", "select c_custkey, round(c_acctbal, 1) as r, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c, abs(c_acctbal) as a, round(sqrt(abs(c_acctbal)), 6) as s, round(power(c_custkey % 10, 2), 4) as p, round(ln(c_custkey + 1), 8) as l, round(log10(c_custkey + 1), 8) as l10, round(log2(c_custkey + 1), 8) as l2, cast(sign(c_acctbal) as int) as sg, greatest(c_custkey, 100) as g, least(c_custkey, 100) as le, round(exp(c_custkey % 5), 6) as e, round(pi(), 9) as pi from customer")
define("fn_trig", "select n_nationkey, round(sin(n_nationkey), 9) as s, round(cos(n_nationkey), 9) as c, round(tan(n_nationkey), 9) as t, round(atan(n_nationkey), 9) as at, round(atan2(n_nationkey, 3), 9) as a2, round(asin(n_nationkey / 30e0), 9) as asn, round(acos(n_nationkey / 30e0), 9) as acs, round(sinh(n_nationkey / 10e0), 9) as sh, round(cosh(n_nationkey / 10e0), 9) as ch, round(tanh(n_nationkey / 10e0), 9) as th, round(degrees(n_nationkey), 9) as dg, round(radians(n_nationkey), 9) as rd, round(cbrt(n_nationkey), 9) as cb, cast(factorial(n_nationkey % 10) as bigint) as fc from nation")
define("fn_date", "select o_orderkey, cast(date_part('year', o_orderdate) as bigint) as y, cast(date_part('doy', o_orderdate) as bigint) as d, cast(extract(month from o_orderdate) as bigint) as m, cast(extract(quarter from o_orderdate) as bigint) as q, cast(date_trunc('month', o_orderdate) as date) as mon, cast(cast(o_orderdate as date) + interval '1' year as date) as nxt, cast(cast(o_orderdate as date) - interval '1' month as date) as prv, datediff(cast(o_orderdate as date), cast('1995-01-01' as date)) as days, make_date(1996, 2, 29) as leap from orders",
       "select o_orderkey, cast(date_part('year', o_orderdate) as bigint) as y, cast(date_part('doy', o_orderdate) as bigint) as d, cast(extract(month from o_orderdate) as bigint) as m, cast(extract(quarter from o_orderdate) as bigint) as q, cast(date_trunc('month', o_orderdate) as date) as mon, cast(cast(o_orderdate as date) + interval '1' year as date) as nxt, cast(cast(o_orderdate as date) - interval '1' month as date) as prv, cast(datediff('day', cast('1995-01-01' as date), cast(o_orderdate as date)) as int) as days, make_date(1996, 2, 29) as leap from orders")
define("fn_array", "select vec_id, cast(size(embedding) as bigint) as n, round(element_at(embedding, 1), 4) as first, round(array_max(embedding), 4) as mx, round(array_min(embedding), 4) as mn, array_contains(array(1, 2, label), 3) as has, array_join(slice(array('a', 'b', 'c'), 2, 2), '-') as j, cast(array_position(array(5, 6, label), label) as bigint) as p, cast(size(array_distinct(array(1, 1, label))) as bigint) as dd from embeddings",
       "select vec_id, len(embedding) as n, round(embedding[1], 4) as first, round(list_max(embedding), 4) as mx, round(list_min(embedding), 4) as mn, list_contains([1, 2, label], 3) as has, array_to_string((['a', 'b', 'c'])[2:3], '-') as j, cast(list_position([5, 6, label], label) as bigint) as p, cast(len(list_distinct([1, 1, label])) as bigint) as dd from embeddings")
define("fn_map", "select n_nationkey, map('a', n_nationkey, 'b', n_regionkey)['b'] as b, try_element_at(map('a', n_nationkey), 'z') as missing, cast(size(map_keys(map('a', 1, 'b', 2))) as bigint) as n from nation", "select n_nationkey, map {'a': n_nationkey, 'b': n_regionkey}['b'] as b, map {'a': n_nationkey}['z'] as missing, cast(len(map_keys(map {'a': 1, 'b': 2})) as bigint) as n from nation")
define("fn_regex", "select p_partkey, p_name rlike '^[a-m]' as m, regexp_replace(p_name, '[aeiou]', '_') as r, regexp_extract(p_brand, '([0-9]+)', 1) as d, cast(regexp_count(p_name, 'e') as bigint) as n from part", "select p_partkey, regexp_matches(p_name, '^[a-m]') as m, regexp_replace(p_name, '[aeiou]', '_', 'g') as r, regexp_extract(p_brand, '([0-9]+)', 1) as d, len(regexp_extract_all(p_name, 'e')) as n from part")
define("fn_conditional", "select n_nationkey, nullif(n_regionkey, 2) as a, ifnull(nullif(n_regionkey, 2), -1) as b, coalesce(null, n_name) as c, case n_regionkey when 1 then 'one' when 2 then 'two' else 'many' end as d, if(n_regionkey > 2, 'hi', 'lo') as e from nation")
define("fn_hash", "select p_partkey, md5(p_name) as m, sha2(p_name, 256) as s, base64(cast(p_type as binary)) as b from part", "select p_partkey, md5(p_name) as m, sha256(p_name) as s, to_base64(cast(p_type as blob)) as b from part")
define("fn_json_props", "select event_id, cast(length(props) as bigint) as n, get_json_object(props, '$.k') as k from events", "select event_id, length(props) as n, json_extract_string(props, '$.k') as k from events")
define("fn_bitwise", "select c_custkey, c_custkey & 7 as a, c_custkey | 8 as o, cast(shiftleft(c_custkey, 2) as bigint) as sl, cast(c_custkey ^ 5 as bigint) as x from customer", "select c_custkey, c_custkey & 7 as a, c_custkey | 8 as o, cast(c_custkey << 2 as bigint) as sl, cast(xor(c_custkey, 5) as bigint) as x from customer")
