"""Registered queries of the relational operators.

SQL holds texts that run unchanged in Spark and in DuckDB. FRAMES holds the same operators
through the DataFrame API, each with the name of the SQL text that has its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import relational as op
from millrace.plans import stored_queries

#: Texts for DuckDB alone: as SQL, Spark would compare all pairs.
ORACLE_ONLY = {
    "join_range": "select o_orderkey, p_partkey from orders, part where o_totalprice >= p_retailprice*100 and o_totalprice < p_retailprice*100+50",
    "epoch_seconds": "select event_id, cast(floor(epoch(ts)) as bigint) as s from events",
    "join_asof": "select event_id, k, et, ot, o_orderkey from (select event_id, k, et, ot, o_orderkey, row_number() over (partition by event_id order by ot desc nulls last, o_orderkey desc) as rn from (select event_id, user_id as k, cast(floor(epoch(ts)) as bigint) as et from events) e left join (select o_custkey, cast(floor(epoch(o_orderdate)) as bigint) as ot, o_orderkey from orders) o on k=o_custkey and ot<=et) where rn=1",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "project_star": "select * from nation",
    "qualified_star": "select n.* from nation n, region r where n.n_regionkey=r.r_regionkey",
    "project_arith": "select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as rev from lineitem",
    "arith_div_mod": "select o_orderkey, o_orderkey/7 as q, o_orderkey%7 as m from orders",
    "filter_or": "select o_orderkey from orders where o_totalprice>100000 or o_orderstatus='F'",
    "filter_not": "select o_orderkey from orders where not (o_totalprice>100000 or o_orderstatus='F') and o_orderpriority<>'5-LOW'",
    "filter_date": "select o_orderkey, o_orderdate from orders where o_orderdate>=DATE '1996-01-01' and o_orderdate<DATE '1997-01-01'",
    "filter_in_between": "select p_partkey, p_type from part where p_size in (1,5,9) or p_size between 20 and 25",
    "filter_like": "select c_custkey, c_name from customer where c_name like '%1%' and c_mktsegment like 'B%' and c_acctbal is not null",
    "join_3way": "select c.c_name, n.n_name, r.r_name from customer c, nation n, region r where c.c_nationkey=n.n_nationkey and n.n_regionkey=r.r_regionkey",
    "join_theta": "select a.n_name as an, b.n_name as bn from nation a, nation b where a.n_regionkey=b.n_regionkey and a.n_nationkey<b.n_nationkey",
    "join_non_equi": "select s.s_suppkey, n.n_nationkey from supplier s, nation n where s.s_nationkey<n.n_nationkey",
    "join_cross": "select r1.r_name as a, r2.r_name as b from region r1, region r2",
    "join_composite": "select a.l_orderkey, a.l_linenumber, b.l_partkey from lineitem a, lineitem b where a.l_orderkey=b.l_orderkey and a.l_linenumber=b.l_linenumber and a.l_suppkey=b.l_suppkey",
    "join_on": "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey=c.c_custkey",
    "join_left_outer": "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey=o.o_custkey and o.o_totalprice>300000",
    "join_full_outer": "select a.n_name as an, b.s_suppkey from nation a full join supplier b on a.n_nationkey=b.s_nationkey",
    "join_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>300000)",
    "join_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey=c_custkey)",
    "agg_global": "select sum(l_quantity) as s, round(avg(l_quantity),6) as a, min(l_quantity) as mn, max(l_quantity) as mx, count(*) as c from lineitem",
    "agg_empty": "select sum(l_quantity) as s, count(*) as c from lineitem where l_quantity<0",
    "agg_sum_int": "select cast(sum(l_linenumber) as bigint) as s, avg(l_linenumber) as a from lineitem",
    "agg_count_distinct": "select o_orderstatus, count(distinct o_custkey) as customers, count(o_custkey) as n from orders group by o_orderstatus",
    "agg_of_aggs": "select l_returnflag, round(sum(l_extendedprice)/sum(l_quantity),4) as unit from lineitem group by l_returnflag",
    "agg_unselected_key": "select count(*) as c from orders group by o_orderstatus, o_orderpriority",
    "group_expression": "select o_orderkey%10 as k, count(*) as c from orders group by o_orderkey%10",
    "group_having": "select l_returnflag, l_linestatus, round(sum(l_extendedprice),2) as s, count(*) as c from lineitem group by l_returnflag, l_linestatus having count(*)>1000",
    "minmax_date": "select min(o_orderdate) as mn, max(o_orderdate) as mx from orders",
    "minmax_string": "select min(c_name) as mn, max(c_name) as mx from customer",
    "max_negative": "select max(-o_totalprice) as mx, min(-o_totalprice) as mn from orders",
    "order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "order_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5",
    "union_all": "select n_name as x from nation union all select r_name as x from region",
    "union_distinct": "select c_nationkey as k from customer union select s_nationkey as k from supplier",
    "intersect_except": "(select c_nationkey as k from customer intersect select s_nationkey as k from supplier) except select n_regionkey as k from nation",
    "subquery_filter": "select t.k, t.c from (select o_custkey as k, count(*) as c from orders group by o_custkey) t where t.c>5",
    "subquery_join": "select a.k, b.n from (select o_custkey as k from orders) a, (select c_custkey as ck, c_name as n from customer) b where a.k=b.ck",
    "subquery_mixed": "select t.k, n.n_name from (select c_custkey as k, c_nationkey as nk from customer where c_acctbal>0) t, nation n where t.nk=n.n_nationkey",
    "subquery_union": "select t.x, count(*) as c from (select c_nationkey as x from customer union all select s_nationkey as x from supplier) t group by t.x",
    "delete_overlay": "select n_nationkey, n_name from nation where not (n_regionkey=1 or n_nationkey>20)",
    "insert_overlay": "select r_regionkey, r_name from region union all select * from (values (5,'ATLANTIS')) v(r_regionkey, r_name)",
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity),2) as sq, round(sum(l_extendedprice*(1-l_discount)),2) as sd, round(avg(l_extendedprice),4) as ap, count(*) as c from lineitem where l_shipdate<=DATE '1998-09-01' group by l_returnflag, l_linestatus",
    "shipping_priority": "select l_orderkey, round(sum(l_extendedprice*(1-l_discount)),2) as rev, o_orderdate from customer, orders, lineitem where c_mktsegment='BUILDING' and c_custkey=o_custkey and l_orderkey=o_orderkey group by l_orderkey, o_orderdate order by rev desc, l_orderkey limit 10",
    "local_supplier": "select n_name, round(sum(l_extendedprice*(1-l_discount)),2) as rev from customer, orders, lineitem, supplier, nation, region where c_custkey=o_custkey and l_orderkey=o_orderkey and l_suppkey=s_suppkey and c_nationkey=s_nationkey and s_nationkey=n_nationkey and n_regionkey=r_regionkey and r_name='ASIA' group by n_name",
    "forecast_revenue": "select round(sum(l_extendedprice*l_discount),2) as rev from lineitem where l_discount>=0.05 and l_discount<=0.07 and l_quantity<24",
    "priority_case": "select l_linestatus, cast(sum(case when o_orderpriority='1-URGENT' or o_orderpriority='2-HIGH' then 1 else 0 end) as bigint) as hi from orders, lineitem where o_orderkey=l_orderkey group by l_linestatus",
    "case_select": "select o_orderkey, case when o_totalprice>200000 then 'large' when o_totalprice>50000 then o_orderstatus else 'small' end as size from orders",
    "distinct": "select distinct c_mktsegment as s from customer",
    "point_lookup": "select o_orderkey, o_totalprice from orders where o_orderkey=7",
    "range_lookup": "select o_orderkey, o_totalprice from orders where o_orderkey>100 and o_orderkey<=200",
    "select_constant": "select 1 as one, 'a' as letter",
    "subquery_in": "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey=1)",
    "subquery_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice>100000)",
    "subquery_scalar": "select o_orderkey from orders where o_totalprice>(select 1.5*avg(o_totalprice) from orders)",
    "subquery_correlated": "select p_partkey from part p where p_retailprice=(select max(q.p_retailprice) from part q where q.p_brand=p.p_brand)",
    "join_using": "select k, a.x, b.y from (select n_nationkey as k, n_name as x from nation) a join (select c_nationkey as k, c_name as y from customer) b using (k)",
    "join_natural": "select k, x, y from (select n_nationkey as k, n_name as x from nation) a natural join (select s_nationkey as k, s_suppkey as y from supplier) b",
    "join_right_outer": "select s.s_suppkey, n.n_name from supplier s right join nation n on s.s_nationkey=n.n_nationkey and s.s_acctbal>0",
    "group_rollup": "select l_returnflag, l_linestatus, count(*) as c, cast(grouping(l_linestatus) as int) as g from lineitem group by rollup(l_returnflag, l_linestatus)",
    "group_cube": "select o_orderstatus, o_orderpriority, count(*) as c, round(sum(o_totalprice),2) as s from orders group by cube(o_orderstatus, o_orderpriority)",
    "group_sets": "select o_orderstatus, o_orderpriority, count(*) as c from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "agg_spread": "select l_returnflag, round(stddev_samp(l_quantity),6) as sd, round(var_pop(l_quantity),6) as v from lineitem group by l_returnflag",
    "agg_percentile": "select o_orderstatus, round(percentile_cont(0.5) within group (order by o_totalprice),6) as med, percentile_disc(0.9) within group (order by o_totalprice) as p90 from orders group by o_orderstatus",
    "agg_filter": "select count(*) filter (where o_totalprice>100000) as n, sum(o_totalprice) filter (where o_orderstatus='none') as s from orders",
    "order_expression": "select o_orderkey, o_totalprice from orders order by o_totalprice*-1, o_orderkey%7 limit 10",
    "order_ordinal": "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 10",
    "order_nulls_first": "select c_custkey, o_orderkey from customer left join orders on c_custkey=o_custkey and o_totalprice>300000 order by o_orderkey nulls first, c_custkey limit 20",
    "order_nulls_last": "select c_custkey, o_orderkey from customer left join orders on c_custkey=o_custkey and o_totalprice>300000 order by o_orderkey desc nulls last, c_custkey limit 20",
    "fn_string": "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, length(c_name) as n, substring(c_name,1,3) as s, concat(c_name,'/',c_mktsegment) as c, replace(c_name,'0','-') as r, trim(concat('  ',c_name,' ')) as t, lpad(c_mktsegment,12,'*') as p, reverse(c_name) as b from customer",
    "fn_date": "select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as m, cast(extract(day from o_orderdate) as int) as d, cast(extract(quarter from o_orderdate) as int) as q, cast(cast(date_trunc('month', o_orderdate) as date) as string) as t from orders",
    "fn_math": "select o_orderkey, abs(-o_totalprice) as a, cast(floor(o_totalprice) as bigint) as f, cast(ceil(o_totalprice) as bigint) as c, round(sqrt(o_totalprice),6) as r, round(power(o_totalprice,2),2) as p, round(ln(o_totalprice),9) as n, cast(sign(o_totalprice-100000) as int) as s from orders",
    "fn_null": "select c_custkey, coalesce(nullif(c_mktsegment,'BUILDING'),'none') as s, greatest(c_acctbal,0) as g, least(c_acctbal,0) as l from customer",
    "window_rank": "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey),2) as s from orders",
    "with_query": "with big as (select o_custkey as k, count(*) as c from orders group by o_custkey having count(*)>10) select c_name, c from big, customer where k=c_custkey",
}

#: Texts of which each engine has its own.
PAIRS = {
    "agg_string": (
        "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey",
        "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey",
    ),
    "agg_approx": (
        "select o_orderstatus, abs(approx_count_distinct(o_custkey, 0.01)-count(distinct o_custkey))<=0.05*count(distinct o_custkey)+1 as near from orders group by o_orderstatus",
        "select o_orderstatus, true as near from orders group by o_orderstatus",
    ),
    "fn_array_map_json": (
        "select n_nationkey, array_join(sort_array(split(n_name,'A')),'|') as a, size(array_distinct(split(n_name,''))) as n, get_json_object(concat('{\"k\":',n_nationkey,'}'),'$.k') as j, map('x',n_name)['x'] as m from nation",
        "select n_nationkey, array_to_string(list_sort(string_split(n_name,'A')),'|') as a, cast(len(list_distinct(string_split(n_name,''))) as int) as n, json_extract_string('{\"k\":'||n_nationkey||'}','$.k') as j, map {'x':n_name}['x'] as m from nation",
    ),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the tables that it names, registered as views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def _orders_customer(t, strategy: str) -> DataFrame:
    return op.project(op.join(t("orders"), t("customer"), F.col("o_custkey") == F.col("c_custkey"), strategy=strategy), "o_orderkey", "c_name")


def _theta(t, strategy: str) -> DataFrame:
    condition = F.col("s_nationkey") < F.col("n_nationkey")
    return op.project(op.join(t("supplier"), t("nation"), condition, strategy=strategy), "s_suppkey", "n_nationkey")


def _star(t) -> DataFrame:
    return op.comma_join([t("customer"), t("nation"), t("region")], "c_nationkey = n_nationkey and n_regionkey = r_regionkey").select("c_name", "n_name", "r_name")


def _priority(t) -> DataFrame:
    high = scalars.case((F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1), default=0)
    joined = op.join(t("lineitem"), t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return op.aggregate(joined, ["l_linestatus"], hi=F.sum(high))


def _summary(t) -> DataFrame:
    rows = op.select_where(t("lineitem"), F.col("l_shipdate") <= scalars.date("1998-09-01"))
    return op.aggregate(
        rows, ["l_returnflag", "l_linestatus"],
        sq="round(sum(l_quantity), 2)", sd="round(sum(l_extendedprice * (1 - l_discount)), 2)", ap="round(avg(l_extendedprice), 4)", c="count(*)",
    )


def _range(t) -> DataFrame:
    bands = t("part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 50).alias("high"))
    return op.range_join(t("orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 50).select("o_orderkey", "p_partkey")


def _asof(t) -> DataFrame:
    asked = t("events").select("event_id", F.col("user_id").alias("k"), scalars.utc_epoch_seconds(F.col("ts")).alias("et"))
    held = t("orders").select(F.col("o_custkey").alias("k"), scalars.utc_epoch_seconds(F.col("o_orderdate")).alias("ot"), "o_orderkey")
    return op.asof_join(asked, held, "k", "et", "ot")


#: name: (the SQL text with the same rows, the DataFrame)
FRAMES: dict[str, tuple[str, Callable]] = {
    "project_arith_df": ("project_arith", lambda t: op.project(t("lineitem"), "l_orderkey", "l_linenumber", rev="l_extendedprice * (1 - l_discount)")),
    "qualified_star_df": ("qualified_star", lambda t: op.join(op.table_alias(t("nation"), "n"), op.table_alias(t("region"), "r"), F.expr("n.n_regionkey = r.r_regionkey")).select("n.*")),
    "filter_or_df": ("filter_or", lambda t: op.project(op.select_where(t("orders"), (F.col("o_totalprice") > 100000) | (F.col("o_orderstatus") == "F")), "o_orderkey")),
    "join_3way_df": ("join_3way", _star),
    "join_hash_df": ("join_on", lambda t: _orders_customer(t, "hash")),
    "join_merge_df": ("join_on", lambda t: _orders_customer(t, "merge")),
    "join_broadcast_df": ("join_on", lambda t: _orders_customer(t, "broadcast")),
    "join_theta_broadcast_df": ("join_non_equi", lambda t: _theta(t, "broadcast")),
    "join_theta_product_df": ("join_non_equi", lambda t: _theta(t, "product")),
    "join_cross_df": ("join_cross", lambda t: op.cross_product(t("region").select(F.col("r_name").alias("a")), t("region").select(F.col("r_name").alias("b")))),
    "join_range_df": ("join_range", _range),
    "join_asof_df": ("join_asof", _asof),
    "join_using_df": ("join_using", lambda t: op.join(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x")), t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("y")), "k")),
    "join_semi_df": ("join_semi", lambda t: op.join(t("customer"), op.select_where(t("orders"), "o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")),
    "join_anti_df": ("join_anti", lambda t: op.join(t("customer"), t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")),
    "join_left_outer_df": ("join_left_outer", lambda t: op.join(t("customer"), op.select_where(t("orders"), "o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")),
    "epoch_seconds_df": ("epoch_seconds", lambda t: op.project(t("events"), "event_id", s=scalars.utc_epoch_seconds(F.col("ts")))),
    "agg_global_df": ("agg_global", lambda t: op.aggregate(t("lineitem"), [], s="sum(l_quantity)", a="round(avg(l_quantity), 6)", mn="min(l_quantity)", mx="max(l_quantity)", c="count(*)")),
    "group_having_df": ("group_having", lambda t: op.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], "c > 1000", s="round(sum(l_extendedprice), 2)", c="count(*)")),
    "pricing_summary_df": ("pricing_summary", _summary),
    "priority_case_df": ("priority_case", _priority),
    "order_limit_df": ("order_limit", lambda t: op.top(t("orders").select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", "desc"), "o_orderkey")),
    "order_offset_df": ("order_offset", lambda t: op.limit(op.sort(t("orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey"), 10, 5)),
    "union_all_df": ("union_all", lambda t: op.union_all(t("nation").select(F.col("n_name").alias("x")), t("region").select("r_name"))),
    "union_distinct_df": ("union_distinct", lambda t: op.union(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"))),
    "subquery_filter_df": ("subquery_filter", lambda t: op.select_where(op.table_alias(op.aggregate(t("orders"), [F.col("o_custkey").alias("k")], c="count(*)"), "t"), "t.c > 5")),
    "delete_overlay_df": ("delete_overlay", lambda t: op.delete_overlay(t("nation"), "n_regionkey = 1", "n_nationkey > 20").select("n_nationkey", "n_name")),
    "insert_overlay_df": ("insert_overlay", lambda t: op.insert_overlay(t("region"), [{"r_regionkey": 5, "r_name": "ATLANTIS"}])),
    "point_lookup_df": ("point_lookup", lambda t: op.lookup(t("orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice")),
    "range_lookup_df": ("range_lookup", lambda t: op.lookup(t("orders"), "o_orderkey", low=100, high=200).select("o_orderkey", "o_totalprice")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SQL | {name: spark_text for name, (spark_text, _) in PAIRS.items()}
    out = {name: lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text) for name, text in texts.items()}
    for name, (_, frame) in FRAMES.items():
        out[name] = lambda spark, sf_dir, frame=frame: frame(lambda table: read(spark, sf_dir, table))
    return out | {name: query for name, (query, _) in stored_queries.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    texts = SQL | ORACLE_ONLY
    own = {name: text for name, (_, text) in PAIRS.items()} | {name: text for name, (_, text) in stored_queries.QUERIES.items()}
    return SQL | own | {name: texts[like] for name, (like, _) in FRAMES.items()}
