"""Registered queries over declared tables: statements, text files, stored layouts and their lookups and joins.

Each lays tables of sf_dir out in a working folder that all executors share, as a user of the
session would, and returns what is read back. Oracles say the same over the original tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as op
from millrace.session import Session
from millrace.sources import columnar, files
from millrace.sources.pipe import read_pipe, write_pipe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session(spark: SparkSession, sf_dir: str, **options) -> Session:
    """A session over text files NATIONS and SUPPLIERS, both declared."""
    folder = files.work_folder(spark, "statements")
    write_pipe(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{folder}/data/NATIONS.csv")
    write_pipe(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{folder}/data/SUPPLIERS.csv")
    session = Session(spark, f"{folder}/data", f"{folder}/store", **options)
    session.script("CREATE TABLE NATIONS (A int, B string, C int, PRIMARY KEY(A), INDEX(C)); CREATE TABLE SUPPLIERS (A int, B varchar(25), C int, D decimal(12,2), PRIMARY KEY (A));")
    return session


CHANGES = """
INSERT INTO NATIONS(A, B, C) VALUES (100, 'ATLANTIS', 1);
INSERT INTO NATIONS(A, B, C) VALUES (101, 'LEMURIA', 3), (102, 'MU; "(lost)"', NULL);
DELETE FROM NATIONS WHERE C = 3;
INSERT INTO NATIONS(B, A, C) VALUES ('LEMURIA', 101, 3);
UPDATE NATIONS SET B = concat(B, ' ('), C = C + 10 WHERE A > 20 AND B <> 'where (';
DELETE FROM NATIONS WHERE C = 1;
"""
#: What CHANGES leave of nation.
CHANGED = """
select A, case when A>20 then B||' (' else B end as B, case when A>20 then C+10 else C end as C from (
  select n_nationkey as A, n_name as B, n_regionkey as C from nation where n_regionkey<>3
  union all select 100, 'ATLANTIS', 1 union all select 102, 'MU; "(lost)"', null union all select 101, 'LEMURIA', 3
) where A>20 or C<>1
"""
SELECTED = "select A, B, C from NATIONS"


def _create(spark, sf_dir):
    return _session(spark, sf_dir).execute(SELECTED)


def _changes(spark, sf_dir):
    session = _session(spark, sf_dir)
    session.script(CHANGES)
    return session.execute(SELECTED)


def _compacted(spark, sf_dir):
    """The log is folded into stored versions on the way; a result from before the last fold still reads its own."""
    session = _session(spark, sf_dir, compact_after=2)
    session.script(CHANGES)
    return session.execute(SELECTED)


def _reloaded(spark, sf_dir):
    """A new session over the stored catalog."""
    session = _session(spark, sf_dir, compact_after=3)
    session.script(CHANGES)
    return Session(spark, session.data_dir, session.store_dir).execute(SELECTED)


def _statement_join(spark, sf_dir):
    session = _session(spark, sf_dir)
    session.execute("DELETE FROM SUPPLIERS WHERE D < 0")
    return session.execute("select N.B as nation, count(*) as n, round(sum(S.D),2) as s from SUPPLIERS S, NATIONS N where S.C=N.A group by N.B having count(*)>1")


def _sink(spark, sf_dir):
    """Rows written as text and read again: doubles, dates, nulls and marks survive."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("l_shipdate"), F.when(F.col("l_linenumber") > 3, F.lit('a "b')).alias("note"))
    out = files.work_folder(spark, "sink")
    write_pipe(rows, out)
    return read_pipe(spark, out, rows.schema).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def _stored(spark, sf_dir) -> DataFrame:
    """orders, ranged and sorted by its key, with a bloom filter on the customer."""
    return columnar.store(_table(spark, sf_dir, "orders"), files.work_folder(spark, "stored"), ["o_orderkey"], ["o_custkey"])


def _bucketed(spark, df: DataFrame, key: str) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    return columnar.store_bucketed(df, name, key, 8, path=files.work_folder(spark, name))


def _bucketed_join(spark, sf_dir, how: str = "inner"):
    orders = _bucketed(spark, _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    customers = _bucketed(spark, _table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return op.join(customers, orders, F.col("o_custkey") == F.col("c_custkey"), how, "merge").select("o_orderkey", "c_name")


def _lookup_join(spark, sf_dir):
    """A few rows against a stored table by its key: the small side's keys prune the scan."""
    few = op.select_where(_table(spark, sf_dir, "lineitem"), "l_quantity = 50 and l_discount = 0.1").select("l_orderkey", "l_linenumber")
    return op.join(_stored(spark, sf_dir), few, F.col("o_orderkey") == F.col("l_orderkey"), strategy="broadcast").select("l_orderkey", "l_linenumber", "o_totalprice")


def _range_index_join(spark, sf_dir):
    bands = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 40).alias("low"), (F.col("n_nationkey") * 41 + 3).alias("high"))
    return op.range_join(_stored(spark, sf_dir).select("o_orderkey"), bands, "o_orderkey", "low", "high", 16).select("n_nationkey", "o_orderkey")


_ORDERS = "select o_orderkey, o_totalprice from orders where "
#: name: (the query, its oracle)
QUERIES = {
    "statement_create_scan": (_create, "select n_nationkey as A, n_name as B, n_regionkey as C from nation"),
    "statement_changes": (_changes, CHANGED),
    "statement_compaction": (_compacted, CHANGED),
    "statement_reload": (_reloaded, CHANGED),
    "statement_join": (_statement_join, "select n_name as nation, count(*) as n, round(sum(s_acctbal),2) as s from supplier, nation where s_nationkey=n_nationkey and not s_acctbal<0 group by n_name having count(*)>1"),
    "sink_pipe": (_sink, "select l_orderkey, l_linenumber, l_extendedprice, l_returnflag, cast(cast(l_shipdate as date) as string) as l_shipdate, case when l_linenumber>3 then 'a \"b' end as note from lineitem"),
    "stored_scan": (lambda spark, sf_dir: _stored(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice"), "select o_orderkey, o_custkey, o_totalprice from orders"),
    "stored_point_lookup": (lambda spark, sf_dir: op.lookup(_stored(spark, sf_dir), "o_orderkey", 7).select("o_orderkey", "o_totalprice"), _ORDERS + "o_orderkey=7"),
    "stored_range_lookup": (lambda spark, sf_dir: op.lookup(_stored(spark, sf_dir), "o_orderkey", low=100, high=200).select("o_orderkey", "o_totalprice"), _ORDERS + "o_orderkey>100 and o_orderkey<=200"),
    "stored_open_range_lookup": (lambda spark, sf_dir: op.lookup(_stored(spark, sf_dir), "o_orderkey", low=1000).select("o_orderkey", "o_totalprice"), _ORDERS + "o_orderkey>1000"),
    "stored_index_lookup": (lambda spark, sf_dir: op.lookup(_stored(spark, sf_dir), "o_custkey", 11).select("o_orderkey", "o_totalprice"), _ORDERS + "o_custkey=11"),
    "stored_lookup_join": (_lookup_join, "select l_orderkey, l_linenumber, o_totalprice from lineitem, orders where l_orderkey=o_orderkey and l_quantity=50 and l_discount=0.1"),
    "stored_range_join": (_range_index_join, "select n_nationkey, o_orderkey from nation, orders where o_orderkey>=n_nationkey*40 and o_orderkey<n_nationkey*41+3"),
    "bucketed_join": (_bucketed_join, "select o_orderkey, c_name from orders, customer where o_custkey=c_custkey"),
    "bucketed_outer_join": (lambda spark, sf_dir: _bucketed_join(spark, sf_dir, "left"), "select o_orderkey, c_name from customer left join orders on o_custkey=c_custkey"),
}
