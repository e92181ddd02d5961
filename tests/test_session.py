"""The statement path on small star tables: declare, query, change, print."""

import datetime
import io

import pytest

from millrace.plans.statements import CreateTable, Delete, Insert, StatementError, Update, parse, split_statements
from millrace.repl import repl
from millrace.session import Session
from millrace.sources import files
from millrace.sources.pipe import lines

P = "1|Automobile\n2|Furniture\n3|Automobile\n4|Carpets\n5|Automobile\n6|Furniture\n7|Automobile\n8|Automobile"
Q = "11|1994-02-25|3\n12|1995-05-01|2\n13|1994-03-01|3\n14|1994-02-25|5\n15|1993-05-07|7\n16|1993-05-07|8\n17|1998-02-02|2\n18|1994-05-01|1\n19|1994-05-01|2\n20|1994-05-01|3"
R = (
    "111|1996-02-25|1|5.77|11\n112|1996-02-25|2|10.77|12\n113|1996-02-25|3|24.99|13\n114|1996-02-25|4|34.5156|11\n115|1998-02-25|5|34.56|20\n116|1998-02-25|6|23456.989|15\n"
    "117|1992-07-25|7|123.234|16\n118|1992-02-25|8|233.443|17\n119|1993-02-25|5|34.5326|11\n120|1994-02-25|6|234526.989|14\n121|1995-07-25|7|1113223.234|13\n122|1996-02-25|8|233.32443|15"
)
DDL = """
CREATE TABLE P (A int, B string, PRIMARY KEY(A));
CREATE TABLE Q (A int, B date, C int, PRIMARY KEY(A));
CREATE TABLE R (A int, B date, C int, D decimal, E int, PRIMARY KEY(A), INDEX c_idx (C));
"""


@pytest.fixture
def session(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name, text in (("P", P), ("Q", Q), ("R", R)):
        (tmp_path / "data" / f"{name}.csv").write_text(text)
    s = Session(spark, str(tmp_path / "data"), str(tmp_path / "store"))
    s.script(DDL)
    return s


def rows(session, text):
    return [tuple(r) for r in session.execute(text).collect()]


def test_star_queries(session):
    assert rows(session, "select P.B, count(*) as n, round(sum(R.D),4) as s from R, P where R.C=P.A group by P.B order by P.B") == [
        ("Automobile", 8, 1113913.088), ("Carpets", 1, 34.5156), ("Furniture", 3, 257994.748),
    ]
    day = datetime.date
    assert rows(session, "select P.B, Q.B as qb, R.D from R, Q, P where R.E=Q.A and Q.C=P.A and R.B>=DATE('1996-01-01') order by R.D desc limit 3") == [
        ("Automobile", day(1993, 5, 7), 23456.989), ("Automobile", day(1993, 5, 7), 233.32443), ("Automobile", day(1994, 5, 1), 34.56),
    ]
    assert rows(session, "select min(B), max(B), min(D), max(D), avg(C) from R") == [(day(1992, 2, 25), day(1998, 2, 25), 5.77, 1113223.234, 31 * 2 / 12)]
    assert rows(session, "select A from R where not (C=5) and D>100 order by A") == [(n,) for n in (116, 117, 118, 120, 121, 122)]


def test_stars_aliases_and_groups(session):
    assert session.execute("select * from P").count() == 8
    assert session.execute("select x.* from P x, Q y where x.A = y.C").columns == ["A", "B"]
    assert session.execute("select x.A as a1 from P x, P y").count() == 64
    # A last group of one row stays; a group key needn't be selected; aggregates of one argument stay apart.
    assert rows(session, "select A, count(*) from P group by A order by A")[-1] == (8, 1)
    assert session.execute("select count(*) from R group by C").count() == 8
    assert rows(session, "select sum(A) as s, avg(A) as m from P having sum(A) > 30") == [(36, 4.5)]
    assert rows(session, "select max(-D) as m from R") == [(-5.77,)]
    assert rows(session, "select R.A as x, count(*) as n from R group by R.A order by x limit 1") == [(111, 1)]


def test_changes_keep_their_order(session):
    session.execute("INSERT INTO P(A, B) VALUES (9, 'Carpets')")
    assert rows(session, "select count(*) from P") == [(9,)]
    session.execute("DELETE FROM P WHERE A=9")
    assert rows(session, "select count(*) from P") == [(8,)]
    session.execute("INSERT INTO P(B, A) VALUES ('Toys', 9), ('Toys; \"and\" (more)', 10)")
    assert rows(session, "select B from P where A>8 order by A") == [("Toys",), ('Toys; "and" (more)',)]
    session.execute("INSERT INTO P(A) VALUES (11)")
    session.execute("DELETE FROM P WHERE B = 'Toys'")  # null decides nothing: 11 stays
    assert rows(session, "select A, B from P where A>8 order by A") == [(10, 'Toys; "and" (more)'), (11, None)]
    session.execute("UPDATE P SET B = concat(B, '!'), A = A + 100 WHERE P.A in (1, 2) and B <> 'a where b'")
    assert rows(session, "select A, B from P where A>100 order by A") == [(101, "Automobile!"), (102, "Furniture!")]
    session.execute("INSERT INTO Q(A, B, C) VALUES (21, DATE('2000-01-02'), -3)")
    assert rows(session, "select B, C from Q where A=21") == [(datetime.date(2000, 1, 2), -3)]
    session.execute("DELETE FROM P")
    assert rows(session, "select count(*), sum(A) from P") == [(0, None)]


def test_compaction_and_reload(session, spark):
    session.execute("INSERT INTO P(A, B) VALUES (9, 'Carpets')")
    session.execute("DELETE FROM P WHERE A < 3")
    session.compact("P")
    again = Session(spark, session.data_dir, session.store_dir)
    assert rows(again, "select count(*), min(A), max(A) from P") == [(7, 3, 9)]
    assert again.catalog["p"].primary_key == ("A",) and again.catalog["r"].indexes == ("C",)
    again.compact_after = 2
    again.execute("INSERT INTO P(A, B) VALUES (12, 'x')")
    again.execute("DELETE FROM P WHERE A=12")
    assert again.catalog["P"].version == 2 and rows(again, "select count(*) from P") == [(7,)]


def test_inserts_count_towards_compaction(session):
    session.compact_after = 5
    for k in range(12):
        session.execute(f"INSERT INTO P(A, B) VALUES ({100 + k}, 'x')")
    assert session.catalog["P"].version == 2 and len(session.logs["p"]) == 2
    assert rows(session, "select count(*) from P where A>=100") == [(12,)]


def test_results_outlive_a_compaction(session, spark):
    before = session.execute("select count(*) as n from P")
    session.execute("DELETE FROM P WHERE A=1")
    session.compact("P")
    assert before.collect()[0]["n"] == 8 and rows(session, "select count(*) from P") == [(7,)]
    session.compact("P")
    again = Session(spark, session.data_dir, session.store_dir)
    assert again.catalog["P"].previous.endswith("v1") and rows(again, "select count(*) from P") == [(7,)]


def test_the_catalog_is_replaced_in_one_step(session, spark, tmp_path):
    path = str(tmp_path / "x.json")
    for text in ("one", "two"):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert not files.exists(spark, path + ".new")


def test_errors_leave_tables_alone(session):
    for bad in ("DROP TABLE P", "EXPLAIN select 1", "CREATE TABLE P (A int)", "CREATE TABLE Z (A blob)", "CREATE TABLE Z (A int, PRIMARY KEY(B))", "INSERT INTO P(A, Z) VALUES (1, 2)", "INSERT INTO P(A) VALUES (1, 2)", "INSERT INTO nope(A) VALUES (1)", "UPDATE P SET Z = 1"):
        with pytest.raises(ValueError):
            session.execute(bad)
    with pytest.raises(Exception):
        session.execute("DELETE FROM P WHERE nothing = 1")
    assert rows(session, "select count(*) from P") == [(8,)]


def test_odd_text_files(spark, tmp_path):
    (tmp_path / "T.csv").write_text('1|a "b|2.5\n2||\n3\n')
    s = Session(spark, str(tmp_path), str(tmp_path / "store"))
    s.execute("CREATE TABLE T (A int, B varchar(10) NOT NULL, C decimal(10,2))")
    assert rows(s, "select * from T order by A") == [(1, 'a "b', 2.5), (2, None, None), (3, None, None)]
    s.execute("CREATE TABLE E (A int)")
    assert rows(s, "select count(*) from E") == [(0,)]


def test_prompt(session):
    out, err = io.StringIO(), io.StringIO()
    source = io.StringIO("select A, B from P\nwhere A<3 order by A; select nope from P;\nselect count(*) from Q;\n-- the last one\nselect min(A) from Q")
    repl(session, source, out, err)
    assert out.getvalue().replace("$> ", "") == "1|Automobile\n2|Furniture\n\n10\n\n11\n\n"
    assert err.getvalue().startswith("error: ")
    assert list(lines(session.execute("select B, A as B, cast(null as int) from P where A=4"))) == ["Carpets|4|"]


def test_parsing():
    assert split_statements("a; 'x;y' b; -- c; d\n e") == (["a", "'x;y' b"], " -- c; d\n e")
    made = parse("create table T (A int primary key, B char(3), index(B))")
    assert isinstance(made, CreateTable) and made.primary_key == ("A",) and made.indexes == ("B",)
    assert parse("delete from T") == Delete("T", None)
    assert parse("insert into T values (1, '), (')") == Insert("T", (), "(1, '), (')")
    assert parse("update T set a = (select max(b) from U where c = 1), d = 'where' where e = 2") == Update("T", (("a", "(select max(b) from U where c = 1)"), ("d", "'where'")), "e = 2")
    assert parse("UPDATE t SET a='(' WHERE b=1") == Update("t", (("a", "'('"),), "b=1")
    assert parse("UPDATE t SET a=b.somewhere, c=')' -- where\n WHERE x in (select 1 where 2)") == Update("t", (("a", "b.somewhere"), ("c", "')' -- where")), "x in (select 1 where 2)")
    assert parse("UPDATE t SET elsewhere = 1") == Update("t", (("elsewhere", "1"),), None)
    with pytest.raises(StatementError):
        parse("alter table T")
