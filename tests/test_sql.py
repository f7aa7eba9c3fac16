import pytest

from rulespark.sql import Database, SqlError, spark_type, split_list


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_types_of_dialects():
    names = {"varchar(36)": "string", "Character Varying": "string", "INTEGER": "int", "bigint": "bigint", "double precision": "double", "integer array": "array<int>", "array(varchar)": "array<string>", "boolean": "boolean", "decimal(10,2)": "decimal(10,2)"}
    assert {k: spark_type(k) for k in names} == names
    assert split_list("a, f(b, c), 'x,y'") == ["a", "f(b, c)", "'x,y'"]


def test_tables_views_indexes_and_changes(spark):
    db = Database(spark)
    db.execute("create table hosts (id varchar(36) with (primary_key = true), capacity integer, up boolean)")
    db.execute("create view good_hosts as select distinct id, capacity from hosts where capacity < 10")
    db.execute("create view ids as select distinct good_hosts.id from good_hosts")
    db.execute("create index by_up on hosts (up)")
    db.execute("insert into hosts values ('n1', 1, true), ('n2', 20, false)")
    db.execute("insert into hosts (id, capacity) values ('n3', 3)")
    assert rows(db.execute("select * from good_hosts")) == [("n1", 1), ("n3", 3)]
    with pytest.raises(SqlError):
        db.execute("insert into hosts values ('n1', 2, true)")
    db.execute("update hosts set capacity = capacity + 1, up = true where id = 'n2' or up is null")
    assert rows(db.lookup("by_up", True)) == [("n1", 1, True), ("n2", 21, True), ("n3", 4, True)]
    db.execute("delete from hosts where id = 'n1'")
    assert rows(db.execute("select * from ids")) == [("n3",)]
    db.execute("delete from hosts")
    assert rows(db.execute("select count(*) from hosts")) == [(0,)]
    for bad in ("create table hosts (a int)", "create view ids as select 1", "insert into ids values ('x')", "create index i on nothing (a)", "insert into hosts values (1)"):
        with pytest.raises(SqlError):
            db.execute(bad)


def test_names_in_text_stay(spark):
    db = Database(spark)
    db.register("t", spark.createDataFrame([(1, "t")], "t long, s string"))
    assert rows(db.execute("select t.t, s from t where s = 'from t'  or s = 't'")) == [(1, "t")]


def test_databases_are_apart(spark):
    a, b = Database(spark), Database(spark)
    a.execute("create table x (k integer)")
    b.execute("create table x (k integer)")
    a.execute("insert into x values (1)")
    assert rows(b.execute("select * from x")) == []


NOT_IN = ["k NOT IN ({s})", "NOT k IN ({s})", "NOT (k IN ({s}) OR k = 2)", "k + 1 NOT IN ({s})", "k = 1 OR k NOT IN ({s})", "NOT (k NOT IN ({s}))", "(k NOT IN ({s})) IS NULL", "CASE WHEN k > 1 THEN k ELSE 0 END NOT IN ({s}) AND k > 0"]
VALUES = ["SELECT v FROM b", "SELECT v FROM b WHERE v IS NOT NULL", "SELECT v FROM b WHERE v > 100", "WITH w AS (SELECT v FROM b) SELECT v FROM w WHERE v NOT IN (SELECT k FROM a WHERE k > 2)"]


@pytest.mark.parametrize("condition", NOT_IN)
def test_negated_in_broadcasts_nothing_and_knows_nulls(spark, condition):
    import duckdb

    db, con = Database(spark), duckdb.connect()
    for name, column, values in (("a", "k", [1, 2, 3, 4, None]), ("b", "v", [2, 3, 3, 7, None])):
        db.register(name, spark.createDataFrame([(v,) for v in values], f"{column} long"))
        con.execute(f"CREATE TABLE {name} ({column} BIGINT)")
        con.executemany(f"INSERT INTO {name} VALUES (?)", [(v,) for v in values])
    for values in VALUES:
        sql = f"SELECT k FROM a WHERE {condition.format(s=values)}"
        made = db.execute(sql)
        assert sorted(made.collect(), key=str) == sorted(con.execute(sql).fetchall(), key=str), sql
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "OR isnull(" not in plan, sql


def test_not_in_elsewhere_stays_what_it_was(spark):
    db = Database(spark)
    db.register("a", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (None, 2)], "k long, g long"))
    db.register("b", spark.createDataFrame([(1, 1), (2, 2), (None, 2)], "v long, g long"))
    assert rows(db.execute("SELECT k FROM a WHERE k NOT IN (SELECT v FROM b WHERE b.g = a.g)")) == [(2,)]
    assert rows(db.execute("WITH c AS (SELECT v FROM b WHERE v IS NOT NULL) SELECT k FROM a WHERE k NOT IN (SELECT v FROM c)")) == [(3,)]
    assert rows(db.execute("SELECT k FROM a WHERE (k, g) NOT IN (SELECT v, g FROM b WHERE v IS NOT NULL)")) == [(2,), (3,)]
    assert rows(db.execute("SELECT 'x NOT IN (SELECT v FROM b)' AS s FROM b WHERE v = 1")) == [("x NOT IN (SELECT v FROM b)",)]
    db.execute("CREATE VIEW rest AS SELECT k FROM a WHERE k NOT IN (SELECT v FROM b WHERE v > 1)")
    assert rows(db.execute("SELECT k FROM rest")) == [(1,), (3,)]


def test_not_in_of_groups_joins_and_ordered_rows(spark):
    db = Database(spark)
    db.register("a", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "k long, g long"))
    db.register("b", spark.createDataFrame([(2,), (4,)], "v long"))
    assert rows(db.execute("SELECT g, max(k) FROM a GROUP BY g HAVING max(k) NOT IN (SELECT v FROM b)")) == [(2, 3)]
    assert rows(db.execute("SELECT a.k, c.k FROM a LEFT JOIN a AS c ON a.k = c.k AND c.k NOT IN (SELECT v FROM b) WHERE a.g < 3")) == [(1, 1), (2, None), (3, 3)]
    assert [tuple(r) for r in db.execute("SELECT k -- (not in (select\n FROM a WHERE k /* key */ NOT IN -- free\n (SELECT v FROM b -- taken\n) ORDER BY k DESC LIMIT 1").collect()] == [(3,)]
    assert rows(db.execute("SELECT k FROM a WHERE k NOT IN (SELECT v FROM b ORDER BY v LIMIT 1)")) == [(1,), (3,), (4,)]
    either = db.execute("(SELECT k FROM a WHERE k NOT IN (SELECT v FROM b)) UNION ALL (SELECT v FROM b WHERE v NOT IN (SELECT g FROM a))")
    assert rows(either) == [(1,), (3,), (4,)]
    assert "LeftAnti" not in either._jdf.queryExecution().optimizedPlan().toString()


def test_other_statements_run_once(spark, tmp_path):
    db = Database(spark)
    db.register("a", spark.createDataFrame([(1,), (2,)], "k long"))
    path = f"{tmp_path}/kept"
    spark.range(0).toDF("k").write.parquet(path)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW kept USING parquet OPTIONS (path '{path}')")
    db.execute("WITH c AS (SELECT k FROM a) INSERT INTO kept SELECT k FROM c WHERE k NOT IN (SELECT k FROM a WHERE k > 1)")
    assert rows(spark.read.parquet(path)) == [(1,)]
