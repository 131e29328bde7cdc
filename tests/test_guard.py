import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException

from lexloom.plans.guard import Guard, Refused


@pytest.fixture(scope="module")
def guard(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('guard')}/nodes"
    spark.createDataFrame([("a", "Section", "1", "text one"), ("b", "Rule", "2", "text two")], "uid string, label string, number string, text string").write.parquet(at)
    spark.sql("select 'x' as uid, 1 as k").createOrReplaceTempView("secret")
    made = Guard(spark, {"nodes": spark.read.parquet(at), "edges": spark.createDataFrame([("a", "b", "R")], "src string, dst string, rel_type string")})
    made.at = at
    yield made
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("query", [
    "select 1", "select * from nodes", "select label, count(*) as c from nodes group by label having count(*) > 0 order by c desc limit 5", "select * from identifier('nodes')",
    "with secret as (select * from nodes) select s.uid from secret s join nodes t on s.uid = t.uid", "select a.uid, b.uid from nodes a join edges e on a.uid = e.src join nodes b on b.uid = e.dst where a.text like '%one%'",
    "select uid from nodes where uid in (select src from edges) or exists (select 1 from edges where dst = uid) or number = (select max(number) from nodes)", "select uid, row_number() over (partition by label order by uid), lag(uid) over (order by uid) from nodes",
    "select nvl(text, 'x'), nullif(uid, 'a'), left(text, 2), if(uid = 'a', 1, 2), case when uid = 'a' then 1 end, concat(uid, 'x'), split(text, ' ')[0], regexp_extract(text, 't(.)', 1), cast(number as int) + 1, year(current_date()) from nodes",
    "select label, collect_list(uid), collect_set(struct(uid, number)), max_by(uid, number), avg(cast(number as int)) from nodes group by label", "select explode(split(text, ' ')) from nodes", "select uid from nodes lateral view explode(split(text, ' ')) t as w",
    "select distinct label from nodes union select src from edges", "select uid from nodes except select dst from edges", "select * from values (1), (2) t(a)", "select transform(split(text, ' '), x -> upper(x)) from nodes", "select uid between 'a' and 'b', uid ilike 'A' from nodes", "select label, count(*) from nodes group by rollup(label)",
])
def test_read_queries_pass(guard, query):
    assert guard.read(query).collect()


@pytest.mark.parametrize("query", [
    "select * from secret", "select * from identifier('secret')", "with secret as (select * from secret) select * from secret", "select (select max(uid) from secret)", "select uid from nodes where uid in (select uid from secret)", "select sum(k) over () from secret",
    "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select nvl(java_method('java.lang.System', 'getProperty', 'user.home'), '') from nodes", "select * from nodes order by reflect('java.lang.System', 'getProperty', 'user.home')", "select left(reflect('java.lang.System', 'getProperty', 'user.home'), 3) from nodes",
    "select * from range(1000000000000)", "select sequence(1, 1000000000)", "select repeat('x', 1000000000) from nodes", "select * from stack(2, 1, 2)", "select * from parquet.`{at}`", "select transform(uid) using 'cat' as x from nodes", "select input_file_name() from nodes", "select raise_error('x')", "select taken(uid) from nodes",
])
def test_other_queries_are_refused(spark, guard, query):
    spark.udf.register("taken", lambda x: x)
    with pytest.raises(Refused):
        guard.read(query.replace("{at}", guard.at))


@pytest.mark.parametrize("query", ["drop table nodes", "create table x as select 1", "insert into nodes select * from nodes", "set x = 1", "select 1; select 2", "describe nodes", "show tables", "execute immediate 'select 1'"])
def test_commands_are_no_queries(guard, query):
    with pytest.raises((Refused, ParseException, AnalysisException, Py4JJavaError)):
        guard.read(query)


def test_views_are_told_by_their_plan(spark, guard):
    other = Guard(spark, {"nodes": spark.sql("select 'other' as uid")})
    assert other.read("select * from nodes").collect() == [("other",)]
    assert guard.read("select count(*) as n from nodes").first()["n"] == 2
    assert other.read("select uid from nodes").collect() == [("other",)]
