import random
from dataclasses import replace
from decimal import Decimal

import duckdb
import pytest

from sumweave.catalog import Catalog
from sumweave.engine import Engine, render
from sumweave.plans.spec import ColumnRef, Filter, Join, QuerySpec, UnknownColumn, UnknownRelation
from sumweave.streaming.batch import BatchSession, run_workload
from sumweave.streaming.stream import answer_stream

TABLES = {
    0: [(i, i % 5, i * 7 % 11) for i in range(40)],
    1: [(i % 8, i, 0) for i in range(30)],
    2: [(i, i % 3) for i in range(12)],
    3: [],
}


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    for i, rows in TABLES.items():
        width = len(rows[0]) if rows else 2
        c.register(spark.createDataFrame(rows, ", ".join(f"x{k} long" for k in range(width))), i)
    return c


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for i, rows in TABLES.items():
        width = len(rows[0]) if rows else 2
        d.execute(f"create table r{i} ({', '.join(f'c{k} bigint' for k in range(width))})")
        if rows:
            d.executemany(f"insert into r{i} values ({', '.join('?' * width)})", rows)
    return d


def some_query(r):
    n = r.choice([1, 2, 2, 3, 4])
    ids = [r.choice([0, 0, 1, 1, 2, 2, 3]) for _ in range(n)]
    column = lambda b: ColumnRef(b, r.randrange(len(TABLES[ids[b]][0]) if TABLES[ids[b]] else 2))
    joins = [Join(column(b), column(r.randrange(b))) for b in range(1, n)]
    if n > 1 and r.random() < 0.4:
        joins.append(Join(column(r.randrange(n)), column(r.randrange(n))))
    filters = [Filter(column(r.randrange(n)), r.choice("<>="), r.randrange(12)) for _ in range(r.randrange(4))]
    return QuerySpec(tuple(ids), tuple(joins), tuple(filters), tuple(column(r.randrange(n)) for _ in range(r.randrange(1, 4))))


@pytest.mark.parametrize("options", [{}, {"order": "written"}, {"eager": True}, {"eager": None}])
def test_random_queries_against_duckdb(catalog, duck, options):
    engine, r = Engine(catalog, **options), random.Random(11)
    specs = [some_query(r) for _ in range(12)]
    got = [x["line"] for x in engine.batch_frame(specs).orderBy("ordinal").collect()]
    assert got == [render(duck.sql(s.to_sql()).fetchall()[0]) for s in specs]


def test_zero_and_empty_sums(catalog):
    assert Engine(catalog).run("1|0.0>2|0.2 0.0") == "NULL 87"
    assert Engine(catalog, zero_is_null=False).run("1|0.0>2|0.2") == "0"
    assert Engine(catalog).run("3 0|0.0=1.0|1.0") == "NULL"
    assert Engine(catalog).run("0|0.0>5&0.0<3|0.0 0.1") == "NULL NULL"


def test_a_contradiction_needs_no_scan(catalog):
    plan = Engine(catalog).query("0 1|0.0=1.0&0.0>5&0.0<3|0.0")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan


def test_filters_are_below_joins_and_columns_are_pruned(catalog):
    text = Engine(catalog).explain("0 1|0.0=1.0&0.1<3|1.1")
    assert "b0_c2" not in text and "b1_c2" not in text and "CartesianProduct" not in text and "join b" in text


def test_unknown_names(catalog):
    with pytest.raises(UnknownRelation):
        Engine(catalog).run("9|0.0>1|0.0")
    with pytest.raises(UnknownColumn):
        Engine(catalog).run("2|0.5>1|0.0")


def test_unsigned_edges(spark):
    edge = [(1 << 31) - 1, 1 << 31, (1 << 32) - 1, 1 << 32, 1 << 63, (1 << 64) - 1]
    c = Catalog(spark)
    c.register(spark.createDataFrame([(Decimal(v), i) for i, v in enumerate(edge)], "v decimal(20,0), i long"))
    c.register(spark.createDataFrame([(v,) for v in edge[:4] + [(1 << 63) - 1]] * 3, "v long"))
    engine = Engine(c)
    assert engine.run("0||0.0") == str(sum(edge) % (1 << 64))
    for k in (*edge, 0, 5):
        for op, holds in ((">", lambda v, k: v > k), ("<", lambda v, k: v < k), ("=", lambda v, k: v == k)):
            want = sum(v for v in edge if holds(v, k)) % (1 << 64) or "NULL"
            assert engine.run(f"0|0.0{op}{k}|0.0") == str(want), (op, k)
            small = [v for v in edge[:4] + [(1 << 63) - 1] if holds(v, k)]
            assert engine.run(f"1|0.0{op}{k}|0.0") == str(3 * sum(small) % (1 << 64) or "NULL"), (op, k)
    assert engine.run("0 1|0.0=1.0|1.0") == str(3 * sum(edge[:4]))
    assert engine.query("1||0.0", signed=True).first()[0] == (3 * (sum(edge[:4]) + (1 << 63) - 1) + (1 << 63)) % (1 << 64) - (1 << 63)


def test_batches_answer_in_order(catalog):
    engine = Engine(catalog)
    queries = ["0|0.0<9|0.0", "0 1 2|0.1=1.0&1.1=2.0|0.0 2.1", "1|0.0=3|0.1", "2|0.0>100|0.0"]
    want = [engine.run(q) for q in queries]
    with BatchSession(engine) as s:
        got = [s.feed(line) for line in [*queries[:2], "F", "", queries[2], "F", queries[3]]]
    assert got == [[], [], want[:2], [], [], want[2:3], []] and s.rest == want[3:]
    assert engine.batch([*queries, "F"]) == want


def test_batches_run_the_longest_first(spark):
    # a large scan, a large join of two and a tiny join of three relations
    c = Catalog(spark)
    for n in (20_000, 10_000, 5, 4):
        c.register(spark.range(n).selectExpr("id as a", "id % 7 as b"))
    session = BatchSession(Engine(c))
    for q in ("2 3 2|0.0=1.0&1.1=2.1|0.0", "1|0.0>4|0.1", "0 1|0.1=1.1|0.0", "2||0.0", "0|0.0>5&0.0<3|0.0", "0 1|0.0=1.0|0.0"):
        session.feed(q)
    assert session.order() == [2, 5, 1, 0, 3, 4]


def test_workloads_are_replayed(catalog, tmp_path):
    queries = ["0|0.0<9|0.0", "0 1|0.1=1.1|0.0 1.1", "F", "1|0.0=3|0.1", "F"]
    answers = Engine(catalog).batch(queries)
    (tmp_path / "w").write_text("\n".join(queries) + "\n")
    (tmp_path / "r").write_text("\n".join(answers) + "\n")
    assert run_workload(Engine(catalog), str(tmp_path / "w"), str(tmp_path / "r")) == answers
    (tmp_path / "r").write_text("\n".join([*answers[:2], "7"]) + "\n")
    with pytest.raises(AssertionError, match="line 3"):
        run_workload(Engine(catalog), str(tmp_path / "w"), str(tmp_path / "r"))


def test_joins_that_fan_out_are_aggregated_first(spark):
    c = Catalog(spark)
    c.register(spark.range(2000).selectExpr("id as a", "id % 5 as b"))
    c.register(spark.range(3000).selectExpr("id as a", "id % 5 as b"))
    many, one = "0 1|0.1=1.1|0.0 1.0", "0 1|0.0=1.0|0.1 1.0"
    plan = lambda q, **options: Engine(c, **options).query(q)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert (plan(many, eager=None), plan(one, eager=None), plan(many), plan(many, eager=True)) == (3, 1, 1, 3)
    assert Engine(c, eager=None).run(many) == Engine(c).run(many)


def test_repeated_joins_of_bucketed_relations_need_no_exchange(spark):
    c = Catalog(spark)
    rows = [spark.range(4000).selectExpr("id % 900 as a", "id as b"), spark.range(900).selectExpr("id as a", "id * 3 as b")]
    for k, df in enumerate(rows):
        c.register(df, k)
        c.register(df, 10 + k, bucket_by=0, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = lambda q: Engine(c).explain(q).count("hashpartitioning(")
        assert dealt("0 1|0.0=1.0|0.1 1.1") > 0
        for plain, q in (("0 1|0.0=1.0|0.1 1.1", "10 11|0.0=1.0|0.1 1.1"), ("0 1 0|0.0=1.0&1.0=2.0&0.1>5|0.1 1.1", "10 11 10|0.0=1.0&1.0=2.0&0.1>5|0.1 1.1")):
            assert dealt(q) == 0 and Engine(c).run(q) == Engine(c).run(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_above_a_known_maximum_raise(spark):
    c = Catalog(spark)
    for _ in range(3):
        c.register(spark.range(50).selectExpr("id as a", "id * 1000 as b"))
    engine, q = Engine(c), "0 1 2|0.0=1.0&1.0=2.0|0.1"
    assert engine.run(q) == str(sum(k * 1000 for k in range(50)))
    c.stats._kept[0][1][1] = replace(c.stats._kept[0][1][1], high=40_000)
    with pytest.raises(Exception, match="known maximum"):
        engine.run(q)


def test_checked_relations(spark):
    c = Catalog(spark)
    for value in (-1, None):
        with pytest.raises(ValueError, match="null or negative"):
            c.register(spark.createDataFrame([(1,), (value,)], "a long"), check=True)
    assert c.register(spark.createDataFrame([(1,), (0,)], "a long"), check=True) == 0


def test_stream_of_queries(catalog, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("0|0.0<9|0.0\nF\n1|0.0=3|0.1\n")
    answer_stream(Engine(catalog), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [r["line"] for r in got] == [Engine(catalog).run("0|0.0<9|0.0"), Engine(catalog).run("1|0.0=3|0.1")]
