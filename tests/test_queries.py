import duckdb
import pytest

from sumweave.queries import ORACLE_SQL, QUERIES, TEXTS

SF = "/root/testdata/sf0.001"
#: Answers at scale 0.01.
ANSWERS = {
    "join2_gt": "159570204839 750878549689", "join3_chain_gt": "87989000 97794", "filter_lt": "57813132479 278754",
    "filter_eq": "18654168033 563920", "filter_gt": "961692 297", "filter_range": "100737049053",
    "filter_multi_column": "14901438518 20702126", "join4_chain": "65504439079 311786178290 9171175",
    "join_star": "55953186355 50247 123050", "join_self": "68768595 68768595", "join_composite_key": "436694 436625",
    "join_cycle": "291811 4457936", "join_same_binding_eq": "6982950564", "join_fanout": "473926161 2366942901601",
    "sum_multi": "1134636 159034946970 308912002", "sum_repeated_column": "8435 8435 8799860", "sum_zero_is_null": "NULL 50",
    "sum_empty_is_null": "NULL", "norm_weak_filters": "7992950", "norm_contradiction_eq": "NULL",
    "norm_contradiction_range": "NULL", "norm_duplicate_predicate": "12344327873",
}


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "conversations", "pages", "benchmark"):
        d.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return d


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_known_answers(spark):
    from sumweave.engine import Engine
    from sumweave.sources.tables import catalog

    got = Engine(catalog(spark, "/root/testdata/sf0.01")).batch_frame(TEXTS[k] for k in ANSWERS).orderBy("ordinal").collect()
    assert dict(zip(ANSWERS, (r["line"] for r in got), strict=True)) == ANSWERS


def test_entry_module_registers_everything():
    import __spark_entry__

    assert set(ORACLE_SQL) == set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
