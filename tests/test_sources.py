from decimal import Decimal

import numpy as np
import pytest

from sumweave.catalog import Catalog
from sumweave.sources import binary
from sumweave.sources.binary import header, read_binary, write_binary, write_parts
from sumweave.sources.text import ddl, export_relation, generated, read_tbl, write_tbl

ROWS = [(1, 20, 300), (4, 50, 600), (7, 80, 900), (10, 110, 1200), (13, 140, 1500)]


@pytest.fixture(scope="module")
def relation(spark):
    return spark.createDataFrame(ROWS, "c0 long, c1 long, c2 long").repartition(2, "c0")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


def test_tbl(spark, relation, tmp_path):
    write_tbl(relation, str(tmp_path / "t.tbl"))
    lines = "".join(p.read_text() for p in (tmp_path / "t.tbl").glob("part-*"))
    assert sorted(lines.split()) == sorted("".join(f"{v}|" for v in r) for r in ROWS)
    assert sorted_rows(read_tbl(spark, str(tmp_path / "t.tbl"), 3)) == ROWS


@pytest.mark.parametrize("line", ["1|2|3|4|", "1|x|", "1|-|"])
def test_rows_that_do_not_fit_raise(spark, tmp_path, line):
    (tmp_path / "bad.tbl").write_text(line + "\n")
    with pytest.raises(Exception, match="MALFORMED|tbl"):
        read_tbl(spark, str(tmp_path / "bad.tbl"), 2).collect()


def test_binary_layout(spark, relation, tmp_path):
    path = str(tmp_path / "r")
    write_binary(relation.coalesce(1).sortWithinPartitions("c0"), path)
    raw = np.fromfile(path, "<u8").tolist()
    assert raw == [5, 3, *(r[k] for k in range(3) for r in ROWS)] and header(path) == (5, 3)
    assert sorted_rows(read_binary(spark, path)) == ROWS


def test_binary_parts_and_empty(spark, relation, tmp_path):
    write_parts(relation, str(tmp_path / "parts"))
    assert sorted_rows(read_binary(spark, str(tmp_path / "parts"))) == ROWS
    write_binary(relation.where("c0 < 0"), str(tmp_path / "none"))
    assert header(str(tmp_path / "none")) == (0, 3) and read_binary(spark, str(tmp_path / "none")).count() == 0


def test_binary_unsigned(spark, tmp_path):
    np.array([2, 1, (1 << 64) - 1, 5], "<u8").tofile(tmp_path / "u")
    assert sorted_rows(read_binary(spark, str(tmp_path / "u"), unsigned=True)) == [(Decimal(5),), (Decimal((1 << 64) - 1),)]
    with pytest.raises(Exception, match="above 2"):
        read_binary(spark, str(tmp_path / "u")).collect()


def test_binary_of_unsigned_and_of_many_batches(spark, tmp_path, monkeypatch):
    high = spark.createDataFrame([(Decimal((1 << 64) - 1),), (Decimal(7),)], "c0 decimal(20,0)")
    write_binary(high, str(tmp_path / "high"))
    assert sorted_rows(read_binary(spark, str(tmp_path / "high"), unsigned=True)) == [(Decimal(7),), (Decimal((1 << 64) - 1),)]
    many = spark.range(50_000).selectExpr("id as c0", "id * 2 as c1").coalesce(1)
    write_binary(many, str(tmp_path / "many"))
    assert sorted_rows(read_binary(spark, str(tmp_path / "many"))) == sorted_rows(many)
    monkeypatch.setattr(binary, "ONE_FILE", 100)
    write_binary(many.repartition(3), str(tmp_path / "parts"))
    assert len(list((tmp_path / "parts").glob("part-*.bin"))) == 3 and sorted_rows(read_binary(spark, str(tmp_path / "parts"))) == sorted_rows(many)
    with pytest.raises(Exception, match="nulls"):
        write_binary(spark.createDataFrame([(None,)], "c0 long"), str(tmp_path / "null"))


def test_truncated_binary(spark, tmp_path):
    np.array([9, 2, 1], "<u8").tofile(tmp_path / "short")
    with pytest.raises(ValueError, match="shorter"):
        header(str(tmp_path / "short"))


def test_export_and_init(spark, relation, tmp_path):
    for k in range(2):
        export_relation(relation, k, str(tmp_path))
    c = Catalog.from_init(spark, [*(tmp_path / "init").read_text().splitlines(), "Done", "never"], str(tmp_path))
    assert list(c) == [0, 1] and sorted_rows(c.frame(1)) == ROWS
    assert sorted_rows(spark.read.parquet(str(tmp_path / "r0.parquet"))) == ROWS
    assert (tmp_path / "r1.sql").read_text().startswith("CREATE TABLE r1 (c0 BIGINT, c1 BIGINT, c2 BIGINT, _end STRING) USING csv")
    assert ddl(relation, 3, provider="parquet") == "CREATE TABLE r3 (c0 BIGINT, c1 BIGINT, c2 BIGINT) USING parquet"


def test_generated(spark):
    assert sorted_rows(generated(spark, 4, 2)) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_only_integers(spark):
    with pytest.raises(TypeError):
        Catalog(spark).register(spark.createDataFrame([("a",)], "x string"))
