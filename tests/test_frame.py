import pytest
from pyspark.sql import functions as F

from millrace.frame import Frame


@pytest.fixture(scope="module")
def items(spark):
    return Frame(spark.createDataFrame([(i, 2 * i, f"item_{i}") for i in range(100)], "id bigint, value bigint, name string"))


def test_protocol(items):
    assert len(items) == 100 and items.shape == (100, 3) and items.columns == ["id", "value", "name"]
    assert items and not items.filter("id < 0") and items.filter("id < 0").empty
    assert {"id": 3, "value": 6} in items and {"id": 3, "value": 7} not in items and {"nope": 1} not in items
    assert "item_7" in items and 198 in items and 199 not in items
    assert [r["id"] for r in items.sort("id").limit(3)] == [0, 1, 2]
    assert sorted(items["value"])[:3] == [0, 2, 4] and sorted(items.name)[:1] == ["item_0"]
    assert items.sort("id")[5]["id"] == 5 and [r["id"] for r in items.sort("id")[2:5]] == [2, 3, 4]
    assert items[["id", "name"]].columns == ["id", "name"]
    with pytest.raises(AttributeError):
        items.missing


def test_union_and_equality(items):
    assert len(items + items) == 200 and len(items | items) == 200 and len(items.union(items, items)) == 300
    assert items != items.copy() and items == items
    with pytest.raises(TypeError):
        Frame([1, 2])


def test_arguments(items):
    for bad in (lambda: items.limit(0), lambda: items.repartition(0), lambda: items.select(), lambda: items.groupby(), lambda: items.filter(), lambda: items.sample(), lambda: items.sample(2.0), lambda: items.join(items, "id", "cross"), lambda: items.filter("id > 1", fn=bool)):
        with pytest.raises(ValueError):
            bad()


def test_rows(items):
    assert items.map(lambda r: {"x": r["id"] + 1} if r["id"] != 5 else 1 / 0, "x bigint").count() == 99
    assert items.flat_map(lambda r: [{"x": r["id"]}] * (r["id"] % 2), "x bigint").count() == 50
    assert items.map(lambda r: {"x": r["id"]}).columns == ["x"]
    assert items.map_batches(lambda p: p.assign(c=p.id + p.value), batch_size=7).filter("c = 3 * id").count() == 100
    assert items.with_column("z", lambda r: 10 // r["id"], "bigint").filter("z is null").count() == 1
    assert items.map_sql("select count(*) as n from batch where name like 'item_1%'").collect() == [{"n": 11}]
    assert items.filter(fn=lambda r: r["id"] > 97).count() == 2


def test_joins(spark):
    left = Frame(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "id int, value string"))
    right = Frame(spark.createDataFrame([(2, "x"), (3, "y"), (4, "z"), (None, "m")], "id int, value string"))
    assert sorted(r["id"] for r in left.join(right, "id").collect()) == [2, 3]
    assert left.join(right, "id").columns == ["id", "value_x", "value_y"]
    counts = {how: left.join(right, "id", how).count() for how in ("left", "right", "outer", "left_semi", "left_anti")}
    assert counts == {"left": 4, "right": 4, "outer": 6, "left_semi": 2, "left_anti": 2}
    assert left.join(right, "id", null_equal=True).count() == 3 and left.join(right, "id", "outer", null_equal=True).count() == 5


def test_aggregates(spark):
    f = Frame(spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("B", 4)], "g string, value int"))
    assert {r["g"]: r["sum(value)"] for r in f.groupby("g").agg({"value": "sum"})} == {"A": 3, "B": 7}
    assert {r["g"]: r["value"] for r in f.groupby("g").first("value")} == {"A": 1, "B": 3}
    assert {r["g"]: r["value"] for r in f.groupby("g").last("value")} == {"A": 2, "B": 4}
    assert (f.max("value"), f.min("value"), f.mean("value"), f.sum("value")) == (4, 1, 2.5, 10) and f.std("value") == pytest.approx(1.29099, abs=1e-4)
    assert f.pivot("g", "value", "value", "sum").count() == 2


def test_nulls(spark):
    f = Frame(spark.createDataFrame([(1, None, float("nan"), ""), (2, "a", 1.0, " "), (3, "b", 2.0, "x")], "id int, s string, v double, t string"))
    assert [r["id"] for r in f.dropna()] == [3] and sorted(r["id"] for r in f.dropna(["s", "unknown"])) == [2, 3]
    assert sorted(r["v"] for r in f.fillna(0.5)) == [0.5, 1.0, 2.0] and f.fillna("-").filter("s = '-'").count() == 1
    assert [r["s"] for r in f.fill_direction("bfill", "id", "s").sort("id")] == ["a", "a", "b"]


def test_duplicates(spark):
    f = Frame(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6)], "k string, o int"))
    keep = lambda how: sorted(r["o"] for r in f.drop_duplicates("k", how, "o"))
    assert keep("first") == [1, 3, 4] and keep("last") == [2, 3, 6] and keep(False) == [3]
    assert len(f.distinct("k")) == 3 and len((f + f).distinct()) == 6
    nested = Frame(spark.createDataFrame([({"a": 1},), ({"a": 1},)], "m map<string, int>"))
    assert len(nested.distinct()) == 1


def test_order_and_partitions(spark, items):
    assert items.concat([items.rename({"name": "other"}).drop("value")], axis=1, order_by="id").filter("other = name").count() == 100
    assert items.repartition_by_hash("id", 3).df.rdd.getNumPartitions() == 3 and items.coalesce(1).df.rdd.getNumPartitions() == 1
    assert items.sample(n=7, seed=1).count() == 7
    assert "Scan" in items.explain() and items.stats()
    assert items.checkpoint().count() == 100
    for n in (1, 7):
        got = items.repartition(n).assign(g=F.col("id") % 3).window("g", "id").row_number().groupby("g").max("row_number").collect()
        assert sorted(r["max(row_number)"] for r in got) == [33, 33, 34]
