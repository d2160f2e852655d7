import pytest

from morphlake.operators.delivery import delivered_once, superfluous


def rows():
    out = [(i, f" M{i % 50} " if i % 2 else f"m{i % 50}", "Кот" if i % 3 else " кот", i * 1.0) for i in range(300)]  # many copies of each message
    out += [(300 + i, "hot", "слово", 0.0) for i in range(200)]
    out += [(500, None, "кот", 1.0), (501, None, "кот", 1.0), (502, "m1", None, 1.0), (503, "m1", None, 1.0), (504, "m1", "  ", 1.0), (505, "m1", "другое", 1.0), (506, "", "кот", 1.0), (507, " ", "кот", 1.0)]
    return out


def brute(data):
    best, gone = {}, set()
    for i, m, w, _ in sorted(data):
        key = (m.strip().lower() if m is not None else None, (w or "").strip().lower() or None)
        if None not in key:
            if key in best:
                gone.add(i)
            best.setdefault(key, i)
    return gone


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_against_brute_force(spark, tmp_path, most):
    data = rows()
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, "row_id bigint, msg_id string, word string, bits double").repartition(7).write.parquet(path)
    gone = brute(data)
    assert {r.row_id for r in superfluous(spark, path, most_broadcast=most).collect()} == gone
    kept = delivered_once(spark, path, most_broadcast=most)
    assert kept.columns == ["row_id", "msg_id", "word", "bits"]
    assert sorted(r.row_id for r in kept.collect()) == sorted(i for i, *_ in data if i not in gone)


def test_ties_and_empty(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a", "x")] * 4, "row_id bigint, msg_id string, word string").write.parquet(path)
    assert delivered_once(spark, path).count() == 1
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "row_id bigint, msg_id string, word string").write.parquet(path)
    assert delivered_once(spark, path).count() == 0 and superfluous(spark, path).count() == 0


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_other_orders_and_nulls(spark, tmp_path, most):
    for i, kind in enumerate(("int", "timestamp", "string", "double")):
        path = str(tmp_path / f"{i}.parquet")
        rows = spark.createDataFrame([(5, "a", "x"), (None, "a", "x"), (7, "a", "x"), (3, "b", "x"), (2, "b", "x"), (4, "c", None)], "o int, msg_id string, word string")
        rows.selectExpr(f"cast({'timestamp_seconds(o)' if kind == 'timestamp' else 'o'} as {kind}) as o", "msg_id", "word", "o as n").repartition(3).write.parquet(path)
        kept = delivered_once(spark, path, order_col="o", most_broadcast=most)
        assert sorted((r.msg_id, r.n) for r in kept.collect()) == [("a", None), ("b", 2), ("c", 4)]


def test_more_than_a_bitmap_of_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100_000).selectExpr("id as row_id", "concat('m', id % 70000) as msg_id", "'w' as word").coalesce(1).write.parquet(path)
    for most in (64 << 20, 0):
        gone = superfluous(spark, path, most_broadcast=most)
        assert gone.agg({"row_id": "min"}).first()[0] == 70_000 and gone.count() == 30_000
