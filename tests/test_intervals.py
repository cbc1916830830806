import random
import pytest
from pyspark.sql import functions as F

from hitloom.operators.intervals import merge_intervals, points_inside


def union_of(rows):
    """Disjoint, not touching intervals of each key."""
    found = []
    for key in {r[0] for r in rows}:
        merged = []
        for low, end in sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and a < b):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([low, end])
        found += [(key, a, b) for a, b in merged]
    return found


@pytest.fixture
def whole_ranges(spark):
    """Ranges of small tables stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_by_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        low = rng.randrange(300)
        # A third under one key; one interval covers many others.
        rows.append((rng.choice(["hot", "hot", None, "a", "b", "c"]), low, low + rng.choice([0, 1, 2, 3, 5])))
    rows += [("hot", 40, 170), ("a", 0, 400), ("b", None, 3), ("b", 3, None), ("c", 9, 4), ("hot", 290, 310), rows[0]]
    df = spark.createDataFrame(rows, "key string, low int, end int")
    merged = merge_intervals(df, ["key"], str(tmp_path / "m"))
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(union_of(rows), key=repr)

    points = [(i, rng.choice(["hot", "hot", "a", "b", None, "none"]), rng.choice([None, rng.randrange(-5, 420)])) for i in range(500)]
    points.append(points[0])
    pdf = spark.createDataFrame(points, "low int, key string, at int")
    merged.write.parquet(str(tmp_path / "merged"))
    given = df if seed else spark.read.parquet(str(tmp_path / "merged"))
    found = points_inside(pdf, given, ["key"], "at", str(tmp_path / "p"))
    want = [p for p in points if p[2] is not None and any(k == p[1] and a <= p[2] < b for k, a, b in union_of(rows))]
    assert found.columns == pdf.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_without_keys_and_without_rows(spark, tmp_path):
    df = spark.createDataFrame([("0", "1"), ("01", "1"), ("1", "11")], "low string, end string")
    assert [tuple(r) for r in merge_intervals(df, [], str(tmp_path / "a")).collect()] == [("0", "11")]
    assert merge_intervals(df.limit(0), [], str(tmp_path / "b")).count() == 0
    points = spark.createDataFrame([("1",), ("2",)], "at string")
    assert [r["at"] for r in points_inside(points, df.filter("low = '0'"), [], "at", str(tmp_path / "c")).collect()] == []
    assert [r["at"] for r in points_inside(points, df.filter("low = '1'"), [], "at", str(tmp_path / "d")).collect()] == ["1"]
    assert points_inside(points, df.limit(0), [], "at", str(tmp_path / "e")).count() == 0
    assert points_inside(points.limit(0), df, [], "at", str(tmp_path / "f")).count() == 0


def largest_range(spark, path):
    """The share of the rows of a stored table that lie in its largest range."""
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_slot").count().collect()]
    return max(sizes) / sum(sizes)


def test_repeated_rows_do_not_pile_up_in_one_range(spark, tmp_path, whole_ranges):
    df = spark.range(40_000).selectExpr("'a' AS key", "IF(id % 4 = 0, id, 5) AS low", "IF(id % 4 = 0, id + 1, 9) AS end")
    merged = merge_intervals(df, ["key"], str(tmp_path / "m")).collect()
    assert len(merged) == 9_999 and ("a", 4, 9) in map(tuple, merged)
    assert largest_range(spark, str(tmp_path / "m" / "intervals")) < 0.5

    points = spark.range(20_000).selectExpr("'a' AS key", "IF(id % 4 = 0, id, 6) AS at", "id AS n")
    given = spark.createDataFrame([("a", 6, 7), ("a", 6, 8), ("a", 100, 200)], "key string, low long, end long")
    found = points_inside(points, given, ["key"], "at", str(tmp_path / "p"))
    assert found.count() == 15_000 + 25
    assert largest_range(spark, str(tmp_path / "p")) < 0.5
