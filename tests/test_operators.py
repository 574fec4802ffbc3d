"""Joins, aggregates, reshaping and polygons on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from domicilia.operators import aggregates as agg
from domicilia.operators import joins
from domicilia.operators.polygons import centroids
from domicilia.plans import density


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_strict_sum(spark):
    frame = spark.createDataFrame([(1, 10.0), (1, None), (2, 10.0), (2, 1.0)], "k int, x double")
    assert rows(frame.groupBy("k").agg(agg.strict_sum(F.col("x")).alias("s"))) == [(1, None), (2, 11.0)]


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(joins.null_safe_left_join(left, right, ["k"])) == [("a", 2, 20), ("b", 3, None), (None, 1, 10)]


def test_natural_join_counts_equal_rows(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, x int")
    right = spark.createDataFrame([(1, None, 7.0), (1, None, 7.0)], "k int, x int, y double")
    assert rows(joins.natural_join_counts(left, right)) == [(1, None, 7.0, 4), (2, 5, None, 1)]


def test_fan_out_equals_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(3, 0), (None, 9)], "k int, y int")
    hot = joins.hot_keys(right, ["k"], 10, 1.0)
    for keys in (None, hot):
        got = joins.left_join_fan_out(left, right, ["k"], keys).select("k", "x", "y")
        assert rows(got) == rows(left.join(right, "k", "left").select("k", "x", "y"))


def test_hot_keys(spark):
    frame = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [r[0] for r in joins.hot_keys(frame, ["k"], 10_000).collect()] == [7]
    assert joins.hot_keys(frame, ["k"], 50_000) is None


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_joined_whole_without_meeting_in_one_task(spark, how):
    left = spark.range(0, 9000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([(7, -1), (None, -2)], "k long, v long"))
    hot = joins.hot_keys(left, ["k"], 100, 1.0)
    got = joins.join_to_unique(left, right, ["k"], how, hot)
    assert rows(got) == rows(left.join(right, "k", how))
    sizes = got.filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 8


def test_partition_sum_equals_window(spark, monkeypatch):
    from pyspark.sql import Window

    frame = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    expected = rows(frame.withColumn("s", F.sum("id").over(Window.partitionBy("k"))).select("k", "id", "s"))
    assert rows(agg.partition_sum(frame, F.col("id"), ["k"], "s").select("k", "id", "s")) == expected
    monkeypatch.setattr(joins, "HOT_ROWS", 500)
    monkeypatch.setattr(joins, "HOT_FRACTION", 1.0)
    assert rows(agg.partition_sum(frame, F.col("id"), ["k"], "s").select("k", "id", "s")) == expected


def test_attach_beyond_the_bound(spark):
    big = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    near = joins.attach(big, joins.bounded_side(small), ["k"], ["id"])
    far = joins.attach(big, joins.bounded_side(small, 1), ["k"], ["id"])
    assert joins.bounded_side(small, 1).bounded is False
    assert rows(near.select("id", "k", "v")) == rows(far.select("id", "k", "v"))


def test_spread_gather_and_complete(spark):
    long = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0), ("s", "b", 3.0)], "r string, k string, v double")
    wide = agg.spread(long, ["r"], "k", "v", ["a", "b"])
    assert rows(wide) == [("r", 1.0, 2.0), ("s", None, 3.0)]
    assert rows(agg.gather(wide, ["r"], ["a", "b"], "k", "v").filter("v is not null")) == rows(long)
    assert rows(agg.complete(long, ["r"], "k", "v", ["a", "b", "c"])) == [
        ("r", "a", 1.0), ("r", "b", 2.0), ("r", "c", 0.0), ("s", "a", 0.0), ("s", "b", 3.0), ("s", "c", 0.0),
    ]


def test_complete_refuses_other_keys(spark):
    long = spark.createDataFrame([("r", "a", 1.0), ("r", "z", 2.0)], "r string, k string, v double")
    with pytest.raises(Exception, match="k is not listed: z"):
        agg.complete(long, ["r"], "k", "v", ["a", "b"]).collect()


def test_partition_sum_of_missing_keys(spark):
    frame = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, None, 4.0), (4, None, 5.0)], "i int, k string, v double")
    got = agg.partition_sum(frame, F.col("v"), ["k"], "s")
    assert {r["i"]: r["s"] for r in got.collect()} == {1: 3.0, 2: 3.0, 3: 9.0, 4: 9.0}
    pairs = agg.partition_sum(frame.withColumn("j", F.lit(1)), F.col("v"), ["j", "k"], "s")
    assert {r["i"]: r["s"] for r in pairs.collect()} == {1: 3.0, 2: 3.0, 3: 9.0, 4: 9.0}


def test_area_of_all_years(spark):
    areas = spark.createDataFrame([(1, 2000, 5.0), (1, 2005, 7.0)], "ra_cira int, ano int, area_1 double")
    assert rows(density.occupied_area(areas)) == [(1, 12.0)]
    with pytest.raises(Exception, match="ano is not listed: 2005"):
        density.area_by_year(areas, [1999, 2000]).collect()


def test_totals_of_nested_groups(spark):
    frame = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 4.0)], "r string, k int, v double")
    got = agg.total_rows(frame, ["r", "k"], [], [F.sum("v").alias("v")], "all")
    assert rows(got) == rows(
        spark.createDataFrame(
            [("a", "1", 1.0), ("a", "2", 2.0), (None, "1", 4.0), ("a", "all", 3.0), (None, "all", 4.0), ("all", "all", 7.0)],
            "r string, k string, v double",
        )
    )


def test_round_to_even(spark):
    frame = spark.createDataFrame([(2.5, 1), (3.5, 2)], "x double, k int")
    assert rows(agg.round_numeric(frame, 0)) == [(2.0, 1), (4.0, 2)]
    assert rows(agg.round_numeric(spark.createDataFrame([(0.125,)], "x double"), 2)) == [(0.12,)]


def test_rank_by_group_total(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 9.0), ("c", 2.0)], "g string, n double")
    got = {r["g"]: r["rank"] for r in agg.rank_groups(frame, "g", -F.sum("n")).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}


def shoelace(points):
    pairs = list(zip(points, points[1:] + points[:1]))
    cross = [a[0] * b[1] - b[0] * a[1] for a, b in pairs]
    area = sum(cross) / 2
    return (
        area,
        sum((a[0] + b[0]) * k for (a, b), k in zip(pairs, cross)) / (6 * area),
        sum((a[1] + b[1]) * k for (a, b), k in zip(pairs, cross)) / (6 * area),
    )


def vertex_frame(spark, polygons):
    data = [(p, r, i, float(x), float(y)) for (p, r), points in polygons.items() for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(data, "poly_id int, ring int, seq int, x double, y double")


def test_rectangle_and_hole(spark):
    outline, hole = [(0, 0), (4, 0), (4, 2), (0, 2)], [(1, 0), (1, 1), (0, 1), (0, 0)]
    got = {r["poly_id"]: r for r in centroids(vertex_frame(spark, {(1, 0): outline, (2, 0): outline[::-1], (2, 1): hole})).collect()}
    assert tuple(got[1])[1:] == (8.0, 2.0, 1.0)
    assert tuple(got[2])[1:] == pytest.approx((7.0, (16 - 0.5) / 7, (8 - 0.5) / 7))


def test_random_polygons_against_brute_force(spark):
    rng = random.Random(3)
    polygons = {(i, 0): [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(3 + i)] for i in range(20)}
    got = {r["poly_id"]: r for r in centroids(vertex_frame(spark, polygons)).collect()}
    for (i, _), points in polygons.items():
        area, x, y = shoelace(points)
        assert (got[i]["area"], got[i]["x"], got[i]["y"]) == pytest.approx((abs(area), x, y))


def test_spread_refuses_a_second_cell(spark):
    frame = spark.createDataFrame([("a", "k", 1.0), ("a", "k", 9.0)], "row string, key string, v double")
    with pytest.raises(Exception, match="two cells"):
        agg.spread(frame, ["row"], "key", "v", ["k"]).collect()


# Key domains that are not known before


@pytest.mark.parametrize("limit", [100, 1])
def test_complete_open(spark, limit):
    rows = [("a", 1, 5.0), ("a", None, 2.0), ("b", 7, None), (None, 1, 3.0)]
    cells = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r.g, r.k): r.v for r in agg.complete_open(cells, ["g"], "k", "v", limit=limit, salts=5).collect()}
    known = {(g, k): v or 0.0 for g, k, v in rows}
    assert got == {(g, k): known.get((g, k), 0.0) for g in ("a", "b", None) for k in (1, 7, None)}
    assert agg.complete_open(cells.limit(0), ["g"], "k", "v", limit=limit).count() == 0


@pytest.mark.parametrize("limit", [100, 1])
def test_complete_open_refuses_second_cells(spark, limit):
    cells = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 2.0), ("b", 2, 1.0)], "g string, k int, v double")
    with pytest.raises(Exception, match="two cells"):
        agg.complete_open(cells, ["g"], "k", "v", limit=limit).collect()


def test_spread_open(spark):
    cells = spark.createDataFrame([("a", 1, 5.0), ("a", None, 2.0), ("b", 7, None)], "g string, k int, v double")
    wide = agg.spread_open(cells, ["g"], "k", "v", 0.0)
    assert wide.columns == ["g", "1", "7", "NA"]
    assert sorted(map(tuple, wide.collect())) == [("a", 5.0, 0.0, 2.0), ("b", 0.0, 0.0, 0.0)]


def test_rank_groups_with_ties_and_null(spark):
    rows = [(f"g{k}", float(k // 3)) for k in range(300)] + [(None, 0.5)]
    got = {r.g: r["rank"] for r in agg.rank_groups(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", F.sum("v")).collect()}
    order = sorted({v for _, v in rows})
    assert got == {g: order.index(v) + 1 for g, v in rows}
