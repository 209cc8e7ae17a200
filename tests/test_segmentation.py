import random

from pyspark.sql import functions as F

from perimeter.config import Settings
from perimeter.operators import segmentation as E
from perimeter.operators.links import BoxLinks, connected_components, link_boxes, with_box
from perimeter.operators.ranking import exact_quantiles, global_index

R, H = 2000.0, 96


def brute_components(points):
    parent = {p[0]: p[0] for p in points}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in points:
        for b in points:
            if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= R * R and abs(a[3] - b[3]) <= H * 3600:
                parent[find(a[0])] = find(b[0])
    groups = {}
    for p in points:
        groups.setdefault(find(p[0]), set()).add(p[0])
    return {frozenset(g) for g in groups.values()}


def spark_components(spark, points):
    df = spark.createDataFrame(points, "id long, x double, y double, t_s long")
    boxed = with_box(df, R, H)
    labels = connected_components(boxed.select("box").distinct(), link_boxes(df, R, H))
    groups = {}
    for row in boxed.join(labels, "box").select("id", "component").collect():
        groups.setdefault(row.component, set()).add(row.id)
    return {frozenset(g) for g in groups.values()}


def test_limits_are_inclusive(spark):
    near = [(1, 0.0, 0.0, 0), (2, 2000.0, 0.0, H * 3600), (3, 10000.0, 0.0, 0), (4, 12000.5, 0.0, 0),
            (5, 50000.0, 0.0, 0), (6, 50000.0, 0.0, H * 3600 + 1)]
    assert spark_components(spark, near) == brute_components(near)


def test_sparse_and_dense_clouds(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 30000), rng.uniform(0, 30000), rng.randrange(0, 40 * 86400)) for i in range(250)]
    points += [(1000 + i, 90000 + rng.uniform(0, 900), rng.uniform(0, 900), rng.randrange(0, 86400)) for i in range(300)]
    points += [(2000 + i, 92700 + rng.uniform(0, 900), rng.uniform(0, 900), 5 * 86400 + rng.randrange(0, 86400)) for i in range(100)]
    assert spark_components(spark, points) == brute_components(points)


def test_only_boxes_still_apart_are_looked_into(spark, monkeypatch):
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 12000), rng.uniform(0, 12000), rng.randrange(0, 40 * 86400)) for i in range(600)]
    points += [(1000 + i, 60000 + rng.uniform(0, 20000), rng.uniform(0, 20000), rng.randrange(0, 20 * 86400)) for i in range(60)]
    df = spark.createDataFrame(points, "id long, x double, y double, t_s long")
    boxed, seen, settle = with_box(df, R, H), [], BoxLinks.settle

    def counted(self, unsure):
        seen.append((unsure.count(), self.unsure.count()))
        return settle(self, unsure)
    monkeypatch.setattr(BoxLinks, "settle", counted)
    groups = {}
    for row in boxed.join(E.component_points(df, Settings())[1], "box").select("id", "component").collect():
        groups.setdefault(row.component, set()).add(row.id)
    assert {frozenset(g) for g in groups.values()} == brute_components(points)
    assert seen and seen[0][0] * 4 < seen[0][1]


def test_long_chain_contracts(spark):
    chain = [(i, i * 1900.0, 0.0, i * 3600) for i in range(400)]
    assert len(spark_components(spark, chain)) == 1


def test_repeated_place_with_time_gap(spark):
    points = [(i, 100.0, 100.0, (i % 2) * 97 * 3600 * 3 + i) for i in range(60)]
    assert spark_components(spark, points) == brute_components(points)


def test_global_index_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randrange(50))) for k in "ab" for _ in range(101)]
    df = spark.createDataFrame(rows, "k string, v double")
    idx = [r.idx for r in global_index(df, ["k", "v"]).orderBy("k", "v", "idx").collect()]
    assert sorted(idx) == list(range(202))
    import numpy as np
    for row in exact_quantiles(df, "v", [0.1, 0.5, 0.95], ["k"]).collect():
        want = np.quantile([v for k, v in rows if k == row.k], row.prob)
        assert abs(row["quantile"] - want) < 1e-9


def test_extent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in df.select(E.half_even(F.col("v"))).collect()] == [0, 2, 2]


def test_named_subset_fails_on_unknown_fire(spark):
    import pytest
    events = spark.createDataFrame([("a", 1, True, False)], "fire_id string, event int, keep boolean, touches_no_data boolean")
    wanted = spark.createDataFrame([("a",), ("zz",)], "fire_id string")
    with pytest.raises(Exception, match="unknown fire zz"):
        E.named_subset(events, wanted).collect()


def test_settings_are_checked():
    import pytest
    with pytest.raises(ValueError):
        Settings(horizon_hours=12)
    with pytest.raises(ValueError):
        Settings(elevation_mode="flat")
