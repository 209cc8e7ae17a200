import math

import pytest
from pyspark.sql import functions as F

from perimeter.operators import dataset as D
from perimeter.operators import losses as LO
from perimeter.operators import metrics as V
from perimeter.operators import splits as N
from perimeter.sources import detections as S


def scored(spark, rows):
    return spark.createDataFrame([(1, float(p), bool(t)) for p, t in rows], "sample_id int, prob double, target boolean")


def test_average_precision(spark):
    def ap(rows):
        return V.average_precision(V.pr_histogram(scored(spark, rows))).first()
    assert ap([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)]).ap == 1.0
    assert abs(ap([(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)]).ap - 0.25) < 1e-12
    assert math.isnan(ap([(0.5, 0), (0.4, 0)]).ap)


def test_threshold_is_strict(spark):
    out = {r.threshold: (r.tp, r.fp, r.fn) for r in V.confusion_counts(scored(spark, [(0.5, 1), (0.5, 0), (0.7, 1)]), []).collect()}
    assert out[0.5] == (1, 0, 1) and out[0.4] == (2, 1, 0)


def test_sign_test_matches_binomial(spark):
    a = spark.createDataFrame([(i, 0.0) for i in range(10)], "fire_id int, csi double")
    b = spark.createDataFrame([(i, 1.0 if i < 8 else -1.0) for i in range(10)], "fire_id int, csi double")
    row = V.paired_comparison(a, b).first()
    assert (row.wins, row.losses) == (8, 2)
    assert abs(row.p_sign - 2 * sum(math.comb(10, i) for i in range(3)) / 2**10) < 1e-9


def test_band_weights(spark):
    rates = [0.0, 0.10112, 0.2, 0.3, 0.4, 0.5, 0.9, 0.01, 0.0]
    rows = [(b, p, 0 if b == 0 else 100, 0, "train") for b, p in enumerate(rates)]
    df = spark.createDataFrame(rows, "band int, base_rate double, n_pixels int, n_positive int, split string")
    w = {r.band: r.weight for r in LO.band_weights(df, 300).collect()}
    assert w[0] == 1 and abs(w[1] - 8.889) < 1e-3 and w[6] == 1 and w[8] == 300
    for bad in (df.filter("band > 0"), df.withColumn("split", F.lit("val"))):
        with pytest.raises(Exception, match="band statistics"):
            LO.band_weights(bad, 300).collect()


def test_smoothing_optimum(spark):
    row = LO.weighted_bce(scored(spark, [(0.5, 1)]), 103, 0.02).first()
    assert abs(row.p_star - 0.510) < 1e-3 and row.smoothing_risk


def test_split_years_are_checked():
    with pytest.raises(ValueError, match="overlap"):
        N.check_split_years({"train": (2015, 2020), "val": (2020, 2021), "test": (2022, 2023)})
    with pytest.raises(ValueError, match="must be"):
        N.check_split_years({"train": (2015, 2020)})


def test_flip_negates_and_mirrors(spark):
    df = spark.createDataFrame([("s", 0, 1, 2, 3.0, 4.0, 5.0)], "sample_id string, step int, r int, c int, u10_lag0 double, v10_lag0 double, downwind double")
    ew = D.flip(df, F.lit(True), F.lit(False), 8).first()
    assert (ew.r, ew.c, ew.u10_lag0, ew.v10_lag0, ew.downwind) == (1, 5, -3.0, 4.0, 5.0)
    ns = D.flip(df, F.lit(False), F.lit(True), 8).first()
    assert (ns.r, ns.c, ns.u10_lag0, ns.v10_lag0, ns.downwind) == (6, 2, 3.0, -4.0, 5.0)


def test_normalising_commutes_with_flipping(spark):
    chans = ("burn_mask", "u10_lag0", "rh2m")
    df = spark.createDataFrame([("s", 0, 0, i, float(i % 2), i - 1.5, 2.0 * i) for i in range(4)],
                               "sample_id string, step int, r int, c int, burn_mask double, u10_lag0 double, rh2m double")
    stats = D.norm_stats(df, chans)
    yes, no = F.lit(True), F.lit(False)
    one = D.flip(D.normalise(df, stats, chans), yes, no, 4).orderBy("c").collect()
    two = D.normalise(D.flip(df, yes, no, 4), stats, chans).orderBy("c").collect()
    assert one == two
    got = {r.channel: (r.mean, r["std"]) for r in stats.collect()}
    assert got["burn_mask"] == (0.0, 1.0) and got["u10_lag0"][0] == 0.0


def test_downwind_points_away_from_fire(spark):
    rows = [("s", 0, r, c, 1.0 if (r, c) == (2, 2) else 0.0, 3.0, 0.0) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "sample_id string, step int, r int, c int, burn_mask double, u10_lag0 double, v10_lag0 double")
    out = {(r.r, r.c): r.downwind for r in D.downwind(df, 5).collect()}
    assert out[2, 4] == 3.0 and out[2, 0] == -3.0 and out[0, 2] == 0.0 and out[2, 2] == 0.0


def test_csv_families(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp,type\n36.5,-120.5,2020-01-01,934,n,1.5,0\n")
    (tmp_path / "b.csv").write_text("confidence,frp,latitude,longitude,acq_date,acq_time\nHigh,2.5,36.6,-120.6,2020-01-02,5\nh,1,36,-120,2020-01-02,2561\n")
    (tmp_path / "c.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp\n")
    df = S.read_detections(spark, str(tmp_path / "*.csv"))
    rows = {r.latitude: (r.acq_time, r.confidence, r.frp, r.type) for r in df.collect()}
    assert rows == {36.5: (934, "n", 1.5, 0), 36.6: (5, "High", 2.5, None), 36.0: (2561, "h", 1.0, None)}
    times = {r.latitude: str(r.acq) for r in S.parse_acquisition(df).collect()}
    assert times == {36.5: "2020-01-01 09:34:00", 36.6: "2020-01-02 00:05:00", 36.0: "None"}
    assert S.clean_detections(df).count() == 1  # typed files exist, so rows without type drop


def test_wide_sums_are_dealt_by_key(spark):
    from perimeter.operators import metrics
    rows = spark.createDataFrame([("a", 0.97, True), ("a", 0.2, False), ("b", 0.6, False)], "sample_id string, prob double, target boolean")
    counts = metrics.confusion_counts(rows, ["sample_id"], [0.1, 0.5])
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [("a", 0.1, 1, 1, 0), ("a", 0.5, 1, 0, 0), ("b", 0.1, 0, 1, 0), ("b", 0.5, 0, 1, 0)]
