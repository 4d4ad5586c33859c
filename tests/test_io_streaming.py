"""Readers, sinks and streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe import schemas
from perilframe.sources import readers, sinks
from perilframe.streaming import live


def test_routing():
    assert schemas.classify_columns(["Claim Number", "Net Incurred"]) == "claims"
    assert schemas.classify_columns(["name", "asset_value_usd", "tiv"]) == "sites"
    assert schemas.classify_columns(["lat", "lon", "scenario"]) == "hazard_grid"
    assert schemas.classify_columns(["Location Name", "TIV"]) == "schedule"


def test_intake_counts_rejects(spark):
    df = spark.createDataFrame([("a", "25", "-80", "$1,000", "Frame"), ("b", "95", "0", "1", "x"), ("c", "1", "1", "-5", None)],
                               "name string, latitude string, longitude string, asset_value_usd string, construction string")
    good, bad = readers.intake_sites(df)
    r = good.first()
    assert (r.asset_value_usd, r.construction) == (1000.0, "frame") and bad.count() == 2


def test_claims_scan(spark):
    df = spark.createDataFrame([("1", "1/2/2020", "Palm", "Flood", "Open", "70,000", "10,000", "5,000", None), ("2", "bad", "Palm", "Flood", "", "1", "1", "0", "1")],
                               "`Claim Number` string, `Date of Loss` string, `Claimant Name` string, `Coverage Major` string, Status string, `Net Paid` string, `Net Outstanding` string, `Recovery Received` string, `Net Incurred` string")
    good, skipped = readers.load_claims(df)
    r = good.first()
    assert (r.net_incurred, r.incurred_basis, r.open) == (75000.0, "derived", True) and skipped.count() == 1


def test_grid_round_trip(spark, tmp_path):
    rows = [(25.0, -80.0, "present", "tc", 1.0, 2.0, 3.0, 4.0, 5.0, 6.005)]
    g = spark.createDataFrame(rows, "lat double, lon double, scenario string, hazard string, " + ", ".join(f"{v} double" for v in A.V_COLS))
    sinks.write_grid(g, str(tmp_path / "grid"))
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert back.count() == 1 and back.first().scenario == "present"


def test_stream_heat_equals_batch(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    rows = [(c, start + dt.timedelta(days=i), 28.0 + (i * 7 + c) % 11, 24.0 + (i * 7 + c) % 11) for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "cell long, ts timestamp, tmax double, tmean double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.heat_sums(stream).writeStream.format("memory").queryName("heat_state").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: {(r.cell, r.scenario): (r.days32, r.days35, round(r.cdd, 6)) for r in d.collect()}
    assert key(live.heat_indicators_from(spark.table("heat_state"))) == key(live.batch_heat(df))


def test_claim_sessions_batch(spark):
    rows = [("2020-01-01", "Flood"), ("2020-01-04", "Flood"), ("2020-01-08", "Flood")]
    df = spark.createDataFrame(rows, "d string, coverage string").select(F.to_timestamp("d").alias("ts"), "coverage", F.lit(1.0).alias("net_incurred"), F.lit(None).cast("string").alias("description"))
    assert sorted(r.claims for r in live.claim_sessions(df).collect()) == [1, 2]


def test_pack_of_another_version_is_refused(spark, tmp_path):
    site = '{"present": {"per_site": [{"name": "a", "loss": 1.0}], "portfolio": {"loss": 1.0}}}'
    for version, kind in ((1, '"results_pack"'), (2, '"results_pack"'), (1, '"other"'), (1, "null")):
        path = tmp_path / f"{version}{kind.strip(chr(34))}.json"
        path.write_text(f'{{"kind": {kind}, "pack_version": {version}, "scenarios": {site}}}')
        if (version, kind) == (1, '"results_pack"'):
            assert readers.read_pack_document(spark, str(path))["per_site"].count() == 1
        else:
            with pytest.raises(ValueError):
                readers.read_pack_document(spark, str(path))


def test_later_row_of_a_grid_file_wins(spark):
    cols = "lat double, lon double, scenario string, v10 double, row long"
    one = spark.createDataFrame([(1.0, 1.0, "present", 5.0, 2), (1.0, 1.0, "present", 4.0, 1), (2.0, 1.0, "present", 7.0, 3)], cols)
    two = spark.createDataFrame([(2.0, 1.0, "present", 6.0, 0)], cols)
    merged, bad = readers.load_grids([one, two, one.drop("lat")], "row")
    assert bad == 1 and {(r.lat, r.v10) for r in merged.collect()} == {(1.0, 5.0), (2.0, 6.0)} and "row" not in merged.columns
